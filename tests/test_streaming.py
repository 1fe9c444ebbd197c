"""The streaming forms give what the batch forms do."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rasterloom.sources import tables
from rasterloom.streaming import ledger

from .compare import rows


def test_stream_of_windows_equals_batch(spark, sf, tmp_path):
    e = tables.read(spark, sf, "events")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    n = F.count(F.lit(1)).alias("n")
    q = ledger.stream_tumbling(spark, str(tmp_path / "in"), e.schema, "1 day", "40 days", n).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("win").toPandas()) == rows(ledger.tumbling(e, "1 day", n).toPandas())


def test_stream_of_statuses_gives_each_token_once(spark, tmp_path):
    """Repeats within the watermark go, with and without a zone; another signature is another row."""
    at = "timestamp_ntz'2024-01-01 00:00:00'"
    status = spark.sql(f"SELECT CAST(id % 4 AS STRING) AS token, CAST(id % 2 AS STRING) AS sig, {at} + make_interval(0, 0, 0, 0, 0, id) AS ts, 'done' AS status FROM range(40)")
    for kind in ("timestamp_ntz", "timestamp"):
        df = status.withColumn("ts", F.col("ts").cast(kind))
        df.repartition(3).write.parquet(str(tmp_path / kind))
        q = ledger.first_status(spark, str(tmp_path / kind), df.schema).writeStream.format("memory").queryName(f"status_{kind}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted((r["token"], r["sig"]) for r in spark.table(f"status_{kind}").collect()) == [("0", "0"), ("1", "1"), ("2", "0"), ("3", "1")]


def test_stream_of_last_statuses_equals_batch_after_late_rows_and_a_restart(spark, tmp_path):
    """Each append is a run of its own from the checkpoint: late and repeated rows, signatures that change and come back."""
    rng = random.Random(7)
    start, inbox, out, check = datetime(2024, 1, 1), *(str(tmp_path / x) for x in ("inbox", "out", "check"))
    schema = "token string, sig string, ts timestamp, seq long, status string"
    seen: list[tuple] = []
    for run in range(4):
        new = []
        for i in range(60):
            late = rng.randrange(50)  # minutes behind the run's hour: inside the watermark
            at = start + timedelta(hours=run, minutes=-late, seconds=rng.randrange(60))
            new.append((rng.choice([*"abcdef", None] if i % 9 == 0 else "abcdef"), rng.choice(["s1", "s2", f"r{run}"]), at, run * 100 + i, rng.choice(["ok", "rejected", None])))
        new += rng.sample(new, 10)
        seen += new
        spark.createDataFrame(new, schema).repartition(2).write.mode("append").parquet(inbox)
        got = ledger.run_last_status(spark, inbox, schema, out, check, "2 hours")
        want = ledger.last_status(spark.createDataFrame(seen, schema))
        assert rows(got.toPandas()) == rows(want.toPandas())
    again = ledger.run_last_status(spark, inbox, schema, out, check, "2 hours")
    assert rows(again.toPandas()) == rows(want.toPandas())


def test_old_signatures_are_forgotten_behind_the_watermark_and_may_come_back(spark, tmp_path):
    """The state keeps a token's newest signature only, once time has passed; a signature that returns counts as before."""
    start, inbox, out, check = datetime(2024, 1, 1), *(str(tmp_path / x) for x in ("inbox", "out", "check"))
    schema = "token string, sig string, ts timestamp, seq long, status string"
    rows_in = [("a", "s1", 0, 1), ("a", "s2", 5, 2), ("b", "s1", 5, 3)], [("b", "s1", 600, 4)], [("b", "s1", 601, 5)], [("a", "s1", 700, 6)]
    seen = []
    for i, part in enumerate(rows_in):
        new = [(t, s, start + timedelta(minutes=m), q, "ok") for t, s, m, q in part]
        seen += new
        spark.createDataFrame(new, schema).write.mode("append").parquet(inbox)
        got = ledger.run_last_status(spark, inbox, schema, out, check, "10 minutes")
        assert rows(got.toPandas()) == rows(ledger.last_status(spark.createDataFrame(seen, schema)).toPandas())
        if i == 2:
            state = spark.read.format("statestore").option("stateVarName", "last").load(check).selectExpr("key.*", "user_map_key.*").collect()
            assert sorted(tuple(r)[-1] for r in state) == ["s1", "s2"] and len(state) == 2


def test_new_tiles_only_once(spark, sf, tmp_path):
    e = tables.read(spark, sf, "events").select("event_id", "value")
    inbox, out, check = (str(tmp_path / x) for x in ("inbox", "out", "check"))
    e.where("event_id % 2 = 0").write.mode("append").parquet(inbox)
    clean = lambda df: df.where("value > 10")
    ledger.run_new_tiles(spark, inbox, e.schema, out, check, clean)
    e.where("event_id % 2 = 1").write.mode("append").parquet(inbox)
    ledger.run_new_tiles(spark, inbox, e.schema, out, check, clean)
    ledger.run_new_tiles(spark, inbox, e.schema, out, check, clean)
    got = spark.read.parquet(out).drop("part")
    assert rows(got.toPandas()) == rows(clean(e).toPandas())
