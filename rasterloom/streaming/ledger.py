"""Done-token ledgers, change keys and event windows; batch and streaming forms share their expressions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.codes import signature
from ..operators.windows import keep_last
from ..ship import shared_folder, ship


def tokens(work: DataFrame, key: str, settings: dict[str, object]) -> DataFrame:
    """Adds token and sig: what identifies an item of work, and the settings it is done under."""
    sig = signature(*[F.lit(str(v)) for _, v in sorted(settings.items())])
    return work.withColumns({"token": F.col(key).cast("string"), "sig": sig})


def pending(work: DataFrame, ledger: DataFrame, seq: str = "seq") -> DataFrame:
    """Work whose token has no done row under the same signature; only a token's last row counts."""
    last = keep_last(ledger, ["token"], seq).where("status = 'done'")
    return work.join(last.select("token", "sig"), ["token", "sig"], "left_anti")


def changed(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, what): added, removed or changed rows, by the MD5 of their columns."""
    a = old.select(key, signature(*[F.col(c) for c in cols]).alias("_a"))
    b = new.select(key, signature(*[F.col(c) for c in cols]).alias("_b"))
    what = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full_outer").withColumn("what", what).where("what IS NOT NULL").select(key, "what")


def tumbling(events: DataFrame, width: str, *aggs) -> DataFrame:
    w = events.groupBy(F.window("ts", width), "event_type").agg(*aggs)
    return w.select(F.col("window.start").alias("start"), "event_type", *[c for c in w.columns if c not in ("window", "event_type")])


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    w = events.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    w = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _arriving(spark: SparkSession, path: str, schema, late: str) -> DataFrame:
    """The rows of files that arrive in a folder. An event time without a zone counts as of the session's: watermarks want one."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def stream_tumbling(spark: SparkSession, path: str, schema, width: str, late: str, *aggs) -> DataFrame:
    """The streaming form of tumbling() over Parquet files that arrive in a folder."""
    return tumbling(_arriving(spark, path, schema, late), width, *aggs)


def first_status(spark: SparkSession, path: str, schema, late: str = "1 hour") -> DataFrame:
    """Status rows as they come, each (token, sig) once within the watermark: its first row."""
    return _arriving(spark, path, schema, late).dropDuplicatesWithinWatermark(["token", "sig"])


def last_status(status: DataFrame) -> DataFrame:
    """(token, sig, ts, seq, status, current): the last row of each token and signature by ts, then seq.

    current marks a token's newest signature; results under its other signatures are out of date and are to be computed
    again. Repeated rows count once. Rows without token, signature or ts are no status rows and are left out.
    """
    rows = status.where("token IS NOT NULL AND sig IS NOT NULL AND ts IS NOT NULL")
    last = rows.groupBy("token", "sig").agg(F.max_by(F.struct("ts", "seq", "status"), F.struct("ts", "seq", "status")).alias("r")).select("token", "sig", "r.*")
    newest = F.row_number().over(W.partitionBy("token").orderBy(F.desc("ts"), F.desc("seq"), F.desc("sig")))
    return last.withColumn("current", newest == 1)


class LastStatus(StatefulProcessor):
    """Keyed by token: the last row of each signature, and which signature is the newest.

    What falls behind the watermark under an old signature is dropped by a timer: all rows that can still come are later
    than it, so they replace it whether it is remembered or not. The newest signature stays: one row for each token.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "sig string", "us long, seq long, status string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        had = {k[0]: tuple(v) for k, v in self.last.iterator()}
        now = dict(had)
        for r in rows:
            row = (r.us, r.seq, r.status)
            if r.sig not in now or _order(row) > _order(now[r.sig]):
                now[r.sig] = row
        newest = lambda d: max(d, key=lambda s: (*_order(d[s])[:2], s)) if d else None
        was, top = newest(had), newest(now)
        for sig, row in now.items():
            if had.get(sig) != row:
                self.last.updateValue((sig,), row)
            if had.get(sig) != row or (was != top and sig in (was, top)):
                yield Row(token=key[0], sig=sig, us=row[0], seq=row[1], status=row[2], current=sig == top)
        if len(now) > 1:
            self._forget(now, top, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = {k[0]: tuple(v) for k, v in self.last.iterator()}
        if len(now) > 1:
            self._forget(now, max(now, key=lambda s: (*_order(now[s])[:2], s)), timerValues)
        return iter(())

    def _forget(self, now: dict, top: str, timerValues) -> None:
        watermark = timerValues.getCurrentWatermarkInMs()
        for sig, row in now.items():
            due = row[0] // 1000 + 1
            if sig != top and due <= watermark:
                self.last.removeKey((sig,))
            elif sig != top:
                self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def _order(row: tuple) -> tuple:
    """Nulls first, as Spark orders them."""
    return row[0], (row[1] is not None, row[1] or 0), (row[2] is not None, row[2] or "")


def stream_last_status(spark: SparkSession, path: str, schema, late: str = "1 hour") -> DataFrame:
    """last_status() over Parquet files that arrive in a folder, in update mode: a batch gives the rows of (token, sig) that changed.

    A token's first row under a new signature also gives the row of the signature before, now with current = false. Rows
    later than the watermark allows are dropped. Sets the session's state store to RocksDB, which keyed state needs.
    """
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _arriving(spark, path, schema, late).where("token IS NOT NULL AND sig IS NOT NULL AND ts IS NOT NULL")
    rows = rows.select("token", "sig", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "status")
    out = "token string, sig string, us long, seq long, status string, current boolean"
    kept = rows.groupBy("token").transformWithState(statefulProcessor=LastStatus(), outputStructType=out, outputMode="Update", timeMode="EventTime")
    return kept.select("token", "sig", F.timestamp_micros("us").alias("ts"), "seq", "status", "current")


def run_last_status(spark: SparkSession, path: str, schema, out: str, checkpoint: str, late: str = "1 hour") -> DataFrame:
    """Works through what has arrived since the last run with this checkpoint, then gives the table as it stands.

    A batch writes its changes as a part of its own, which a repeated batch overwrites; a (token, sig) is as its last part says.
    """

    def batch(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/part={i}")

    q = stream_last_status(spark, path, schema, late).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["ts", "seq", "status", "current"]
    parts = spark.read.schema("token string, sig string, ts timestamp, seq long, status string, current boolean, part long").parquet(out)
    return parts.groupBy("token", "sig").agg(F.max_by(F.struct(*cols), "part").alias("r")).select("token", "sig", "r.*")


def replayed_status(status: DataFrame, late: str) -> DataFrame:
    """last_status() by way of the stream: the rows are written to a folder and worked through from the start, all in the shared folder."""
    here = f"{shared_folder(status.sparkSession)}/streams/{uuid.uuid4().hex}"
    status.write.parquet(f"{here}/inbox")
    return run_last_status(status.sparkSession, f"{here}/inbox", status.schema, f"{here}/parts", f"{here}/checkpoint", late)


def run_new_tiles(spark: SparkSession, inbox: str, schema, out: str, checkpoint: str, clean) -> None:
    """Works through the files of a folder that an earlier run with the same checkpoint hasn't seen, then stops. A repeated batch overwrites its own part."""

    def batch(df: DataFrame, i: int) -> None:
        clean(df).write.mode("overwrite").parquet(f"{out}/part={i}")

    q = spark.readStream.schema(schema).parquet(inbox).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
