"""The pipeline against a plain version of its stages."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from rasterloom.llm import mixing
from rasterloom.llm.quality import score_documents

from .test_contracts import UPPER, brute_components, brute_hits, brute_simhash


def test_pipeline_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert good.columns == docs.columns
    rows = sorted(good.collect(), key=lambda r: r["doc_id"])
    first: dict[str, int] = {}
    for r in rows:
        first.setdefault(r["text"].translate(UPPER), r["doc_id"])
    rows = [r for r in rows if first[r["text"].translate(UPPER)] == r["doc_id"]]
    comp = brute_components([r["doc_id"] for r in rows], [brute_simhash(r["text"]) for r in rows])
    rows = [r for r, c in zip(rows, comp) if c == r["doc_id"]]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits([(r["doc_id"], r["text"]) for r in rows], bench)
    clean = {h[0] for h in hits if not h[5]}
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert set(got.doc_id) == clean and len(got) == len(clean)
    want = mixing.mix(docs.where(docs.doc_id.isin(sorted(clean)))).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(want.doc_id, want.taken))


def test_stages_on_odd_rows(spark, sf, odd, none):
    for docs in (odd, none):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= n
            if stage is not corpus_pipeline.mix_sources:
                assert out.columns == docs.columns


def test_stages_drop_what_they_should_of_odd_rows(spark, sf, odd):
    texts = lambda df: [(r["text"] or "").translate(UPPER) for r in df.collect()]
    stage = dict(corpus_pipeline.STAGES)
    rows = odd.collect()
    bad = {(r["doc_id"], r["k1"]) for r in score_documents(odd, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0").select("doc_id", "k1").collect()}
    assert stage["quality classifier"](spark, odd, sf).count() == len(rows) - score_documents(odd, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0").count() and len(bad) < len(rows)
    distinct = stage["exact dedup"](spark, odd, sf)
    assert Counter(texts(distinct)) == Counter(set(texts(odd)))
    prints = [brute_simhash(r["text"]) for r in rows]
    comp = brute_components([r["doc_id"] for r in rows], prints)
    kept = {r["doc_id"] for r in stage["simhash near-dedup"](spark, odd, sf).collect()}
    assert kept == {r["doc_id"] for r, c in zip(rows, comp) if r["doc_id"] == c}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    long = bench[0][1]
    leak = odd.limit(1).select(*[F.lit(long if c == "text" else None).cast(t).alias(c) for c, t in odd.dtypes])
    hits = brute_hits([(r["doc_id"], r["text"]) for r in rows], bench)
    clean = stage["benchmark decontamination"](spark, odd.unionByName(leak), sf)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(h[0] for h in hits if not h[5])
    mixed = stage["mixing sources"](spark, odd, sf).toPandas()
    assert len(mixed) == len(rows) and (mixed.taken <= 2 * mixed["size"]).all()
