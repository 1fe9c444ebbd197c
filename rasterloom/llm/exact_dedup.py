"""Exact deduplication by a log-structured merge index of text digests.

Each task collects rows in a memtable of bounded size; a full one is flushed as a sorted run with one row per digest,
its smallest and largest identifier and its rows. So a text that a third of all documents repeat is one row per run.
Compaction merges runs, and levels that were merged before, by ranges of digests into one sorted level with one row per
digest. A filter of the digests that occur more than once goes with the level; rows are held against it before anything
of them moves. Its hits are compared byte by byte with the row that stays; rows that only share the digest form groups
of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, member_filter, passing, row_keys, salted_join, ship, stored, table, without

#: Rows that a memtable takes before it is flushed.
MEMTABLE = 65_536


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def flush(rows: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    """Stored sorted runs (run, digest, least, most, n) of rows(digest, doc_id): each task flushes its memtable after so many rows and at its end."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flushed() -> list[pa.RecordBatch]:
            t = pa.Table.from_batches(held).group_by("digest").aggregate([("doc_id", "min"), ("doc_id", "max"), ([], "count_all")]).sort_by("digest")
            held.clear()
            name = pa.array([uuid.uuid4().hex] * len(t))
            return pa.table([name, t["digest"], t["doc_id_min"], t["doc_id_max"], t["count_all"]], ["run", "digest", "least", "most", "n"]).to_batches()

        for batch in batches:
            at = 0
            while at < len(batch):
                held.append(batch.slice(at, memtable - sum(map(len, held))))
                at += len(held[-1])
                if sum(map(len, held)) == memtable:
                    yield from flushed()
        if held:
            yield from flushed()

    ship(rows.sparkSession)
    return stored(rows.select("digest", "doc_id").mapInArrow(run, f"run string, digest binary, least {kind}, most {kind}, n long"), "runs")


def compact(*levels: DataFrame) -> DataFrame:
    """One stored level (digest, least, most, n), sorted and dealt by ranges of digests, of runs and earlier levels."""
    every = reduce(DataFrame.unionByName, (x.select("digest", "least", "most", "n") for x in levels))
    merged = every.repartitionByRange("digest").sortWithinPartitions("digest")
    return stored(merged.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")), "level")


def exact_groups(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] = ascii_lower, digest: Callable[[Column], Column] = sha256, keys: bool = False, memtable: int = MEMTABLE) -> DataFrame:
    """Adds nothing and drops nothing: a row (doc_id, digest, keep_id, group_size) for each row of docs(doc_id, text).

    A null text counts as empty. A null doc_id counts as smaller than all others when the largest stays, and as larger
    when the smallest does, so it stays only where the group has no other. Rows that repeat both doc_id and text are
    rows of one group each, all with that doc_id. Texts of any length are compared whole; ties can't be, as equal
    identifiers are one. Other columns of docs are ignored; an empty table gives none. keys: also the row_keys() k1, k2.
    """
    texts = row_keys(docs, "doc_id", normalise(F.coalesce("text", F.lit(""))).alias("norm")).withColumn("digest", digest(F.col("norm")))
    also = ["k1", "k2"] * keys
    rows = stored(texts.select("doc_id", "digest", *also), "digests")
    level = compact(flush(rows, memtable))
    index = level.select("digest", F.col({"smallest": "least", "largest": "most"}[keep]).alias("keep_id"), F.col("n").alias("group_size"))
    repeated = index.where("group_size > 1")
    filtered = stored(member_filter(repeated, F.col("digest")), "filter")
    hot = stored(index.where(F.col("group_size") * 1000 >= F.lit(max(rows.count(), 2000))).select("digest"), "hot")

    # Hits: only rows of repeated digests move, with their texts.
    hits = passing(texts, F.col("digest"), filtered)
    kept = (
        hits.join(repeated.select(F.col("digest").alias("_d"), "keep_id"), (F.col("digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest").agg(F.min("norm").alias("kept_norm"))
    )
    differ = stored(salted_join(hits, kept, "digest", hot, F.col("doc_id")).where("norm <> kept_norm").select("doc_id", "digest", "norm"), "differ")
    out = salted_join(rows, index, "digest", hot, F.col("doc_id"))
    if differ.isEmpty():
        return out.select("doc_id", "digest", "keep_id", "group_size", *also)
    return _without_collisions(out, differ, texts, keep, also)


def _without_collisions(out: DataFrame, differ: DataFrame, texts: DataFrame, keep: str, also: list[str]) -> DataFrame:
    """Groups the rows of digests that different texts share by the texts themselves."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    shared = differ.select("digest").distinct()
    rows = texts.join(shared, "digest", "left_semi")
    groups = rows.groupBy("digest", "norm").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    cols = ["doc_id", "digest", "keep_id", "group_size", *also]
    again = rows.join(groups, ["digest", "norm"]).select(*cols)
    return out.join(shared, "digest", "left_anti").select(*cols).unionByName(again)


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows that repeat doc_id and text one stays.

    Only rows that may be copies are shuffled with their texts; the others pass through.
    """
    groups = stored(exact_groups(docs, keep, keys=True).where("group_size > 1"), "groups")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Equal up to case with one doc_id: the row with the smallest hash stands for the others.
    first = groups.where(stays).groupBy("digest", "keep_id").agg(F.min("k1").alias("k1"))
    others = groups.where(stays).join(first.select(F.col("digest").alias("_d"), F.col("keep_id").alias("_i"), F.col("k1").alias("_k")), (F.col("digest") == F.col("_d")) & F.col("keep_id").eqNullSafe(F.col("_i")) & (F.col("k1") > F.col("_k")))
    gone = groups.where(~stays).select("k1", "k2").unionByName(others.select("k1", "k2"))
    return without(docs, gone, groups.where(stays).select("k1", "k2"))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """op10: rows of documents with equal texts (A-Z lower-cased); the row with the largest doc_id stays."""
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


OP10_SQL = f"""
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, n.h AS text_sha256 FROM n JOIN g USING (h)
"""
