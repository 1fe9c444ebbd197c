"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"\x20\x09-\x0D"
#: Bits of a membership filter: 2048 rows of 4 KiB, 8 MiB whatever the input holds.
FILTER_BITS = 1 << 26
BITMAP_BITS = 32768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One that is in fewer parts than half the cores, so a small one, is dealt over the cores."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() > cores else df.repartition(cores)


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables stored inside go to Python so many rows at a time: for rows that hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Marks df for broadcast if a count finds at most so many rows; else Spark shuffles both sides of the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like _name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in have:
        pass
    return name


def member_filter(keys: DataFrame, key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """A one-hash membership filter of the keys: rows (_bucket, _bits) of 4 KiB, at most bits / 32768 of them.

    Its size doesn't depend on the input. When the keys outgrow it, more rows pass; no member is ever held back.
    """
    at = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(bits))
    return (
        keys.select(at.alias("_at"))
        .groupBy((F.col("_at") / BITMAP_BITS).cast("long").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.col("_at") % BITMAP_BITS).alias("_bits"))
    )


def maybe_member(df: DataFrame, key: Column, filtered: DataFrame, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """Adds a boolean flag: false where the key is certainly not among those of member_filter()."""
    at = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(bits))
    side = F.broadcast(filtered)
    byte = F.conv(F.hex(F.substring(side["_bits"], ((at % BITMAP_BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.join(side, (at / BITMAP_BITS).cast("long") == side["_bucket"], "left").select(
        *[df[f"`{c}`"] for c in df.columns],
        F.coalesce((byte.cast("double") / F.pow(F.lit(2.0), (at % 8).cast("double"))).cast("long") % 2 == 1, F.lit(False)).alias(flag),
    )


def passing(df: DataFrame, key: Column, filtered: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of df whose key may be among those of member_filter(); the others certainly are not."""
    flag = fresh(df, "maybe")
    return maybe_member(df, key, filtered, flag, bits).where(flag).drop(flag)


def salted_join(probe: DataFrame, side: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "inner", salts: int = 64) -> DataFrame:
    """Joins probe to side, whose keys are unique, where one key may hold a third of the probe rows.

    hot: the keys (column key) that hold at least 1/1000 of the probe rows each, so at most 1000 of them; they are
    broadcast. Rows of hot keys go to `salts` tasks by a hash of `spread`; the side's hot rows are repeated for each.
    """
    marked = F.broadcast(hot.select(F.col(key).alias("_hot")))
    dealt = probe.join(marked, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0)
    ).drop("_hot")
    repeated = side.join(marked, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    ).drop("_hot")
    return dealt.join(repeated, [key, "_salt"], how).drop("_salt")


def row_keys(docs: DataFrame, *more: str | Column) -> DataFrame:
    """(more..., k1, k2): two hashes of doc_id and text, never null. Rows that repeat both share them."""
    ship(docs.sparkSession)
    return docs.select(*more, F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(5)).alias("k2"))


def without(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose row_keys() aren't in gone(k1, k2); of those in once, one of each.

    Only rows that a membership filter can't rule out are shuffled; the others pass through.
    """
    k1, k2, flag = fresh(docs, "k1"), fresh(docs, "k2"), fresh(docs, "maybe")
    marked = docs.withColumns({k1: F.xxhash64("doc_id", "text"), k2: F.xxhash64("text", "doc_id", F.lit(5))})
    keys = gone.select("k1") if once is None else gone.select("k1").unionByName(once.select("k1"))
    marked = maybe_member(marked, F.col(k1), member_filter(keys.withColumnRenamed("k1", k1), F.col(k1)), flag)
    left = gone.select(F.col("k1").alias("_g1"), F.col("k2").alias("_g2"))
    checked = marked.where(flag).join(left, (F.col(k1) == F.col("_g1")) & (F.col(k2) == F.col("_g2")), "left_anti")
    if once is not None:
        checked = checked.dropDuplicates([k1, k2])
    return marked.where(~F.col(flag)).unionByName(checked).drop(k1, k2, flag)


#: Edges that a task joins at once.
FOREST = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the edges u, v: each node but the smallest of its component, and that one."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(names))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(len(names))
    return names[below], names[root[below]]


def components(edges: DataFrame, what: str = "edges") -> DataFrame:
    """(node, root) for edges(u, v), longs, u <> v: root is the smallest node that can be reached, for each node of an edge.

    Each task joins the edges it has, up to FOREST at once, to trees of height one; large-star and small-star steps join
    trees of different tasks, until no node has two roots and no root has one. Each round is stored, so its lineage is
    short. A node's many neighbours are reduced by partial aggregation and met again by a join, never gathered.
    """

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else both.where("v < u")
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        met = salted_join(near, least.drop("n"), "u", least.where(F.col("n") * 500 >= max(n, 1000)).select("u"), F.col("v"))
        out = met.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= FOREST:
                yield joined(held)
                held = []
        if held:
            yield joined(held)

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sides = (np.concatenate([batch.column(c).to_numpy() for batch in held]) for c in ("u", "v"))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(*sides)], ["u", "v"])

    def settled(e: DataFrame) -> bool:
        ends = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("v")))
        return ends.groupBy("u").agg(F.min("v").alias("p"), F.max("v").alias("q")).where("p <> q").isEmpty()

    ship(edges.sparkSession)
    now = stored(edges.select("u", "v").where("u <> v").distinct().mapInArrow(join, "u long, v long"), what)
    while not settled(now):
        n = now.count()
        now = stored(star(star(now, True, n), False, n).mapInArrow(join, "u long, v long"), what)
    now = now.distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
