"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key -ln(u) / weight from a hash of its identifier and its quality weight. A source's
target in words is met by complete epochs over all its documents first; the rest is a weighted sample without
replacement, the documents of smallest keys, up to the budget. The running sum that finds the end of the sample is
taken in two steps: buckets of the key within a source, whose order is that of the keys, then rows within a bucket; a
source that holds most rows is dealt over many buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, stored, table

WEIGHTS = (3, 1, 2)
#: What a quality weight counts as junk.
JUNK = "#$%&*|!"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """The share of characters that aren't junk signs, 0.05 at least."""
    n = F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))
    return F.greatest(F.lit(0.05), F.length(F.translate(F.coalesce(text, F.lit(" ")), JUNK, "")) / n)


def uniform(seed: int, *cols: Column) -> Column:
    """In (0, 1), from the first 13 hex digits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *cols)), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def targets(sizes: DataFrame, share: float, weights: tuple[int, ...] = WEIGHTS, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for sizes(source, source_size), one row per source.

    Sources by code point, null last, get the weights in turn and share `share` times all sizes; a target stops at
    `most` times its source's size, and the excess goes to the others by weight. In order of the ratio of that cap to
    the weight, the sources before some point are capped, and those after it get one amount per weight.
    """
    # One row per source meets here, not one per document.
    order = W.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    before = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy()
    w = w.withColumn("total", F.sum("source_size").over(all_) * share).withColumn("all_w", F.sum("w").over(all_))
    w = w.withColumn("each", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    w = w.withColumn("level", F.max(F.when(F.col("cap") / F.col("w") >= F.col("each"), F.col("each"))).over(all_))
    return w.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weight: Column | None = None, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, rows_per_bucket: int = 50_000) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for each row of docs(doc_id, text, source).

    taken: the words that the mix takes of the row, whole epochs of it and, for the rows in the sample, its size again;
    the row at which the budget ends gives what is left of it, so a source's words meet its target to within one word.
    A null text has size 0 and nothing taken. A null source is a source of its own; a null doc_id is drawn like any
    other. Rows that repeat all of doc_id, text and source take turns in no fixed order, which leaves the result the
    same; equal keys go by doc_id, then by the text's hash. A very long text is one row of its size. An empty table gives
    an empty table; other columns are ignored.
    """
    size = n_words(F.col("text")) if size is None else size
    weight = quality_weight(F.col("text")) if weight is None else weight
    rows = docs.select("doc_id", "source", size.alias("size"), F.greatest(weight, F.lit(1e-6)).alias("weight"), F.md5(F.coalesce("text", F.lit(""))).alias("_text"))
    rows = rows.withColumn("key", -F.log(uniform(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_text"))) / F.col("weight"))
    rows = stored(rows, "keys")
    aims = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights), "targets")
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn(
        "budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    )
    # Buckets by the key's logarithm: an eighth of them to each doubling, so small weights, which make large keys, spread as well.
    buckets = max(128, -(-rows.count() // rows_per_bucket))
    rows = rows.withColumn("bucket", F.floor(F.log2(F.greatest("key", F.lit(1e-300))) * (buckets / 8.0)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("source", "bucket", before.alias("before"))
    aims, sums = (x.select(F.col("source").alias("_source"), *[c for c in x.columns if c != "source"]) for x in (aims, sums))
    starts = sums.join(aims.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("bucket", "_bucket")
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "_text").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, rows["source"].eqNullSafe(starts["_source"]) & (rows["bucket"] == starts["_bucket"]))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before") - F.col("ahead")))
    return rows.select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """op5: all documents mixed to 150% of their words."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = """
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    greatest(0.05, length(translate(coalesce(text, ' '), '#$%&*|!', '')) / greatest(length(coalesce(text, '')), 1)) AS weight,
    md5(coalesce(text, '')) AS h FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5(concat_ws(':', '7', coalesce(CAST(doc_id AS VARCHAR), 'null'), h)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / greatest(weight, 1e-6) AS key FROM r),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
e AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS "each"
  FROM w WINDOW b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN cap / w >= "each" THEN "each" END) OVER () * w, cap)) AS target FROM e),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.*, source_size, target, epochs, CAST(floor(target - epochs * source_size) AS BIGINT) AS budget,
  CAST(coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM k JOIN u ON k.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size AS BIGINT) + greatest(0, least(size, budget - ahead)) AS taken FROM p
"""
