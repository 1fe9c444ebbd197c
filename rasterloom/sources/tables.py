"""The relations that the operators work on, derived from the given tables: grids, samples, points, zones, time slices.

Grids are 25 columns wide and have a row for ten parts; zones, points and time stacks grow in their own way, so that the
work of every query grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, z): a height grid."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.floor(F.col("l_partkey") / 10).cast("int").alias("row"), (F.col("l_suppkey") % 25).cast("int").alias("col")).agg(F.avg("l_quantity").alias("z"))


def dem_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dem with holes."""
    return dem(spark, sf_dir).where((F.col("row") * 7 + F.col("col") * 13) % 17 != 0)


def cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, cls): a class grid, the commonest flag of each cell as 1, 2, 3."""
    li = read(spark, sf_dir, "lineitem")
    n = li.groupBy(F.floor(F.col("l_partkey") / 10).cast("int").alias("row"), (F.col("l_suppkey") % 25).cast("int").alias("col"), "l_returnflag").count()
    # The count and the flag's place among A and N make one number, which a hash aggregate can hold; strings and structs would be sorted.
    f = F.col("l_returnflag")
    place = F.when(f < "A", 4).when(f == "A", 3).when(f < "N", 2).when(f == "N", 1).otherwise(0)
    best = n.groupBy("row", "col").agg(F.pmod(F.max(F.col("count") * 5 + place), F.lit(5)).alias("place"))
    return best.select("row", "col", F.when(F.col("place") == 3, 1).when(F.col("place") == 1, 2).otherwise(3).alias("cls"))


def sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, hh, hv): two radar bands, linear."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.floor(F.col("l_partkey") / 10).cast("int").alias("row"), (F.col("l_suppkey") % 25).cast("int").alias("col")).agg((F.avg("l_extendedprice") / 1e4).alias("hh"), (F.avg("l_discount") + 0.01).alias("hv"))


def suit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, year, suit): suitability in [0, 1] of pixels over years."""
    o = read(spark, sf_dir, "orders").where(F.year("o_orderdate") <= 2000)
    cells = o.groupBy(F.col("o_custkey").cast("int").alias("k"), F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("v"))
    ends = cells.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return cells.crossJoin(F.broadcast(ends)).select("k", "year", ((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("suit"))


def pres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pa, x, y, score): presences and background."""
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view"))
    return e.select(F.col("event_id").alias("id"), (F.col("event_type") == "purchase").cast("int").alias("pa"), F.col("user_id").cast("double").alias("x"), F.hour("ts").cast("double").alias("y"), F.col("value").alias("score"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, truth, score): labels with a score."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return read(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("truth"), F.col("n_chars").cast("double").alias("score"))


def legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v, h, area, code): polygons with two attributes."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"), F.col("o_orderpriority").alias("h"), F.col("o_totalprice").alias("area"), (F.col("o_custkey") % 1000).cast("int").alias("code"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, x0, y0, x1, y1, cls): boxes in pixel units, which overlap."""
    p = read(spark, sf_dir, "part")
    x0, y0 = (F.col("p_partkey") * 7 % 23).cast("double"), (F.floor(F.col("p_partkey") / 10) + F.col("p_partkey") * 11 % 7).cast("double")
    return p.select(F.col("p_partkey").alias("zone"), x0.alias("x0"), y0.alias("y0"), (x0 + 1 + F.col("p_size") % 3 * 0.75).alias("x1"), (y0 + 1 + F.col("p_size") % 4 * 0.75).alias("y1"), F.substring("p_brand", 7, 1).alias("cls"))


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y): points."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 97).cast("double").alias("x"), (F.floor(F.col("c_acctbal") / 100) + F.floor(F.col("c_custkey") / 1000) * 120).cast("double").alias("y"))


def bands_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, layer, value, label): samples in long form."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("layer", "v")).select("id", "layer", F.col("v").cast("double").alias("value"), "label")


def bands(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """(id, row, col, polygon_id, class_name, b0..): samples in wide form."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 25).cast("int").alias("row"), (F.col("vec_id") % 25).cast("int").alias("col"),
        F.floor(F.col("vec_id") / 10).cast("long").alias("polygon_id"), F.col("label").alias("class_name"),
        *[F.col("embedding")[i].cast("double").alias(f"b{i}") for i in range(n)],
    )


#: The same relations for DuckDB.
CTE = {
    "dem": "dem AS (SELECT l_partkey // 10 AS row, l_suppkey % 25 AS col, avg(l_quantity) AS z FROM lineitem GROUP BY 1, 2)",
    "dem_nodata": "dem_nodata AS (SELECT l_partkey // 10 AS row, l_suppkey % 25 AS col, avg(l_quantity) AS z FROM lineitem WHERE ((l_partkey // 10) * 7 + (l_suppkey % 25) * 13) % 17 <> 0 GROUP BY 1, 2)",
    "cls": "cls AS (SELECT row, col, CASE flag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS cls FROM (SELECT l_partkey // 10 AS row, l_suppkey % 25 AS col, l_returnflag AS flag, row_number() OVER (PARTITION BY l_partkey // 10, l_suppkey % 25 ORDER BY count(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY 1, 2, 3) WHERE rn = 1)",
    "sar": "sar AS (SELECT l_partkey // 10 AS row, l_suppkey % 25 AS col, avg(l_extendedprice) / 1e4 AS hh, avg(l_discount) + 0.01 AS hv FROM lineitem GROUP BY 1, 2)",
    "suit": "cells AS (SELECT o_custkey AS k, year(o_orderdate) AS year, avg(o_totalprice) AS v FROM orders WHERE year(o_orderdate) <= 2000 GROUP BY 1, 2), suit AS (SELECT k, year, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS suit FROM cells)",
    "pres": "pres AS (SELECT event_id AS id, CAST(event_type = 'purchase' AS INT) AS pa, CAST(user_id AS DOUBLE) AS x, CAST(hour(ts) AS DOUBLE) AS y, value AS score FROM events WHERE event_type IN ('purchase', 'view'))",
    "scored": "scored AS (SELECT doc_id AS id, quality AS truth, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id))",
    "legend": "legend AS (SELECT o_orderkey AS id, o_orderstatus AS v, o_orderpriority AS h, o_totalprice AS area, o_custkey % 1000 AS code FROM orders)",
    "zones": "zones AS (SELECT p_partkey AS zone, CAST(p_partkey * 7 % 23 AS DOUBLE) AS x0, CAST(p_partkey // 10 + p_partkey * 11 % 7 AS DOUBLE) AS y0, CAST(p_partkey * 7 % 23 AS DOUBLE) + 1 + (p_size % 3) * 0.75::DOUBLE AS x1, CAST(p_partkey // 10 + p_partkey * 11 % 7 AS DOUBLE) + 1 + (p_size % 4) * 0.75::DOUBLE AS y1, substr(p_brand, 7, 1) AS cls FROM part)",
    "pts": "pts AS (SELECT c_custkey AS id, CAST(c_custkey % 97 AS DOUBLE) AS x, CAST(floor(c_acctbal / 100) + c_custkey // 1000 * 120 AS DOUBLE) AS y FROM customer)",
    "bands_long": "bands_long AS (SELECT vec_id AS id, label, unnest(range(0, 64)) AS layer, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)",
    "bands": "bands AS (SELECT vec_id AS id, vec_id // 25 AS row, vec_id % 25 AS col, vec_id // 10 AS polygon_id, label AS class_name, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS b{i}" for i in range(8)) + " FROM embeddings)",
}


def sql(names: str, body: str) -> str:
    """The body behind the named relations."""
    return "WITH " + ", ".join(CTE[n] for n in names.split()) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")
