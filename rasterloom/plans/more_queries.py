"""Queries over blocks, tiles, polygons, textures, and models on maps."""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.codes import signature
from ..operators import additive as AD
from ..operators import aggregates as A
from ..operators import focal as FO
from ..operators import geometry as G
from ..operators import joins as J
from ..operators import kernel as K
from ..operators import lattice as L
from ..operators import models as M
from ..operators import polygons as PO
from ..operators import predicates as P
from ..ship import shared_folder, stored
from ..sources import geotiff, rastertable
from ..sources import tables as T
from ..sources.tables import sql
from ..streaming import ledger as S
from .core_queries import _TOUCHED, r6
from .grid_queries import _HORN

Q: dict[str, tuple] = {}


def query(name: str, text: str | None = None):
    def add(f):
        Q[name] = (f, text)
        return f

    return add


@query("io5_block_windows", sql("dem_nodata", "SELECT row // 16 AS br, col // 16 AS bc, count(*) AS n_valid, round(min(z), 6) AS lo, round(max(z), 6) AS hi FROM dem_nodata GROUP BY 1, 2"))
def _(s, d):
    g = P.all_valid(T.dem_nodata(s, d), ["z"])
    b = g.groupBy(F.floor(F.col("row") / 16).cast("int").alias("br"), F.floor(F.col("col") / 16).cast("int").alias("bc"))
    return b.agg(F.count(F.lit(1)).alias("n_valid"), F.round(F.min("z"), 6).alias("lo"), F.round(F.max("z"), 6).alias("hi"))


@query("ge3_aligned_grids", sql("dem sar", "+ a AS (SELECT * FROM dem WHERE row >= 5), b AS (SELECT * FROM sar WHERE col <= 20), e AS (SELECT greatest((SELECT min(row) FROM a), (SELECT min(row) FROM b)) AS r0, least((SELECT max(row) FROM a), (SELECT max(row) FROM b)) AS r1, greatest((SELECT min(col) FROM a), (SELECT min(col) FROM b)) AS c0, least((SELECT max(col) FROM a), (SELECT max(col) FROM b)) AS c1) SELECT row - r0 AS row, col - c0 AS col, round(z, 6) AS z, round(hh, 6) AS hh FROM a JOIN b USING (row, col), e WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1"))
def _(s, d):
    return G.align(T.dem(s, d).where("row >= 5"), T.sar(s, d).where("col <= 20").select("row", "col", "hh")).select("row", "col", r6("z"), r6("hh"))


@query("ge7_mosaic_crop", sql("dem", "SELECT row - 7 AS row, col - 3 AS col, round(z, 6) AS z FROM dem WHERE row BETWEEN 7 AND 22 AND col BETWEEN 3 AND 18"))
def _(s, d):
    tiles = T.dem(s, d).select(F.floor(F.col("row") / 8).cast("int").alias("ty"), F.floor(F.col("col") / 8).cast("int").alias("tx"), (F.col("row") % 8).alias("r"), (F.col("col") % 8).alias("c"), "z")
    m = tiles.where("ty BETWEEN 0 AND 2 AND tx BETWEEN 0 AND 2").select((F.col("ty") * 8 + F.col("r") - 7).alias("row"), (F.col("tx") * 8 + F.col("c") - 3).alias("col"), r6("z"))
    return P.in_bounds(m, 16, 16)


@query("ge8d_chip_plan")
def _(s, d):
    p = T.pts(s, d)
    c = G.clusters(p, 1.0).join(p, "id")
    parts = G.split_groups(c.select("id", "x", "y", F.col("comp").alias("grp")), "grp", 20.0)
    chips = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n_points"), F.sort_array(F.collect_list("id")).alias("m"), ((F.min("x") + F.max("x")) / 2).alias("cx"), ((F.min("y") + F.max("y")) / 2).alias("cy"), (F.max("x") - F.min("x") + 2).alias("width"), (F.max("y") - F.min("y") + 2).alias("height"))
    return chips.select(F.col("part").alias("chip_id"), "n_points", "cx", "cy", "width", "height", signature(F.array_join(F.col("m").cast("array<string>"), "|"), F.col("width"), F.col("height")).alias("key"))


@query("ge9_rasterised_polygons", sql("zones", "+ a AS (SELECT *, unnest(range(CAST(floor(y0) AS INT), CAST(ceil(y1) AS INT))) AS r FROM zones), b AS (SELECT *, unnest(range(CAST(floor(x0) AS INT), CAST(ceil(x1) AS INT))) AS c FROM a) SELECT zone, CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM b WHERE c + 0.5 >= x0 AND c + 0.5 < x1 AND r + 0.5 >= y0 AND r + 0.5 < y1 AND (c + 0.5 - x0) / (x1 - x0) + (r + 0.5 - y0) / (y1 - y0) < 1 - 1e-12"))
def _(s, d):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    t = T.zones(s, d).select("zone", F.array(point("x0", "y0"), point("x1", "y0"), point("x0", "y1")).alias("ring"))
    return PO.rasterise(t)


@query("ge17_shared_boundaries")
def _(s, d):
    return PO.simplified(PO.boundary_chains(T.cls(s, d), "cls"), 0.75)


@query("ge22_gap_fill")
def _(s, d):
    g = L._shared(T.cls(s, d), "classes")
    return PO.reattach(L.nearest_fill(g.where("(row * 7 + col * 13) % 17 <> 0"), g.select("row", "col"), "cls"), "cls")


@query("ge27_half_plane", sql("dem", "SELECT row, col FROM dem WHERE (col + 0.5::DOUBLE - 6) ** 2 + (row + 0.5::DOUBLE - 8) ** 2 <= (col + 0.5::DOUBLE - 18) ** 2 + (row + 0.5::DOUBLE - 30) ** 2"))
def _(s, d):
    near = lambda x, y: (F.col("col") + 0.5 - x) ** 2 + (F.col("row") + 0.5 - y) ** 2
    return T.dem(s, d).where(near(6.0, 8.0) <= near(18.0, 30.0)).select("row", "col")


@query("ge30_segments_near_points", sql("zones pts", f"+{_TOUCHED}, p AS (SELECT id, CAST(floor(x / 4) AS INT) AS col, CAST(floor(y / 2.5::DOUBLE) AS INT) AS row FROM pts), a AS (SELECT zone, count(*) AS cells FROM touched GROUP BY zone HAVING count(*) >= 3) SELECT zone, any_value(cells) AS cells, count(DISTINCT id) AS n_points FROM touched JOIN a USING (zone) JOIN p USING (row, col) GROUP BY zone"))
def _(s, d):
    c = J.cells_of_boxes(T.zones(s, d))
    n = c.groupBy("zone").agg(F.count(F.lit(1)).alias("cells")).where("cells >= 3")
    p = T.pts(s, d).select("id", F.floor(F.col("x") / 4).cast("int").alias("col"), F.floor(F.col("y") / 2.5).cast("int").alias("row"))
    return c.join(n, "zone").join(p, ["row", "col"]).groupBy("zone").agg(F.max("cells").alias("cells"), F.countDistinct("id").alias("n_points"))


@query("ge32_fallback_squares", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN l_quantity ELSE 100.0 END AS area, CASE WHEN l_discount >= 0.05 THEN 'segment' ELSE 'square' END AS kind FROM lineitem")
def _(s, d):
    li = T.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") >= 0.05, F.col("l_quantity")).alias("seg"))
    return li.select("l_orderkey", "l_linenumber", F.coalesce("seg", F.lit(100.0)).alias("area"), F.when(F.col("seg").isNull(), "square").otherwise("segment").alias("kind"))


@query("m14_surface_ratio", sql("dem", f"+{_HORN} SELECT row, col, round(sqrt(1 + p * p + q * q), 6) AS ratio FROM h WHERE p IS NOT NULL"))
def _(s, d):
    k = FO.kernel(T.dem(s, d), "z", FO.horn()).where("p IS NOT NULL")
    return k.select("row", "col", F.round(F.sqrt(1 + F.col("p") ** 2 + F.col("q") ** 2), 6).alias("ratio"))


@query("m33_ground_pixel", "SELECT c_custkey, round(cos(radians(c_acctbal / 150)) * 2 * pi() * 6378137.0::DOUBLE / 256 / 65536, 6) AS metres FROM customer")
def _(s, d):
    return T.read(s, d, "customer").select("c_custkey", F.round(F.cos(F.radians(F.col("c_acctbal") / 150)) * (2 * math.pi * 6378137.0 / 256 / 65536), 6).alias("metres"))


@query("m36_texture", sql("dem", f"+{_HORN}, w AS (SELECT a.row, a.col, sqrt(greatest(avg(b.z * b.z) - avg(b.z) * avg(b.z), 0)) AS sd FROM dem a JOIN dem b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col) SELECT row, col, round(sd, 5) AS sd, round(8 * sqrt(p * p + q * q), 5) AS sobel FROM w JOIN h USING (row, col)"))
def _(s, d):
    g = FO.kernel(T.dem(s, d), "z", FO.horn())
    b = FO.box(g.select("row", "col", "z", "p", "q"), 1, {"_s": F.col("z"), "_q": F.col("z") ** 2, "_n": F.lit(1.0)})
    m = F.col("_s") / F.col("_n")
    return b.select("row", "col", F.round(F.sqrt(F.greatest(F.col("_q") / F.col("_n") - m * m, F.lit(0.0))), 5).alias("sd"), F.round(8 * F.sqrt(F.col("p") ** 2 + F.col("q") ** 2), 5).alias("sobel"))


@query("m36_contrast", sql("cls", "SELECT a.row, a.col, round(sum((a.cls - b.cls) ** 2) / 4.0::DOUBLE, 6) AS contrast FROM cls a JOIN cls b ON (b.row, b.col) IN ((a.row, a.col + 1), (a.row + 1, a.col), (a.row + 1, a.col + 1), (a.row + 1, a.col - 1)) GROUP BY a.row, a.col"))
def _(s, d):
    n = J.neighbours(T.cls(s, d), "cls", ((0, 1), (1, 0), (1, 1), (1, -1)))
    return n.groupBy("row", "col").agg(F.round(F.sum((F.col("cls") - F.col("near")) ** 2) / 4.0, 6).alias("contrast"))


@query("ml21_suitability_map", sql("bands", "SELECT row, col, round(1 / (1 + exp(-(0.8::DOUBLE * b0 - 0.5::DOUBLE * b1 + 0.3::DOUBLE * b2 + 0.1::DOUBLE))), 6) AS suit FROM bands"))
def _(s, d):
    return T.bands(s, d).select("row", "col", F.round(M.logistic(M.linear_score(["b0", "b1", "b2"], [0.8, -0.5, 0.3], 0.1)), 6).alias("suit"))


@query("ml20_class_map")
def _(s, d):
    """Class and greatest probability of each pixel by a forest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    cols = [f"b{i}" for i in range(8)]
    v = VectorAssembler(inputCols=cols, outputCol="x").transform(T.bands(s, d))
    model = RandomForestClassifier(labelCol="class_name", featuresCol="x", numTrees=10, maxDepth=5, seed=42).fit(v)
    return model.transform(v).select("row", "col", F.col("prediction").cast("int").alias("cls"), F.array_max(vector_to_array("probability")).alias("p"))


@query("ml12_kernel_machine")
def _(s, d):
    """A radial kernel through landmarks, hinge loss, and probabilities from held-out folds."""
    g = T.bands(s, d).withColumn("pa", (F.col("class_name") < 3).cast("int"))
    model = K.fit(g, ["b0", "b1", "b2", "b3"], "pa", landmarks=32)
    return model.transform(g).select("id", "pa", F.round(F.col("p")[1], 6).alias("p"))


@query("ml17_class_importance")
def _(s, d):
    """By class and predictor, how F1 falls when the predictor is permuted."""
    cols = ["b0", "b1", "b2"]
    g = T.bands(s, d).select("id", "class_name", *cols)
    runs = [M.permuted(g, c, 2).select("id", "class_name", *cols, F.lit(c).alias("feature")) for c in cols]
    # A nearest-mean model: classes by predictors, so the means are a small table.
    means = g.groupBy("class_name").agg(*[F.avg(c).alias(f"m_{c}") for c in cols]).withColumnRenamed("class_name", "k")
    dist = reduce(Column.__add__, [(F.col(c) - F.col(f"m_{c}")) ** 2 for c in cols])
    score = lambda df: df.crossJoin(F.broadcast(means)).groupBy("feature", "row_id", "class_name").agg(F.min_by("k", F.struct(F.round(dist, 9), "k")).alias("pred"))
    base = g.withColumn("feature", F.lit(""))
    u = reduce(lambda a, b: a.unionByName(b), [*runs, base]).withColumn("row_id", F.struct("id", *cols))
    n = score(u).groupBy("feature", "class_name", "pred").agg(F.count(F.lit(1)).alias("n"))
    hit = n.where("class_name = pred").select("feature", "class_name", F.col("n").alias("tp"))
    side = n.groupBy("feature", "class_name").agg(F.sum("n").alias("t")).join(n.groupBy("feature", F.col("pred").alias("class_name")).agg(F.sum("n").alias("p")), ["feature", "class_name"], "left").join(hit, ["feature", "class_name"], "left")
    f1 = side.select("feature", "class_name", (2 * F.coalesce("tp", F.lit(0)) / (F.col("t") + F.coalesce("p", F.lit(0)))).alias("f1"))
    b = f1.where("feature = ''").select("class_name", F.col("f1").alias("base"))
    return f1.where("feature <> ''").join(b, "class_name").select("class_name", "feature", (F.col("base") - F.col("f1")).alias("drop"))


@query("ml19_smooth_response")
def _(s, d):
    """A penalised spline of the response to one predictor: the normal equations are sums over rows, 8 by 8 numbers."""
    return M.smooth_fit(T.read(s, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1e4).alias("y")))


_RASTERS = "g AS (SELECT year(o_orderdate) AS year, o_custkey // 25 AS row, o_custkey % 25 AS col, o_orderstatus AS band, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3, 4)"


@query("io25_raster_catalogue", f"WITH {_RASTERS} SELECT 'mean' AS model, CAST(year AS INT) AS year, band, col + 0.5::DOUBLE AS x, -(row + 0.5::DOUBLE) AS y, round(v, 4) AS value FROM g WHERE year BETWEEN 1994 AND 1996 AND band IN ('F', 'P') AND col + 0.5::DOUBLE > 4 AND -(row + 0.5::DOUBLE) <= -2")
def _(s, d):
    """A raster for each year is written, and the folder read as a table, of which filters leave some years, bands and blocks."""
    o = T.read(s, d, "orders")
    g = o.groupBy(F.year("o_orderdate").alias("year"), F.floor(F.col("o_custkey") / 25).cast("int").alias("row"), (F.col("o_custkey") % 25).cast("int").alias("col")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    geotiff.register(s)
    rastertable.register(s)
    g, root = stored(g, "rasters"), f"{shared_folder(s)}/rasters/{uuid.uuid4().hex}"
    for r in g.select("year").distinct().where("year IS NOT NULL").collect():  # a row for each year
        one = g.where(F.col("year") == r["year"]).drop("year").repartitionByRange("row").sortWithinPartitions("row", "col")
        one.write.format("plaintiff").mode("append").save(f"{root}/model=mean/year={r['year']}")
    t = s.read.format("rastertable").load(root).where("year BETWEEN 1994 AND 1996 AND band IN ('F', 'P') AND x > 4 AND y <= -2")
    return t.select("model", "year", "band", "x", "y", F.round("value", 4).alias("value"))


@query("ml19_additive_response")
def _(s, d):
    """Curves of a binary class over three predictors at once, with intervals, on the logit scale."""
    b, cols = T.bands(s, d).withColumn("pa", (F.col("class_name") < 3).cast("int")), ["b0", "b1", "b2"]
    c = AD.response(b, AD.fit(b, cols, "pa", "binomial"))
    return c.select("feature", "i", *[r6(x) for x in ("value", "fit", "low", "high")])


@query("ss3_last_status", "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS token, event_type AS sig, event_id FROM events) SELECT token, sig, max(event_id) AS seq FROM e GROUP BY 1, 2")
def _(s, d):
    e = T.read(s, d, "events").select(F.col("user_id").cast("string").alias("token"), F.col("event_type").alias("sig"), F.col("event_id").alias("seq"))
    return e.groupBy("token", "sig").agg(F.max("seq").alias("seq"))


@query("ss3_status_stream", "WITH r AS (SELECT CAST(user_id AS VARCHAR) AS token, event_type AS sig, ts, event_id AS seq, CASE WHEN value < 10 THEN 'rejected' ELSE 'ok' END AS status FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY token, sig ORDER BY ts DESC, seq DESC) = 1) SELECT token, sig, seq, status, row_number() OVER (PARTITION BY token ORDER BY ts DESC, seq DESC, sig DESC) = 1 AS current FROM l")
def _(s, d):
    """Events as status rows, worked through as a stream with keyed state."""
    e = T.read(s, d, "events").select(F.col("user_id").cast("string").alias("token"), F.col("event_type").alias("sig"), "ts", F.col("event_id").alias("seq"), F.when(F.col("value") < 10, "rejected").otherwise("ok").alias("status"))
    return S.replayed_status(e, "1000 days").select("token", "sig", "seq", "status", "current")


@query("io20_tile_parts", sql("cls", "SELECT row // 10 AS tile_r, count(*) AS n FROM cls GROUP BY 1"))
def _(s, d):
    g = T.cls(s, d).withColumn("tile_r", F.floor(F.col("row") / 10).cast("int"))
    return L.stored_parts(g, "tile_r").groupBy("tile_r").agg(F.count(F.lit(1)).alias("n"))
