"""Queries over predicates, joins, aggregates, windows, samples and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import predicates as P
from ..operators import windows as V
from ..sources import tables as T
from ..sources.tables import sql

Q: dict[str, tuple] = {}


def query(name: str, text: str | None = None):
    def add(f):
        Q[name] = (f, text)
        return f

    return add


def r6(c: str, n: int = 6):
    return (F.round(F.col(c), n) + 0.0).alias(c)


# Scans


@query("io6_decimated_range", sql("dem", "SELECT round(quantile_cont(z, 0.02), 6) AS lo, round(quantile_cont(z, 0.98), 6) AS hi, count(*) AS n FROM dem WHERE row % 2 = 0 AND col % 2 = 0"))
def _(s, d):
    z = T.dem(s, d).where("row % 2 = 0 AND col % 2 = 0")
    return z.agg(F.round(F.percentile("z", 0.02), 6).alias("lo"), F.round(F.percentile("z", 0.98), 6).alias("hi"), F.count(F.lit(1)).alias("n"))


@query("io7_presence_scan", "SELECT CAST(user_id AS DOUBLE) AS lon, value + 0.0 AS lat, event_id FROM events")
def _(s, d):
    raw = T.read(s, d, "events").select(F.col("user_id").alias("Longitude"), F.col("value").alias("LAT"), "event_id")
    return P.with_lon_lat(raw).select("lon", (F.col("lat") + 0.0).alias("lat"), "event_id")


_POINTS = "p AS (SELECT c_custkey AS id, try_cast(replace(replace(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR), '.', ','), ',', '.') AS DOUBLE) / 50 AS lon, CAST(c_custkey % 97 AS DOUBLE) AS lat FROM customer)"


@query("io8_points_with_rejects", f"WITH {_POINTS} SELECT id, round(lon, 6) AS lon, lat, CASE WHEN lon IS NULL OR lat IS NULL THEN 'not a number' WHEN lon BETWEEN -180 AND 180 AND lat BETWEEN -85 AND 85 THEN 'ok' ELSE 'outside' END AS status FROM p")
def _(s, d):
    c = T.read(s, d, "customer")
    text = F.regexp_replace(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), r"\.", ",")
    p = c.select(F.col("c_custkey").alias("id"), (P.number(text) / 50).alias("lon"), (F.col("c_custkey") % 97).cast("double").alias("lat"))
    return P.split_by_bbox(p, "lon", "lat").select("id", r6("lon"), "lat", "status")


@query("io10_reference_by_class", sql("zones", "SELECT cls, count(*) AS n, min(zone) AS first_zone FROM zones GROUP BY cls"))
def _(s, d):
    return T.zones(s, d).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("zone").alias("first_zone"))


@query("io13_code_table", """WITH t AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 7 = 1 THEN p_type END AS name, p_brand FROM part),
g AS (SELECT *, count(name) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM t) SELECT pos, max(name) OVER (PARTITION BY grp) AS name, p_brand FROM g""")
def _(s, d):
    t = T.read(s, d, "part").select(F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 7 == 1, F.col("p_type")).alias("name"), "p_brand")
    # A code table's sections of 700 rows: merged cells never reach over a section's first row.
    return V.forward_fill(t.withColumn("part", F.floor((F.col("pos") - 1) / 700)), ["name"], "pos", ("part",)).drop("part")


@query("io16_attributes_with_area", sql("legend", "SELECT id, v, h, area FROM legend WHERE area > 0"))
def _(s, d):
    return T.legend(s, d).where("area > 0").select("id", "v", "h", "area")


@query("io17_tile_cache", """WITH t AS (SELECT 12 AS z, l_partkey % 64 AS x, l_suppkey % 64 AS y, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice AS data FROM lineitem)
SELECT z, x, y, data FROM (SELECT *, row_number() OVER (PARTITION BY z, x, y ORDER BY seq DESC) AS n FROM t) WHERE n = 1""")
def _(s, d):
    t = T.read(s, d, "lineitem").select(F.lit(12).alias("z"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("data"))
    return t.groupBy("z", "x", "y").agg(F.max_by("data", "seq").alias("data"))


@query("io25_time_slices", r"""WITH f AS (SELECT DISTINCT 'suit_' || o_orderstatus || '_' || CAST(year(o_orderdate) AS VARCHAR) || '.tif' AS path FROM orders)
SELECT regexp_extract(path, '^suit_([A-Z]+)_', 1) AS model, CAST(regexp_extract(path, '((19|20)[0-9][0-9])', 1) AS INT) AS year, path FROM f""")
def _(s, d):
    f = T.read(s, d, "orders").select(F.concat(F.lit("suit_"), "o_orderstatus", F.lit("_"), F.year("o_orderdate").cast("string"), F.lit(".tif")).alias("path")).distinct()
    return f.select(F.regexp_extract("path", "^suit_([A-Z]+)_", 1).alias("model"), F.regexp_extract("path", r"((19|20)\d\d)", 1).cast("int").alias("year"), "path")


# Predicates


@query("pf1_predictors", "SELECT unnest(['b0', 'b1', 'b2', 'b3', 'b4', 'b5', 'b6', 'b7']) AS predictor, (SELECT count(*) FROM embeddings) AS n")
def _(s, d):
    b = T.bands(s, d)
    names = F.array(*[F.lit(c) for c in P.predictors(b)])
    return b.agg(F.count(F.lit(1)).alias("n")).select(F.explode(names).alias("predictor"), "n")


@query("pf2_band_subset", sql("bands", "SELECT id, round(b5, 6) AS b5, round(b1, 6) AS b1 FROM bands"))
def _(s, d):
    return T.bands(s, d).select("id", r6("b5"), r6("b1"))


@query("pf4_all_valid", sql("sar", "SELECT row, col, round(hh, 6) AS hh FROM sar WHERE hh IS NOT NULL AND hv IS NOT NULL AND CASE WHEN (row + col) % 5 = 0 THEN -9999 ELSE hh END <> -9999"))
def _(s, d):
    g = T.sar(s, d).withColumn("hh", F.when((F.col("row") + F.col("col")) % 5 == 0, -9999.0).otherwise(F.col("hh")))
    return P.all_valid(g, ["hh", "hv"], -9999.0).select("row", "col", r6("hh"))


@query("pf5_any_valid", sql("sar", "SELECT row, col FROM sar WHERE NOT ((row % 3 = 0) AND (col % 3 = 0))"))
def _(s, d):
    hole = lambda c, k: F.when(F.col(k) % 3 == 0, F.lit(None)).otherwise(F.col(c))
    return P.any_valid(T.sar(s, d).withColumns({"hh": hole("hh", "row"), "hv": hole("hv", "col")}), ["hh", "hv"]).select("row", "col")


_TOUCHED = "inner_rows AS (SELECT *, unnest(range(CAST(floor(y0) AS INT), CAST(ceil(y1) AS INT))) AS r FROM zones), inner_cells AS (SELECT *, unnest(range(CAST(floor(x0) AS INT), CAST(ceil(x1) AS INT))) AS c FROM inner_rows), touched AS (SELECT zone, cls, CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM inner_cells), centre AS (SELECT zone, cls, CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM inner_cells WHERE r + 0.5 >= y0 AND r + 0.5 < y1 AND c + 0.5 >= x0 AND c + 0.5 < x1)"


@query("pf6_polygon_mask", sql("dem zones", f"+{_TOUCHED} SELECT row, col, round(z, 6) AS z FROM dem WHERE (row, col) IN (SELECT (row, col) FROM touched)"))
def _(s, d):
    cells = J.cells_of_boxes(T.zones(s, d))
    return T.dem(s, d).join(cells, ["row", "col"], "left_semi").select("row", "col", r6("z"))


@query("pf7_in_bounds", sql("pts", "SELECT id, CAST(floor(y / 2) AS INT) AS row, CAST(floor(x / 2) AS INT) AS col FROM pts WHERE floor(y / 2) BETWEEN 0 AND 39 AND floor(x / 2) BETWEEN 0 AND 24"))
def _(s, d):
    p = T.pts(s, d).select("id", F.floor(F.col("y") / 2).cast("int").alias("row"), F.floor(F.col("x") / 2).cast("int").alias("col"))
    return P.in_bounds(p, 40, 25)


@query("pf9_text_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE trim(o_orderpriority) IN ('1-URGENT', '2-HIGH')")
def _(s, d):
    return T.read(s, d, "orders").where(P.is_in_text(F.col("o_orderpriority"), ["1-URGENT ", "2-HIGH"])).select("o_orderkey", "o_orderpriority")


@query("pf10_typed_literal", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 2")
def _(s, d):
    li = T.read(s, d, "lineitem")
    return li.where(F.col("l_linenumber") == P.as_type_of(li, "l_linenumber", "2")).select("l_orderkey", "l_linenumber")


@query("pf11_binarise", sql("suit", "SELECT k, year, CASE WHEN suit >= 0.5 THEN 1 ELSE 0 END AS bin FROM suit"))
def _(s, d):
    return T.suit(s, d).select("k", "year", P.binarise(F.col("suit"), 0.5).alias("bin"))


_RING = [(10.0, -5.0), (80.0, 10.0), (60.0, 95.0), (40.0, 30.0), (5.0, 60.0)]
_RING_SQL = " + ".join(f"CASE WHEN (({a[1]} > y) <> ({b[1]} > y)) AND x < ({b[0]} - {a[0]}) * (y - {a[1]}) / ({b[1] - a[1]}) + {a[0]} THEN 1 ELSE 0 END" for a, b in zip(_RING, [*_RING[1:], _RING[0]]))


@query("pf14_points_in_area", sql("pts", f"SELECT id FROM pts WHERE ({_RING_SQL}) % 2 = 1"))
def _(s, d):
    return T.pts(s, d).where(P.in_polygon(F.col("x"), F.col("y"), _RING)).select("id")


@query("pf15_crop_to_footprint", sql("dem", "+ o AS (SELECT min(row) - 2 AS r0, max(row) + 2 AS r1, min(col) - 2 AS c0, max(col) + 2 AS c1 FROM dem WHERE z > 30 AND row BETWEEN 10 AND 20) SELECT row, col, round(z, 6) AS z FROM dem, o WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1"))
def _(s, d):
    g = T.dem(s, d)
    return P.crop_to(g, g.where("z > 30 AND row BETWEEN 10 AND 20"), 2).select("row", "col", r6("z"))


# Joins


@query("j1_left_join", "SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def _(s, d):
    n = T.read(s, d, "nation").where("n_nationkey < 20")
    return T.read(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("j2_sample_at_points", sql("pts dem", "SELECT id, round(z, 6) AS z FROM pts JOIN dem ON dem.row = CAST(pts.y AS INT) % 40 AND dem.col = CAST(pts.x AS INT) % 25 WHERE y >= 0"))
def _(s, d):
    p = T.pts(s, d).where("y >= 0").select("id", (F.col("y").cast("int") % 40).alias("row"), (F.col("x").cast("int") % 25).alias("col"))
    return J.sample_at(p, T.dem(s, d)).select("id", r6("z"))


@query("j3_two_tier_lookup", "WITH l AS (SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 1000 + n_nationkey, 'exact ' || n_name FROM nation WHERE n_nationkey < 5), o AS (SELECT o_orderkey, o_custkey % 3000 AS code FROM orders) SELECT o_orderkey, coalesce(a.name, b.name) AS name FROM o LEFT JOIN l a ON a.key = o.code LEFT JOIN l b ON b.key = o.code % 1000")
def _(s, d):
    n = T.read(s, d, "nation")
    look = n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).unionByName(n.where("n_nationkey < 5").select((F.col("n_nationkey") + 1000).alias("key"), F.concat(F.lit("exact "), "n_name").alias("name")))
    o = T.read(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 3000).alias("code"))
    return J.lookup_two_tier(o, "code", look, "key", "name").select("o_orderkey", "name")


@query("j4_value_map", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    n = T.read(s, d, "nation").join(T.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return T.read(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("j5_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(s, d):
    o = T.read(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return T.read(s, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("j6_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(s, d):
    o = T.read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return T.read(s, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("j7_radius_pairs", sql("pts", "SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS dist FROM pts a JOIN pts b ON a.id < b.id AND a.x BETWEEN b.x - 1.5 AND b.x + 1.5 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.5"))
def _(s, d):
    return J.radius_pairs(T.pts(s, d), 1.5).select("a", "b", r6("dist"))


@query("j8_nearest_in_group", """WITH l AS (SELECT s_suppkey AS id, s_nationkey AS g, s_acctbal AS x, CAST(s_suppkey % 50 AS DOUBLE) AS y FROM supplier), r AS (SELECT c_custkey AS id, c_nationkey AS g, c_acctbal AS x, CAST(c_custkey % 50 AS DOUBLE) AS y FROM customer WHERE c_mktsegment = 'BUILDING'),
p AS (SELECT l.id, r.id AS near, sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2) AS dist FROM l JOIN r USING (g)) SELECT id, first(near ORDER BY dist, near) AS near, round(min(dist), 6) AS dist, count(*) FILTER (WHERE dist <= 500) AS n_inside FROM p GROUP BY id""")
def _(s, d):
    a = T.read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 50).cast("double").alias("y"))
    b = T.read(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 50).cast("double").alias("y"))
    return J.nearest(a, b, "g", 500.0).select("id", "near", r6("dist"), "n_inside")


@query("j9_zonal_cells", sql("zones", f"+{_TOUCHED}, n AS (SELECT zone, count(*) AS nt, (SELECT count(*) FROM centre c WHERE c.zone = t.zone) AS nc FROM touched t GROUP BY zone) SELECT zone, row, col FROM touched WHERE zone IN (SELECT zone FROM n WHERE nt < 10 OR nc < 3) UNION ALL SELECT zone, row, col FROM centre WHERE zone IN (SELECT zone FROM n WHERE NOT (nt < 10 OR nc < 3))"))
def _(s, d):
    return J.zonal_cells(T.zones(s, d))


@query("j10_zonal_profile", sql("zones dem", f"+{_TOUCHED} SELECT cls, count(*) AS n, round(avg(z), 6) AS mean FROM touched JOIN dem USING (row, col) GROUP BY cls"))
def _(s, d):
    c = J.cells_of_boxes(T.zones(s, d), keep=("zone", "cls"))
    return J.sample_at(c, T.dem(s, d)).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("z"), 6).alias("mean"))


@query("j11_box_intersections", sql("zones", "SELECT a.zone AS a, b.zone AS b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) AS area FROM zones a JOIN zones b ON a.zone < b.zone AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)"))
def _(s, d):
    return J.box_pairs(T.zones(s, d)).select("a", "b", r6("area"))


@query("j12_overlay_difference", sql("cls zones", f"+{_TOUCHED} SELECT cls.row, cls.col, cls.cls FROM cls WHERE (row, col) NOT IN (SELECT (row, col) FROM touched)"))
def _(s, d):
    return T.cls(s, d).join(J.cells_of_boxes(T.zones(s, d)), ["row", "col"], "left_anti").select("row", "col", "cls")


@query("j13_parameter_grid", "SELECT fold, depth, model FROM (SELECT DISTINCT o_orderkey % 5 AS fold FROM orders), (SELECT unnest([3, 5, 7]) AS depth), (SELECT DISTINCT p_type AS model FROM part)")
def _(s, d):
    folds = T.read(s, d, "orders").select((F.col("o_orderkey") % 5).alias("fold")).distinct()
    depths = s.createDataFrame([(3,), (5,), (7,)], "depth int")
    # Three short lists of settings.
    return folds.crossJoin(F.broadcast(depths)).crossJoin(F.broadcast(T.read(s, d, "part").select(F.col("p_type").alias("model")).distinct()))


@query("j14_neighbours", sql("cls", "SELECT a.cls, b.cls AS near, count(*) AS n FROM cls a JOIN cls b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY 1, 2"))
def _(s, d):
    return J.neighbours(T.cls(s, d), "cls").groupBy("cls", "near").agg(F.count(F.lit(1)).alias("n"))


@query("j15_resample_average", sql("dem", "SELECT CAST(floor(row / 3.0) AS INT) AS row, CAST(floor(col / 3.0) AS INT) AS col, round(avg(z), 6) AS z FROM dem GROUP BY 1, 2"))
def _(s, d):
    return J.resample(T.dem(s, d), "z", 3.0, "average").select("row", "col", r6("z"))


@query("j15_resample_mode", sql("cls", "SELECT row, col, cls FROM (SELECT CAST(floor(row / 4.0) AS INT) AS row, CAST(floor(col / 4.0) AS INT) AS col, cls, row_number() OVER (PARTITION BY floor(row / 4.0), floor(col / 4.0) ORDER BY count(*) DESC, cls) AS n FROM cls GROUP BY floor(row / 4.0), floor(col / 4.0), cls) WHERE n = 1"))
def _(s, d):
    return J.resample(T.cls(s, d), "cls", 4.0, "mode")


@query("j15_resample_nearest", sql("dem", "+ t AS (SELECT DISTINCT CAST(floor(row / 3.0) AS INT) AS row, CAST(floor(col / 3.0) AS INT) AS col FROM dem) SELECT t.row, t.col, round(z, 6) AS z FROM t JOIN dem ON dem.row = floor((t.row + 0.5) * 3) AND dem.col = floor((t.col + 0.5) * 3)"))
def _(s, d):
    return J.resample(T.dem(s, d), "z", 3.0, "nearest").select("row", "col", r6("z"))


@query("j15_bilinear", sql("dem pts", "+ p AS (SELECT id, x / 4 AS x, y / 2 AS y FROM pts WHERE y >= 0), q AS (SELECT id, floor(x - 0.5) AS c, floor(y - 0.5) AS r, x - 0.5 - floor(x - 0.5) AS u, y - 0.5 - floor(y - 0.5) AS v FROM p), o AS (SELECT unnest([0, 0, 1, 1]) AS dr, unnest([0, 1, 0, 1]) AS dc) SELECT id, round(sum(z * CASE dr WHEN 1 THEN v ELSE 1 - v END * CASE dc WHEN 1 THEN u ELSE 1 - u END), 6) AS z FROM q, o JOIN dem ON dem.row = q.r + o.dr AND dem.col = q.c + o.dc GROUP BY id HAVING count(*) = 4"))
def _(s, d):
    p = T.pts(s, d).where("y >= 0").select("id", (F.col("x") / 4).alias("x"), (F.col("y") / 2).alias("y"))
    return J.bilinear(p, T.dem(s, d), "z").select("id", r6("z"))


@query("j16_priority_overlay", sql("cls", "+ a AS (SELECT row, col, CASE WHEN cls = 1 THEN 10 ELSE 0 END AS v FROM cls), b AS (SELECT row, col, CASE WHEN (row + col) % 2 = 0 THEN 20 ELSE 0 END AS v FROM cls), c AS (SELECT row, col, 30 AS v FROM cls WHERE row % 3 = 0) SELECT row, col, coalesce(nullif(a.v, 0), nullif(b.v, 0), nullif(c.v, 0)) AS v FROM a FULL JOIN b USING (row, col) FULL JOIN c USING (row, col) WHERE coalesce(nullif(a.v, 0), nullif(b.v, 0), nullif(c.v, 0)) IS NOT NULL"))
def _(s, d):
    g = T.cls(s, d)
    a = g.select("row", "col", F.when(F.col("cls") == 1, 10).otherwise(0).alias("v"))
    b = g.select("row", "col", F.when((F.col("row") + F.col("col")) % 2 == 0, 20).otherwise(0).alias("v"))
    return J.priority_overlay([a, b, g.where("row % 3 = 0").select("row", "col", F.lit(30).alias("v"))], "v")


@query("j17_longest_border", sql("dem", "+ g AS (SELECT row, col, (row // 5) * 100 + col // 5 AS part FROM dem), e AS (SELECT a.part, b.part AS near, count(*) AS edges FROM g a JOIN g b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND a.part <> b.part GROUP BY 1, 2) SELECT part, near, edges FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY edges DESC, near) AS n FROM e) WHERE n = 1"))
def _(s, d):
    g = T.dem(s, d).withColumn("part", (F.floor(F.col("row") / 5) * 100 + F.floor(F.col("col") / 5)).cast("int"))
    return J.longest_border(g, "part")


# Aggregates


@query("a1_duplicate_pixels", sql("pts", "SELECT CAST(floor(y / 3) AS INT) AS row, CAST(floor(x / 3) AS INT) AS col, count(*) AS n, count(DISTINCT id % 4) AS n_classes FROM pts GROUP BY 1, 2 HAVING count(*) > 1"))
def _(s, d):
    p = T.pts(s, d).select(F.floor(F.col("y") / 3).cast("int").alias("row"), F.floor(F.col("x") / 3).cast("int").alias("col"), (F.col("id") % 4).alias("class_name"))
    return A.duplicates(p)


@query("a2_pixels_per_polygon", sql("bands", "SELECT id, polygon_id, count(*) OVER (PARTITION BY polygon_id) AS n_pixels FROM bands"))
def _(s, d):
    return T.bands(s, d).select("id", "polygon_id", F.count(F.lit(1)).over(W.partitionBy("polygon_id")).alias("n_pixels"))


@query("a3_class_frequency", sql("cls", "SELECT cls, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM cls GROUP BY cls"))
def _(s, d):
    return A.frequency(T.cls(s, d)).select("cls", "n", r6("percent"))


@query("a4_class_summary", sql("legend", "SELECT v, count(*) AS n_patches, round(sum(area) / 1e4, 3) AS ha, round(sum(area) * 100 / sum(sum(area)) OVER (), 6) AS share FROM legend GROUP BY v"))
def _(s, d):
    return A.class_summary(T.legend(s, d), "v", "area").select("v", "n_patches", r6("ha", 3), r6("share"))


@query("a5_two_way_matrix", sql("legend", "SELECT v, h, count(*) AS n, round(sum(area), 2) AS area FROM legend GROUP BY v, h"))
def _(s, d):
    return A.matrix(T.legend(s, d), "v", "h", "area").select("v", "h", "n", r6("area", 2))


@query("a6_fold_class_counts", sql("bands", "SELECT id % 5 AS fold, class_name AS cls, count(*) AS n FROM bands GROUP BY ROLLUP (id % 5, class_name)"))
def _(s, d):
    b = T.bands(s, d).select((F.col("id") % 5).alias("fold"), F.col("class_name").alias("cls"))
    return A.fold_counts(b, "fold", "cls")


_CONF = "c AS (SELECT o_orderkey % 4 AS truth, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 4 ELSE o_custkey % 4 END AS pred FROM orders), m AS (SELECT truth, pred, count(*)::DOUBLE AS n FROM c GROUP BY 1, 2), k AS (SELECT k AS cls, (SELECT coalesce(sum(n), 0) FROM m WHERE truth = k AND pred = k) AS tp, (SELECT coalesce(sum(n), 0) FROM m WHERE truth <> k AND pred = k) AS fp, (SELECT coalesce(sum(n), 0) FROM m WHERE truth = k AND pred <> k) AS fn, (SELECT sum(n) FROM m) AS total FROM (SELECT DISTINCT truth AS k FROM c UNION SELECT DISTINCT pred FROM c)), f AS (SELECT *, total - tp - fp - fn AS tn FROM k), g AS (SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, tn / greatest(tn + fp, 1) AS specificity FROM f), h AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM g)"


def _conf(s, d):
    o = T.read(s, d, "orders")
    return o.select((F.col("o_orderkey") % 4).alias("truth"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderkey") % 4).otherwise(F.col("o_custkey") % 4).alias("pred"))


@query("a7_confusion", f"WITH {_CONF} SELECT truth, pred, CAST(n AS BIGINT) AS n FROM m")
def _(s, d):
    return A.confusion(_conf(s, d))


@query("a8_overall_metrics", f"WITH {_CONF}, a AS (SELECT sum(tp) / max(total) AS oa, sum((tp + fn) * (tp + fp)) / (max(total) * max(total)) AS ch, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f, avg(specificity) AS sp FROM h) SELECT round(oa, 6) AS accuracy, round((oa - ch) / (1 - ch), 6) AS kappa, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(sp, 6) AS specificity, round((SELECT avg(recall) FROM h WHERE tp + fn > 0), 6) AS balanced, round(r + sp - 1, 6) AS tss FROM a")
def _(s, d):
    m = A.overall_metrics(A.confusion(_conf(s, d)))
    return m.select(*[r6(c) for c in ("accuracy", "kappa", "precision", "recall", "f1", "specificity", "balanced", "tss")])


@query("a9_class_metrics", f"WITH {_CONF} SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1, round((recall + specificity) / 2, 6) AS balanced FROM h")
def _(s, d):
    return A.class_metrics(A.confusion(_conf(s, d))).select("cls", *[r6(c) for c in ("precision", "recall", "specificity", "f1", "balanced")])


@query("a10_aic", sql("suit", "SELECT round(sum(-ln(greatest(suit, 1e-15))), 4) AS nll, round(2 * 12 + 2 * sum(-ln(greatest(suit, 1e-15))), 4) AS aic FROM suit"))
def _(s, d):
    return A.aic(T.suit(s, d), F.col("suit"), 12).select(r6("nll", 4), r6("aic", 4))


_AUC = "+ r AS (SELECT {t} AS t, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM {f}) SELECT round((sum(rk) FILTER (WHERE t = 1) - sum(t) * (sum(t) + 1) / 2.0::DOUBLE) / (sum(t) * (count(*) - sum(t))::DOUBLE), 6) AS auc, CAST(sum(t) AS BIGINT) AS n_pos, CAST(count(*) - sum(t) AS BIGINT) AS n_neg FROM r"


@query("a11_roc_auc", sql("pres", _AUC.format(t="pa", f="pres")))
def _(s, d):
    return A.roc_auc(T.pres(s, d), "pa", "score").select(r6("auc"), "n_pos", "n_neg")


@query("a11_roc_auc_labels", sql("scored", _AUC.format(t="truth", f="scored")))
def _(s, d):
    return A.roc_auc(T.scored(s, d), "truth", "score").select(r6("auc"), "n_pos", "n_neg")


_CURVE = "+ u AS (SELECT score, sum(pa)::DOUBLE AS p, count(*) - sum(pa)::DOUBLE AS q FROM pres GROUP BY score), v AS (SELECT score, p, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pos, sum(q) OVER () AS neg FROM u WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query("a12_average_precision", sql("pres", f"{_CURVE} SELECT round(sum(p / pos * tp / (tp + fp)), 6) AS average_precision FROM v"))
def _(s, d):
    return A.average_precision(T.pres(s, d), "pa", "score").select(r6("average_precision"))


@query("a13_max_tss", sql("pres", f"{_CURVE} SELECT round(score, 6) AS threshold, round(round(tp / pos - fp / neg, 12), 6) AS tss FROM v ORDER BY round(tp / pos - fp / neg, 12) DESC, score DESC LIMIT 1"))
def _(s, d):
    return A.max_tss(T.pres(s, d), "pa", "score").select(r6("threshold"), r6("tss"))


@query("a14_omission", sql("pres", "+ t AS (SELECT quantile_cont(score, 0.1) AS threshold FROM pres WHERE pa = 1) SELECT round(threshold, 6) AS threshold, round(avg(CASE WHEN score < threshold THEN 1.0::DOUBLE ELSE 0 END), 6) AS omission FROM pres, t WHERE pa = 1 GROUP BY threshold"))
def _(s, d):
    return A.omission(T.pres(s, d), "pa", "score").select(r6("threshold"), r6("omission"))


@query("a15_boyce", sql("scored", "+ e AS (SELECT min(score) AS lo, max(score) - min(score) AS span, sum(truth)::DOUBLE AS np, count(*)::DOUBLE AS n FROM scored), w AS (SELECT i, lo + i * span * 0.9::DOUBLE / 9 AS a, lo + i * span * 0.9::DOUBLE / 9 + span * 0.1::DOUBLE AS b, np, n FROM e, range(0, 10) t(i)), g AS (SELECT i, any_value((a + b) / 2) AS centre, (sum(truth) / any_value(np)) / (count(*) / any_value(n)) AS pe FROM w JOIN scored ON score BETWEEN a AND b GROUP BY i), r AS (SELECT rank() OVER (ORDER BY centre) + (count(*) OVER (PARTITION BY centre) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY pe) + (count(*) OVER (PARTITION BY pe) - 1) / 2.0::DOUBLE AS y FROM g) SELECT CASE WHEN count(*) >= 3 THEN round(corr(x, y), 6) END AS boyce, count(*) AS n_windows FROM r"))
def _(s, d):
    return A.boyce(T.scored(s, d), "truth", "score").select(r6("boyce"), "n_windows")


@query("a16_mean_sd_over_folds", sql("pres", "+ f AS (SELECT id % 5 AS fold, avg(score) AS m FROM pres GROUP BY 1) SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd FROM f"))
def _(s, d):
    f = T.pres(s, d).groupBy((F.col("id") % 5).alias("fold")).agg(F.avg("score").alias("m"))
    return f.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("sd"))


def _rank(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


@query("a17_spearman", sql("bands", "+ r AS (SELECT " + ", ".join(f"{_rank(f'b{i}')} AS r{i}" for i in range(4)) + " FROM bands) " + " UNION ALL ".join(f"SELECT 'b{i}' AS a, 'b{j}' AS b, round(corr(r{i}, r{j}), 6) AS rho FROM r" for i in range(4) for j in range(i + 1, 4))))
def _(s, d):
    return A.spearman(T.bands(s, d), ["b0", "b1", "b2", "b3"]).select("a", "b", r6("rho"))


@query("a18_kruskal_wallis", sql("bands_long", "+ r AS (SELECT layer, label, rank() OVER (PARTITION BY layer ORDER BY value) + (count(*) OVER (PARTITION BY layer, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY layer, value) AS t FROM bands_long), g AS (SELECT layer, label, sum(rk) AS r, count(*) AS m FROM r GROUP BY 1, 2), n AS (SELECT layer, count(*)::DOUBLE AS n, sum(t::DOUBLE * t - 1) AS t FROM r GROUP BY 1) SELECT layer, round((12 / (any_value(n) * (any_value(n) + 1)) * sum(r * r / m) - 3 * (any_value(n) + 1)) / (1 - any_value(t) / (any_value(n) * any_value(n) * any_value(n) - any_value(n))), 4) AS h, count(*) AS k FROM g JOIN n USING (layer) GROUP BY layer"))
def _(s, d):
    return A.kruskal_wallis(T.bands_long(s, d)).select("layer", r6("h", 4), "k")


@query("a19_medians", sql("bands_long", "+ g AS (SELECT layer, label, count(*) AS n, quantile_cont(value, 0.5) AS median FROM bands_long WHERE layer < 8 GROUP BY 1, 2), k AS (SELECT *, greatest(1, CAST(floor(n / 2.0::DOUBLE - 1.959963984540054 * sqrt(n) / 2) AS BIGINT)) AS k, least(n, CAST(ceil(n / 2.0::DOUBLE + 1.959963984540054 * sqrt(n) / 2 + 1) AS BIGINT)) AS j FROM g), v AS (SELECT layer, label, value, row_number() OVER (PARTITION BY layer, label ORDER BY value) AS i FROM bands_long WHERE layer < 8) SELECT layer, label, n, round(median, 6) AS median, round(max(value) FILTER (WHERE i = k), 6) AS lower, round(max(value) FILTER (WHERE i = j), 6) AS upper FROM k JOIN v USING (layer, label) GROUP BY layer, label, n, median"))
def _(s, d):
    return A.medians(T.bands_long(s, d).where("layer < 8"), ("layer", "label"), "value").select("layer", "label", "n", r6("median"), r6("lower"), r6("upper"))


@query("a20_near_zero_variance", """WITH l AS (SELECT 0 AS layer, CAST(l_linenumber AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 1, CASE WHEN l_orderkey % 50 = 0 THEN 1.0 ELSE 0.0 END FROM lineitem UNION ALL SELECT 2, l_extendedprice FROM lineitem UNION ALL SELECT 3, 5.0 FROM lineitem),
n AS (SELECT layer, value, count(*) AS n FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n DESC) AS i FROM n), a AS (SELECT layer, count(*) AS n_unique, sum(n) AS rows, max(n) FILTER (WHERE i = 1) AS first, max(n) FILTER (WHERE i = 2) AS second FROM r GROUP BY 1), b AS (SELECT layer, n_unique, CASE WHEN second IS NULL THEN 0 ELSE first / second::DOUBLE END AS fr, 100.0::DOUBLE * n_unique / rows AS pu FROM a)
SELECT layer, n_unique, round(fr, 6) AS freq_ratio, round(pu, 6) AS percent_unique, n_unique <= 1 OR (fr >= 19 AND pu <= 10) AS nzv FROM b""")
def _(s, d):
    li = T.read(s, d, "lineitem")
    v = [F.col("l_linenumber").cast("double"), F.when(F.col("l_orderkey") % 50 == 0, 1.0).otherwise(0.0), F.col("l_extendedprice"), F.lit(5.0)]
    long = li.select(F.posexplode(F.array(*v)).alias("layer", "value"))
    return A.near_zero_variance(long).select("layer", "n_unique", r6("freq_ratio"), r6("percent_unique"), "nzv")


@query("a26_class_constants", "SELECT n_regionkey AS cls, CASE WHEN count(DISTINCT r_name) = 1 THEN max(r_name) END AS r_name, CASE WHEN count(DISTINCT n_name) = 1 THEN max(n_name) END AS n_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(s, d):
    n = T.read(s, d, "nation").join(T.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.class_constants(n.withColumn("cls", F.col("n_regionkey")), "cls", ["r_name", "n_name"])


@query("a27_ensemble", "WITH s AS (SELECT o_custkey % 100 AS k, o_orderstatus AS model, avg(o_totalprice) / 5e5 AS suit FROM orders GROUP BY 1, 2), w AS (SELECT unnest(['F', 'O', 'P']) AS model, unnest([0.8, 0.65, 0.4])::DOUBLE AS auc) SELECT k, CASE WHEN count(suit) = 3 THEN round(sum(greatest(auc - 0.5, 0) * suit) / sum(greatest(auc - 0.5, 0)), 6) END AS suit FROM s JOIN w USING (model) GROUP BY k")
def _(s, d):
    m = T.read(s, d, "orders").groupBy((F.col("o_custkey") % 100).alias("k"), F.col("o_orderstatus").alias("model")).agg((F.avg("o_totalprice") / 5e5).alias("suit"))
    w = s.createDataFrame([("F", 0.8), ("O", 0.65), ("P", 0.4)], "model string, auc double")
    return A.ensemble(m, w, "k", 3).select("k", r6("suit"))


@query("a28_balanced_weights", sql("bands", "+ n AS (SELECT id, class_name, count(*) OVER (PARTITION BY polygon_id) AS px FROM bands), b AS (SELECT class_name, sum(px ** -0.5) AS base, count(*) AS m FROM n GROUP BY 1) SELECT id, class_name, round(px ** -0.5 / base * (SELECT sum(m) / count(*)::DOUBLE FROM b), 6) AS weight FROM n JOIN b USING (class_name)"))
def _(s, d):
    n = T.bands(s, d).withColumn("n_pixels", F.count(F.lit(1)).over(W.partitionBy("polygon_id")).cast("double"))
    return A.balanced_weights(n, "class_name", "n_pixels").select("id", "class_name", r6("weight"))


@query("a29_majority_vote", sql("cls", "+ g AS (SELECT row, col, cls, (row // 4) * 100 + col // 4 AS comp FROM cls), n AS (SELECT a.comp, b.cls AS near, count(*) AS n FROM g a JOIN g b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND a.comp <> b.comp GROUP BY 1, 2) SELECT comp, near AS vote, n FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY n DESC, near DESC) AS i FROM n) WHERE i = 1"))
def _(s, d):
    from ..operators.lattice import majority_vote

    g = T.cls(s, d).withColumn("comp", (F.floor(F.col("row") / 4) * 100 + F.floor(F.col("col") / 4)).cast("int"))
    return majority_vote(g, "comp", "cls")


@query("a30_block_summary", sql("bands", "SELECT (row // 4) * 10 + col // 5 AS block, count(*) AS n, count(DISTINCT class_name) AS n_classes, list_aggregate(list_sort(list(DISTINCT class_name)), 'string_agg', ',') AS classes FROM bands GROUP BY 1"))
def _(s, d):
    b = T.bands(s, d).withColumn("block", (F.floor(F.col("row") / 4) * 10 + F.floor(F.col("col") / 5)).cast("int"))
    return b.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("class_name").alias("n_classes"), F.array_join(F.array_sort(F.collect_set("class_name")).cast("array<string>"), ",").alias("classes"))


@query("a31_otsu", "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT lo, hi, least(CAST(floor((o_totalprice - lo) / (hi - lo) * 256) AS BIGINT), 255) AS bin, count(*)::DOUBLE AS n FROM orders, e GROUP BY 1, 2, 3), c AS (SELECT lo, hi, bin, sum(n) OVER w AS w0, sum(n * bin) OVER w AS s0, sum(n) OVER () AS w, sum(n * bin) OVER () AS s FROM b WINDOW w AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)) SELECT round(lo + (bin + 1) * (hi - lo) / 256, 4) AS threshold FROM c WHERE w > w0 ORDER BY round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) ** 2, 3) DESC, bin LIMIT 1")
def _(s, d):
    return A.otsu(T.read(s, d, "orders"), "o_totalprice").select(r6("threshold", 4))


@query("a32_mahalanobis", sql("bands", "+ m AS (SELECT avg(b0) AS m0, avg(b1) AS m1, var_samp(b0) AS v0, var_samp(b1) AS v1, covar_samp(b0, b1) AS c FROM bands WHERE class_name = 0) SELECT id, round(((b0 - m0) ** 2 * v1 - 2 * (b0 - m0) * (b1 - m1) * c + (b1 - m1) ** 2 * v0) / (v0 * v1 - c * c), 5) AS d2 FROM bands, m"))
def _(s, d):
    return A.mahalanobis(T.bands(s, d), ["b0", "b1"], F.col("class_name") == 0).select("id", r6("d2", 5))


@query("a33_stretch", sql("dem", "+ p AS (SELECT quantile_cont(z, 0.02) AS p, quantile_cont(z, 0.98) AS q FROM dem) SELECT row, col, round(greatest(0, least(1, (z - p) / greatest(q - p, 1e-12))), 6) AS stretched FROM dem, p"))
def _(s, d):
    return A.stretch(T.dem(s, d), "z").select("row", "col", r6("stretched"))


@query("a35_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def _(s, d):
    return T.read(s, d, "customer").select("c_mktsegment", "c_nationkey").distinct()


# Windows


@query("w1_keep_first_per_pixel", sql("pts", "SELECT id, CAST(floor(y / 3) AS INT) AS row, CAST(floor(x / 3) AS INT) AS col FROM pts QUALIFY row_number() OVER (PARTITION BY floor(y / 3), floor(x / 3) ORDER BY id % 7, (x - 48) ** 2 + (y - 45) ** 2, id) = 1"))
def _(s, d):
    p = T.pts(s, d).select("id", "x", "y", F.floor(F.col("y") / 3).cast("int").alias("row"), F.floor(F.col("x") / 3).cast("int").alias("col"))
    return V.keep_first(p, ["row", "col"], F.col("id") % 7, (F.col("x") - 48) ** 2 + (F.col("y") - 45) ** 2, F.col("id")).select("id", "row", "col")


@query("w2_one_point_per_pixel", sql("pts", "SELECT min(id) AS id, x, y FROM pts GROUP BY x, y"))
def _(s, d):
    return V.keep_first(T.pts(s, d), ["x", "y"], F.col("id")).select("id", "x", "y")


@query("w4_suffixed_ids", "SELECT c_custkey, CASE WHEN n > 0 THEN name || '_' || CAST(n AS VARCHAR) ELSE name END AS name FROM (SELECT c_custkey, c_mktsegment || CAST(c_nationkey AS VARCHAR) AS name, row_number() OVER (PARTITION BY c_mktsegment || CAST(c_nationkey AS VARCHAR) ORDER BY c_custkey) - 1 AS n FROM customer)")
def _(s, d):
    c = T.read(s, d, "customer").select("c_custkey", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"))
    return V.suffixed(c, "name", "c_custkey")


@query("w5_best_cut", """WITH p AS (SELECT c_custkey AS id, c_nationkey AS g, CAST(c_custkey AS DOUBLE) AS x, c_acctbal AS y FROM customer), e AS (SELECT g, x, min(x) OVER l AS xl0, max(x) OVER l AS xl1, min(y) OVER l AS yl0, max(y) OVER l AS yl1, min(x) OVER r AS xr0, max(x) OVER r AS xr1, min(y) OVER r AS yr0, max(y) OVER r AS yr1, min(x) OVER a AS x0, max(x) OVER a AS x1, min(y) OVER a AS y0, max(y) OVER a AS y1 FROM p WINDOW l AS (PARTITION BY g ORDER BY x, id ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY g ORDER BY x, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), a AS (PARTITION BY g)),
s AS (SELECT g, x, (x1 - x0) * (y1 - y0) - (xl1 - xl0) * (yl1 - yl0) - (xr1 - xr0) * (yr1 - yr0) AS saving FROM e WHERE xr0 IS NOT NULL) SELECT g, x AS cut, round(saving, 2) AS saving FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(saving, 6) DESC, x) = 1""")
def _(s, d):
    p = T.read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    return V.best_cut(p, "g", "x").select("g", "cut", r6("saving", 2))


@query("w6_average_ranks", sql("pres", "SELECT id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS avg_rank FROM pres"))
def _(s, d):
    p = T.pres(s, d)
    return p.join(A.average_ranks(p, "score"), "score").select("id", "avg_rank")


@query("w7_argmax_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def _(s, d):
    c = T.read(s, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct(-F.col("c_acctbal"), F.col("c_custkey"))).alias("c_custkey"), F.max("c_acctbal").alias("c_acctbal"))
    return c


@query("w8_last_per_token", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(s, d):
    return V.keep_last(T.read(s, d, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("w13_model_ranking", "WITH m AS (SELECT p_brand AS model, avg(p_retailprice) AS aic, avg(p_size) AS f1 FROM part GROUP BY 1) SELECT model, round(aic - min(aic) OVER (), 6) AS delta, row_number() OVER (ORDER BY round(f1, 9) DESC, model) AS place FROM m")
def _(s, d):
    m = T.read(s, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.avg("p_retailprice").alias("aic"), F.round(F.avg("p_size"), 9).alias("f1"))
    return V.ranked(m.withColumn("delta", F.col("aic") - F.min("aic").over(W.partitionBy())), {"f1": True, "model": False}).select("model", r6("delta"), F.col("place").cast("long").alias("place"))


# Sorts, samples, sets


@query("t1_block_order", sql("bands", "+ b AS (SELECT (row // 4) * 10 + col // 5 AS block, count(*) AS n, count(DISTINCT class_name) AS k FROM bands GROUP BY 1) SELECT block, row_number() OVER (ORDER BY k DESC, n DESC, block) AS place FROM b"))
def _(s, d):
    b = T.bands(s, d).withColumn("block", (F.floor(F.col("row") / 4) * 10 + F.floor(F.col("col") / 5)).cast("int"))
    g = b.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("class_name").alias("k"))
    return V.ranked(g, {"k": True, "n": True, "block": False}).select("block", F.col("place").cast("long").alias("place"))


@query("t2_top_pairs", "WITH i AS (SELECT p_type AS cls, p_brand AS feature, sum(p_retailprice) AS imp FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round(imp, 4) DESC, feature) AS k FROM i) SELECT cls, feature, round(imp, 4) AS imp FROM r ORDER BY k > 1, round(imp, 4) DESC, cls, feature LIMIT 10")
def _(s, d):
    i = T.read(s, d, "part").groupBy(F.col("p_type").alias("cls"), F.col("p_brand").alias("feature")).agg(F.round(F.sum("p_retailprice"), 4).alias("imp"))
    k = F.row_number().over(W.partitionBy("cls").orderBy(F.desc("imp"), "feature"))
    return i.withColumn("k", k).orderBy(F.col("k") > 1, F.desc("imp"), "cls", "feature").limit(10).drop("k")


@query("t3_numeric_first", "WITH k AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS key FROM part) SELECT key, row_number() OVER (ORDER BY try_cast(key AS DOUBLE) IS NULL, try_cast(key AS DOUBLE), lower(key)) AS place FROM k")
def _(s, d):
    k = T.read(s, d, "part").select(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand")).alias("key")).distinct()
    return k.withColumn("place", F.row_number().over(W.orderBy(*V.numeric_first(F.col("key")))).cast("long"))  # a legend's keys


@query("t4_seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500")
def _(s, d):
    return V.sample_n(T.read(s, d, "orders"), 500, 42, "o_orderkey").select("o_orderkey")


@query("t5_weighted_sample", "SELECT o_orderkey FROM orders WHERE o_totalprice > 0 ORDER BY -ln((('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / o_totalprice, o_orderkey LIMIT 300")
def _(s, d):
    return V.weighted_sample(T.read(s, d, "orders"), 300, "o_totalprice", 42, "o_orderkey").select("o_orderkey")


@query("t6_whole_groups", "WITH RECURSIVE g AS (SELECT l_suppkey AS chip, count(*) AS n, row_number() OVER (ORDER BY l_suppkey) AS i FROM lineitem GROUP BY 1), r AS (SELECT i, CASE WHEN n <= 2000 THEN 2000 - n ELSE 2000 END AS rest, n <= 2000 AS took FROM g WHERE i = 1 UNION ALL SELECT g.i, CASE WHEN g.n <= r.rest THEN r.rest - g.n ELSE r.rest END, g.n <= r.rest FROM r JOIN g ON g.i = r.i + 1) SELECT chip, n FROM g JOIN r USING (i) WHERE took")
def _(s, d):
    g = T.read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("chip")).agg(F.count(F.lit(1)).alias("n"))
    return V.whole_groups(g, "n", [F.col("chip")], 2000)


@query("s1_union_by_name", "SELECT id, pa, x, y, CAST(NULL AS DOUBLE) AS w FROM (SELECT event_id AS id, 1 AS pa, CAST(user_id AS DOUBLE) AS x, value AS y FROM events WHERE event_type = 'purchase') UNION ALL SELECT event_id, 0, CAST(user_id AS DOUBLE), NULL, value FROM events WHERE event_type = 'view'")
def _(s, d):
    e = T.read(s, d, "events")
    a = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.lit(1).alias("pa"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))
    b = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.lit(0).alias("pa"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("w"))
    return a.unionByName(b, allowMissingColumns=True)


@query("s2_intersect_except", "(SELECT l_partkey AS k, 'both' AS side FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, 'both' FROM lineitem WHERE l_returnflag = 'R') UNION ALL (SELECT l_partkey, 'only' FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, 'only' FROM lineitem WHERE l_returnflag = 'R')")
def _(s, d):
    li = T.read(s, d, "lineitem")
    a, r = (li.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("k")) for x in "AR")
    return a.intersect(r).withColumn("side", F.lit("both")).unionByName(a.subtract(r).withColumn("side", F.lit("only")))


@query("s3_missing_classes", sql("bands", "+ f AS (SELECT DISTINCT polygon_id % 10 AS fold FROM bands), c AS (SELECT DISTINCT class_name FROM bands) SELECT fold, class_name FROM f, c EXCEPT SELECT polygon_id % 10, class_name FROM bands"))
def _(s, d):
    b = T.bands(s, d).select((F.col("polygon_id") % 10).alias("fold"), "class_name").distinct()
    # Ten folds by a legend's classes.
    return b.select("fold").distinct().crossJoin(b.select("class_name").distinct()).subtract(b)


@query("s4_shared_groups", sql("bands", "SELECT polygon_id, count(DISTINCT id % 3) AS n_folds FROM bands GROUP BY 1 HAVING count(DISTINCT id % 3) > 1"))
def _(s, d):
    return V.shared_groups(T.bands(s, d).withColumn("fold", F.col("id") % 3), "polygon_id", "fold")


@query("s5_cell_sets", sql("cls zones", f"+{_TOUCHED}, a AS (SELECT row, col FROM cls WHERE cls = 1), b AS (SELECT DISTINCT row, col FROM touched) SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"))
def _(s, d):
    a = T.cls(s, d).where("cls = 1").select("row", "col")
    b = J.cells_of_boxes(T.zones(s, d)).select("row", "col")
    mark = lambda df, x, y: df.select("row", "col", F.lit(x).alias("a"), F.lit(y).alias("b"))
    cells = mark(a, True, False).unionByName(mark(b, False, True)).groupBy("row", "col").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    n = cells.agg(F.count(F.lit(1)).alias("union"), F.count_if(F.expr("a AND b")).alias("intersect"), F.count_if(F.expr("a AND NOT b")).alias("except"))
    return n.select(F.inline(F.array(*[F.struct(F.lit(c).alias("op"), F.col(c).alias("n")) for c in ("union", "intersect", "except")])))


@query("s6_upsert", "SELECT c_custkey AS key, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(s, d):
    old = T.read(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    return V.upsert(old, T.read(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("v")), "key")
