"""Queries over codes, legends, geometry, models and ledgers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import indices as I
from ..operators import aggregates as A
from ..operators import geometry as G
from ..operators import models as M
from ..operators import windows as V
from ..sources import tables as T
from ..sources.tables import sql
from ..streaming import ledger as S
from .core_queries import r6

Q: dict[str, tuple] = {}


def query(name: str, text: str | None = None):
    def add(f):
        Q[name] = (f, text)
        return f

    return add


# Codes and names

_KEYS = "k AS (SELECT o_orderkey AS id, CASE o_custkey % 6 WHEN 0 THEN '00' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR) || '.0' WHEN 2 THEN ' nan' WHEN 3 THEN '' WHEN 4 THEN o_orderpriority || ' ' ELSE CAST(o_custkey AS VARCHAR) || '.5' END AS key FROM orders)"
_NORM = "CASE WHEN lower(trim(key)) IN ('', 'nan', 'none', 'null') THEN NULL WHEN regexp_full_match(trim(key), '[+-]?[0-9]+([.]0*)?') THEN CAST(CAST(regexp_extract(trim(key), '^([+-]?[0-9]+)', 1) AS BIGINT) AS VARCHAR) ELSE trim(key) END"


def _keys(s, d):
    o, k = T.read(s, d, "orders"), F.col("o_custkey").cast("string")
    m = F.col("o_custkey") % 6
    return o.select(F.col("o_orderkey").alias("id"), F.when(m == 0, F.concat(F.lit("00"), k)).when(m == 1, F.concat(k, F.lit(".0"))).when(m == 2, " nan").when(m == 3, "").when(m == 4, F.concat("o_orderpriority", F.lit(" "))).otherwise(F.concat(k, F.lit(".5"))).alias("key"))


@query("st1_norm_key", f"WITH {_KEYS} SELECT id, {_NORM} AS key FROM k")
def _(s, d):
    return _keys(s, d).select("id", C.norm_key(F.col("key")).alias("key"))


@query("st2_parse_code", "WITH c AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS t FROM orders) SELECT id, CASE WHEN length(t) > 1 THEN CAST(CAST(substr(t, 1, 1) AS BIGINT) AS VARCHAR) END AS v, CASE WHEN length(t) > 1 THEN CAST(CAST(substr(t, 2) AS BIGINT) AS VARCHAR) END AS h, CASE WHEN length(t) > 2 THEN CAST(CAST(substr(t, 1, length(t) - 2) AS BIGINT) AS VARCHAR) END AS v2, CASE WHEN length(t) > 2 THEN CAST(CAST(right(t, 2) AS BIGINT) AS VARCHAR) END AS h2 FROM c")
def _(s, d):
    c = T.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("t"))
    (v, h), (v2, h2) = C.parse_code(F.col("t"), "first", 1), C.parse_code(F.col("t"), "last", 2)
    return c.select("id", v.alias("v"), h.alias("h"), v2.alias("v2"), h2.alias("h2"))


@query("st2_parse_separated", "SELECT o_orderkey AS id, CASE WHEN contains(o_orderpriority, '-') THEN split_part(o_orderpriority, '-', 1) END AS v, CASE WHEN contains(o_orderpriority, '-') THEN substr(o_orderpriority, instr(o_orderpriority, '-') + 1) END AS h FROM orders")
def _(s, d):
    v, h = C.parse_code(F.col("o_orderpriority"), "sep", sep="-")
    return T.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), v.alias("v"), h.alias("h"))


@query("st3_display", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.2f', p_retailprice), '0+$', ''), '[.]$', '') END AS shown FROM part")
def _(s, d):
    p = T.read(s, d, "part")
    v = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).otherwise(F.col("p_retailprice").cast("string"))
    return p.select("p_partkey", C.display(v).alias("shown"))


@query("st4_safe_names", "SELECT DISTINCT regexp_replace(p_type || ' / ' || p_brand, '[^A-Za-z0-9_]+', '_', 'g') AS name FROM part")
def _(s, d):
    return T.read(s, d, "part").select(C.safe_name(F.concat_ws(" / ", "p_type", "p_brand")).alias("name")).distinct()


@query("st8_recode_log", "SELECT l_orderkey, l_linenumber, CASE WHEN n = 9 THEN 1 ELSE n END AS code FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2) THEN 9 WHEN l_linenumber = 3 THEN 7 ELSE l_linenumber END AS n FROM lineitem)")
def _(s, d):
    log = [("merge", (1, 2), 9), ("renumber", (3,), 7), ("renumber", (9,), 1)]
    return T.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", C.recode(F.col("l_linenumber"), log).alias("code"))


@query("st9_signature", "SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority) AS sig FROM orders")
def _(s, d):
    return T.read(s, d, "orders").select("o_orderkey", C.signature(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("sig"))


@query("st10_quadkeys", "WITH t AS (SELECT DISTINCT l_partkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem) SELECT x, y, array_to_string([CAST(((x >> (6 - i)) & 1) + 2 * ((y >> (6 - i)) & 1) AS VARCHAR) for i in range(1, 7)], '') AS quadkey FROM t")
def _(s, d):
    t = T.read(s, d, "lineitem").select((F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")).distinct()
    return t.select("x", "y", C.quadkey(F.col("x"), F.col("y"), F.lit(6)).alias("quadkey"))


@query("st11_categorical_layers", f"SELECT p_name AS name, lower(p_brand) || CASE p_partkey % 4 WHEN 0 THEN '_LULC' WHEN 1 THEN '_cat' WHEN 2 THEN '_slope' ELSE '_category_2' END AS layer, regexp_matches(lower(p_brand) || CASE p_partkey % 4 WHEN 0 THEN '_LULC' WHEN 1 THEN '_cat' WHEN 2 THEN '_slope' ELSE '_category_2' END, '{C.CATEGORICAL}') AS categorical FROM part")
def _(s, d):
    k = F.col("p_partkey") % 4
    layer = F.concat(F.lower("p_brand"), F.when(k == 0, "_LULC").when(k == 1, "_cat").when(k == 2, "_slope").otherwise("_category_2"))
    return T.read(s, d, "part").select(F.col("p_name").alias("name"), layer.alias("layer")).withColumn("categorical", C.is_categorical(F.col("layer")))


_COLOUR = "c AS (SELECT p_partkey, '#' || upper(substr(md5(p_brand), 1, 6)) AS colour FROM part)"


@query("st12_hex_colours", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '#' || upper(substr(md5(p_brand), 1, 6)) END AS colour FROM part")
def _(s, d):
    h = F.substring(F.md5("p_brand"), 1, 6)
    return T.read(s, d, "part").select("p_partkey", C.hex_colour(F.when(F.col("p_partkey") % 3 == 0, "no colour").when(F.col("p_partkey") % 3 == 1, h).otherwise(F.concat(F.lit(" #"), h))).alias("colour"))


def _chan(i: int) -> str:
    return f"CAST('0x' || substr(colour, {2 + 2 * i}, 2) AS INT)"


@query("m34_tones", f"WITH {_COLOUR} SELECT p_partkey, " + ", ".join("'#' || " + " || ".join(f"upper(printf('%02x', CAST(floor({_chan(i)} + ({to} - {_chan(i)}) * 0.25::DOUBLE + 0.5::DOUBLE) AS INT)))" for i in range(3)) + f" AS {n}" for n, to in (("tint", 255), ("shade", 0), ("grey", 128))) + f", round((0.299::DOUBLE * {_chan(0)} + 0.587::DOUBLE * {_chan(1)} + 0.114::DOUBLE * {_chan(2)}) / 255, 6) AS luminance FROM c")
def _(s, d):
    c = T.read(s, d, "part").select("p_partkey", F.concat(F.lit("#"), F.upper(F.substring(F.md5("p_brand"), 1, 6))).alias("colour"))
    return c.select("p_partkey", *[C.tone(F.col("colour"), F.lit(0.25), m).alias(m) for m in ("tint", "shade", "grey")], F.round(C.luminance(F.col("colour")), 6).alias("luminance"))


@query("st14_labels", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) || ' — ' || n_name AS label FROM nation")
def _(s, d):
    return T.read(s, d, "nation").select("n_nationkey", C.label(F.col("n_nationkey"), F.col("n_name")).alias("label"))


@query("st15_names_from_text", "WITH t AS (SELECT string_agg(CAST(n_nationkey AS VARCHAR) || '=' || n_name, ';') AS text FROM nation) SELECT s_suppkey, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(s, d):
    n = T.read(s, d, "nation")
    text = n.agg(F.array_join(F.collect_list(F.concat_ws("=", F.col("n_nationkey").cast("string"), "n_name")), ";").alias("text"))  # a legend's names
    return T.read(s, d, "supplier").crossJoin(F.broadcast(text)).select("s_suppkey", F.element_at(F.str_to_map("text", F.lit(";"), F.lit("=")), F.col("s_nationkey").cast("string")).alias("name"))


@query("m29_bands_of_scores", "SELECT s_suppkey, CASE WHEN s_acctbal / 10000 >= 0.9 THEN 'excellent' WHEN s_acctbal / 10000 >= 0.8 THEN 'good' WHEN s_acctbal / 10000 >= 0.7 THEN 'fair' ELSE 'poor' END AS band FROM supplier")
def _(s, d):
    return T.read(s, d, "supplier").select("s_suppkey", C.accuracy_band(F.col("s_acctbal") / 10000).alias("band"))


@query("dt1_run_stamps", "WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%d%m%y') || '_0930' AS run FROM orders WHERE year(o_orderdate) >= 2000) SELECT o_orderkey, strftime(strptime(run, '%d%m%y_%H%M'), '%Y-%m-%d %H:%M') AS started FROM r")
def _(s, d):
    r = T.read(s, d, "orders").where(F.year("o_orderdate") >= 2000).select("o_orderkey", F.concat(F.date_format("o_orderdate", "ddMMyy"), F.lit("_0930")).alias("run"))
    return r.select("o_orderkey", F.date_format(F.to_timestamp("run", "ddMMyy_HHmm"), "yyyy-MM-dd HH:mm").alias("started"))


@query("json1_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return T.read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("arr1_band_vectors", sql("bands", "SELECT id, round(b0 + b1 + b2 + b3, 5) AS total FROM bands"))
def _(s, d):
    v = T.bands(s, d).select("id", F.array("b0", "b1", "b2", "b3").alias("v"))
    return v.select("id", F.posexplode("v").alias("i", "x")).groupBy("id").agg(F.round(F.sum("x"), 5).alias("total"))


@query("arr2_rle_cells", "WITH r AS (SELECT o_orderkey AS id, [o_custkey % 5, o_custkey % 3 + 1, 4, 2] AS c FROM orders WHERE o_orderkey % 10 = 1) SELECT id, c[1] AS start, c[2] AS length FROM r UNION ALL SELECT id, c[1] + c[2] + c[3], c[4] FROM r")
def _(s, d):
    r = T.read(s, d, "orders").where("o_orderkey % 10 = 1").select(F.col("o_orderkey").alias("id"), F.array((F.col("o_custkey") % 5).cast("int"), (F.col("o_custkey") % 3 + 1).cast("int"), F.lit(4), F.lit(2)).alias("c"))
    return r.select("id", F.inline(G.decode_rle(F.col("c")))).withColumns({c: F.col(c).cast("long") for c in ("start", "length")})


@query("arr3_members", "SELECT c_nationkey, count(*) AS n_points, md5(string_agg(CAST(c_custkey AS VARCHAR), '|' ORDER BY c_custkey)) AS key FROM customer GROUP BY 1")
def _(s, d):
    m = T.read(s, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_points"), F.sort_array(F.collect_list("c_custkey")).alias("m"))
    return m.select("c_nationkey", "n_points", F.md5(F.array_join(F.col("m").cast("array<string>"), "|")).alias("key"))


@query("map1_class_columns", "SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.3 END::DOUBLE AS p FROM supplier")
def _(s, d):
    m = F.map_from_arrays(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)))
    return T.read(s, d, "supplier").select("s_suppkey", F.element_at(m, F.col("s_nationkey") % 3).alias("p"))


# Legends


@query("io21_legend_sheet", sql("legend", "SELECT v, count(*) FILTER (WHERE h = '1-URGENT') AS urgent, count(*) FILTER (WHERE h = '5-LOW') AS low, count(*) AS total FROM legend GROUP BY v"))
def _(s, d):
    p = T.legend(s, d).groupBy("v").pivot("h", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).count()
    cols = [c for c in p.columns if c != "v"]
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in cols[1:]), F.coalesce(F.col(f"`{cols[0]}`"), F.lit(0)))
    return p.select("v", F.coalesce(F.col("`1-URGENT`"), F.lit(0)).alias("urgent"), F.coalesce(F.col("`5-LOW`"), F.lit(0)).alias("low"), total.alias("total"))


@query("a5_matrix_of_codes", sql("legend", "+ c AS (SELECT CAST(code AS VARCHAR) AS t, area FROM legend), p AS (SELECT CASE WHEN length(t) > 1 THEN substr(t, 1, 1) END AS v, CASE WHEN length(t) > 1 THEN CAST(CAST(substr(t, 2) AS BIGINT) AS VARCHAR) END AS h, area FROM c) SELECT v, h, count(*) AS n, round(sum(area), 2) AS area FROM p WHERE v IS NOT NULL GROUP BY v, h"))
def _(s, d):
    v, h = C.parse_code(F.col("code"), "first", 1)
    m = A.matrix(T.legend(s, d).select(v.alias("v"), h.alias("h"), "area").where("v IS NOT NULL"), "v", "h", "area")
    return m.select("v", "h", "n", r6("area", 2))


# Geometry


@query("ge1_world_to_pixel", sql("pts", "SELECT id, CAST(floor((100 - y) / 2.5::DOUBLE) AS INT) AS row, CAST(floor((x - 10) / 2.5::DOUBLE) AS INT) AS col, 10 + (floor((x - 10) / 2.5::DOUBLE) + 0.5::DOUBLE) * 2.5::DOUBLE AS cx FROM pts"))
def _(s, d):
    row, col = G.to_pixel(F.col("x"), F.col("y"), 10.0, 100.0, 2.5)
    p = T.pts(s, d).select("id", row.alias("row"), col.alias("col"))
    return p.withColumn("cx", G.pixel_centre(F.col("row"), F.col("col"), 10.0, 100.0, 2.5)[0])


_LL = "p AS (SELECT c_custkey AS id, CAST(c_custkey % 360 AS DOUBLE) - 180 + 0.5::DOUBLE AS lon, c_acctbal / 150 AS lat FROM customer WHERE c_acctbal BETWEEN -9000 AND 9000)"


def _ll(s, d):
    c = T.read(s, d, "customer").where("c_acctbal BETWEEN -9000 AND 9000")
    return c.select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 360).cast("double") - 180 + 0.5).alias("lon"), (F.col("c_acctbal") / 150).alias("lat"))


@query("ge2_mercator", f"WITH {_LL} SELECT id, round(lon / 180 * pi() * 6378137.0::DOUBLE, 3) AS mx, round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0::DOUBLE, 3) AS my FROM p")
def _(s, d):
    x, y = G.mercator(F.col("lon"), F.col("lat"))
    return _ll(s, d).select("id", (F.round(x, 3) + 0.0).alias("mx"), (F.round(y, 3) + 0.0).alias("my"))


@query("ge2_utm")
def _(s, d):
    p = _ll(s, d).withColumn("zone", G.utm_zone(F.col("lon")))
    e, n = G.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    return p.select("id", "zone", e.alias("easting"), n.alias("northing"))


@query("ge4_pixel_area", sql("cls", "SELECT cls, round(count(*) * 0.0009::DOUBLE * 111320 * 111320 * 0.0009::DOUBLE * cos(radians(45.0)) / 1e4, 4) AS ha FROM cls GROUP BY cls"))
def _(s, d):
    from ..operators.dynamics import pixel_area_ha

    return T.cls(s, d).groupBy("cls").agg(F.round(F.count(F.lit(1)) * pixel_area_ha(0.0009, 0.0009, 45.0), 4).alias("ha"))


@query("ge5_chip_extents", "SELECT c_nationkey AS chip, min(c_custkey) - 25.0 AS x0, max(c_custkey) + 25.0 AS x1, round(min(c_acctbal) - 25, 2) AS y0, round(max(c_acctbal) + 25, 2) AS y1 FROM customer GROUP BY 1".replace("25.0 ", "25.0::DOUBLE "))
def _(s, d):
    c = T.read(s, d, "customer")
    return c.groupBy(F.col("c_nationkey").alias("chip")).agg((F.min("c_custkey") - 25.0).alias("x0"), (F.max("c_custkey") + 25.0).alias("x1"), F.round(F.min("c_acctbal") - 25, 2).alias("y0"), F.round(F.max("c_acctbal") + 25, 2).alias("y1"))


@query("ge6_chip_tiles", f"WITH {_LL}, m AS (SELECT id, (lon / 180 * pi() * 6378137.0::DOUBLE) AS mx, ln(tan(radians(lat) / 2 + pi() / 4)) / pi() * (pi() * 6378137.0::DOUBLE) AS my, 300 / cos(radians(lat)) AS r FROM p), w AS (SELECT id, floor((mx - r + pi() * 6378137.0::DOUBLE) * k) AS a, floor((pi() * 6378137.0::DOUBLE - my - r) * k) AS b, ceil((mx + r + pi() * 6378137.0::DOUBLE) * k) AS c, ceil((pi() * 6378137.0::DOUBLE - my + r) * k) AS e FROM m, (SELECT 256.0::DOUBLE * 65536 / (2 * pi() * 6378137.0::DOUBLE) AS k)) SELECT id AS chip_id, count(*) AS n_tiles FROM (SELECT id, unnest(range(CAST(floor(a / 256) AS BIGINT), CAST(floor((c - 1) / 256) AS BIGINT) + 1)) AS x, b, e FROM w), LATERAL (SELECT unnest(range(CAST(floor(b / 256) AS BIGINT), CAST(floor((e - 1) / 256) AS BIGINT) + 1)) AS y) GROUP BY id")
def _(s, d):
    t = G.chip_tiles(_ll(s, d).withColumnRenamed("id", "chip_id"), 16, 300.0)
    return t.groupBy("chip_id").agg(F.count(F.lit(1)).alias("n_tiles"))


@query("ge8_single_linkage", sql("pts", "+, e AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.x BETWEEN b.x - 1 AND b.x + 1 AND a.y BETWEEN b.y - 1 AND b.y + 1 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1), r(id, o) AS (SELECT id, id FROM pts UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.id) SELECT id, min(o) AS comp FROM r GROUP BY id").replace("WITH ", "WITH RECURSIVE ", 1).replace(", , ", ", "))
def _(s, d):
    return G.clusters(T.pts(s, d), 1.0)


@query("ge8b_split_groups")
def _(s, d):
    p = T.read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 211).cast("double").alias("x"), (F.col("s_acctbal") / 40).alias("y"), F.col("s_nationkey").alias("grp"))
    return G.split_groups(p, "grp", 120.0).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("ge8c_leaders")
def _(s, d):
    return G.leaders(T.pts(s, d), 1.5)


@query("ge31_crop_grid", "SELECT p_partkey, CAST(greatest(1, ceil(p_size / 8.0)) AS BIGINT) AS n_side, CAST(greatest(1, ceil(p_size / 8.0)) AS BIGINT) * CAST(greatest(1, ceil(p_size / 8.0)) AS BIGINT) AS crops FROM part")
def _(s, d):
    n = F.greatest(F.lit(1), F.ceil(F.col("p_size") / 8.0)).cast("long")
    return T.read(s, d, "part").select("p_partkey", n.alias("n_side"), (n * n).alias("crops"))


@query("m21_bias_grid", sql("pres", "+ q AS (SELECT floor(x) + 0.5::DOUBLE AS px, floor(y) + 0.5::DOUBLE AS py FROM pres WHERE pa = 1), b AS (SELECT count(*)::DOUBLE ** (-1 / 3.0::DOUBLE) AS f, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM pres WHERE pa = 1), c AS (SELECT px, py, count(*)::DOUBLE AS n FROM q GROUP BY 1, 2), g AS (SELECT i * 50.0::DOUBLE AS gx, j * 2.0::DOUBLE AS gy FROM range(0, 21) a(i), range(0, 13) b(j)), s AS (SELECT vx * f AS sx, vy * f AS sy, vxy * f AS sxy, vx * f * vy * f - vxy * f * vxy * f AS det FROM b), d AS (SELECT gx, gy, sum(n * exp(-((gx - px) ** 2 * sy - 2 * (gx - px) * (gy - py) * sxy + (gy - py) ** 2 * sx) / det / 2)) AS d FROM g, c, s GROUP BY gx, gy) SELECT gx, gy, round((d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()), 6) AS density FROM d"))
def _(s, d):
    nodes = s.range(21).select((F.col("id") * 50.0).alias("gx"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda j: j * 2.0)).alias("gy"))
    return G.density(T.pres(s, d).where("pa = 1"), nodes).select("gx", "gy", r6("density"))


@query("m22_score_links", sql("pres", "SELECT id, round(1 / (1 + exp(-(score - 50) / 10)), 6) AS p, least(1, greatest(0, score / 100)) AS clipped FROM pres"))
def _(s, d):
    return T.pres(s, d).select("id", F.round(M.logistic((F.col("score") - 50) / 10), 6).alias("p"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / 100)).alias("clipped"))


@query("m32_distance_decay", sql("pts", "SELECT id, round(0.5::DOUBLE ** ((x * x + y * y) / 900), 6) AS w FROM pts"))
def _(s, d):
    return T.pts(s, d).select("id", F.round(F.pow(F.lit(0.5), (F.col("x") ** 2 + F.col("y") ** 2) / 900), 6).alias("w"))


@query("m31_chi2_of_layers")
def _(s, d):
    from ..functions.stats import chi2_sf

    h = A.kruskal_wallis(T.bands_long(s, d))
    p = chi2_sf(F.col("h"), F.col("k") - 1)
    return h.select("layer", "h", p.alias("p"), F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("").alias("stars"))


@query("m3_formula_probe", "SELECT unnest(['AFRI1600', 'AFRI2100', 'ARI', 'ARI2', 'ARVI', 'ATSAVI', 'AVI', 'BCC', 'BNDVI', 'BWDRVI', 'CIG', 'CIRE', 'BAD', 'OTHER']) AS formula, unnest(['skipped', 'skipped', 'ok', 'skipped', 'skipped', 'skipped', 'skipped', 'ok', 'skipped', 'skipped', 'skipped', 'skipped', 'error', 'skipped']) AS status, (SELECT count(*) FROM embeddings) AS n")
def _(s, d):
    b = T.bands(s, d)
    got = I.probe(b, dict(list(I.FORMULAS.items())[:12]) | {"BAD": "N ++ ", "OTHER": "X + 1"}, I.parameters([c for c in b.columns if c[0] == "b"]))
    return b.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.create_map(*[F.lit(x) for kv in got.items() for x in kv])).alias("formula", "status"), "n")


# Models


@query("ml3_stratified_folds", sql("bands", "SELECT id, class_name, CAST((row_number() OVER (PARTITION BY class_name ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1) % 5 AS INT) AS fold FROM bands"))
def _(s, d):
    return M.hashed_folds(T.bands(s, d), "class_name", 5, "id").select("id", "class_name", "fold")


@query("ml4_standardise", sql("bands", "+ n AS (SELECT id, id % 3 AS fold, CASE WHEN id % 7 = 0 THEN NULL ELSE b0 END AS b0 FROM bands), f AS (SELECT id, fold, coalesce(b0, quantile_cont(b0, 0.5) OVER (PARTITION BY fold)) AS b0 FROM n) SELECT id, fold, round((b0 - avg(b0) OVER w) / CASE WHEN stddev_pop(b0) OVER w = 0 THEN 1 ELSE stddev_pop(b0) OVER w END, 6) AS b0 FROM f WINDOW w AS (PARTITION BY fold)"))
def _(s, d):
    n = T.bands(s, d).select("id", (F.col("id") % 3).alias("fold"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("b0")).alias("b0"))
    return M.standardise(n, ["b0"], "fold").select("id", "fold", r6("b0"))


@query("ml1_spatial_folds")
def _(s, d):
    b = T.bands(s, d).select("id", "class_name", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    return M.spatial_folds(b, "class_name", 5, 10).select("id", "block", "fold")


@query("ml2_grouped_folds")
def _(s, d):
    g = T.bands(s, d).groupBy("polygon_id").agg(F.avg("col").alias("x"), F.avg("row").alias("y"), F.min("class_name").alias("class_name"))
    return M.spatial_folds(g, "class_name", 5, 8).select("polygon_id", "block", "fold")


def _lda_sql() -> str:
    return sql("bands", "+ m AS (SELECT class_name AS c, count(*)::DOUBLE AS n, avg(b0) AS m0, avg(b1) AS m1, var_samp(b0) * (count(*) - 1) AS s0, var_samp(b1) * (count(*) - 1) AS s1, covar_samp(b0, b1) * (count(*) - 1) AS s2 FROM bands GROUP BY 1), p AS (SELECT sum(s0) / (sum(n) - count(*)) AS v0, sum(s1) / (sum(n) - count(*)) AS v1, sum(s2) / (sum(n) - count(*)) AS v2, sum(n) AS total FROM m) SELECT id, first(c ORDER BY round(-0.5::DOUBLE * ((b0 - m0) ** 2 * v1 - 2 * (b0 - m0) * (b1 - m1) * v2 + (b1 - m1) ** 2 * v0) / (v0 * v1 - v2 * v2) + ln(n / total), 8) DESC, c) AS pred FROM bands, m, p GROUP BY id")


@query("ml10_linear_discriminant", _lda_sql())
def _(s, d):
    return M.discriminant(T.bands(s, d), ["b0", "b1"], "class_name").select("id", "pred")


@query("ml10_quadratic_discriminant")
def _(s, d):
    return M.discriminant(T.bands(s, d), ["b0", "b1", "b2"], "class_name", "qda", 0.2).select("id", "pred")


@query("ml11_nearest_neighbours", sql("bands", "+ p AS (SELECT q.id, t.class_name AS c, row_number() OVER (PARTITION BY q.id ORDER BY round(sqrt((q.b0 - t.b0) ** 2 + (q.b1 - t.b1) ** 2), 9), t.id) AS n FROM bands q JOIN bands t ON q.id % 4 = 0 AND t.id % 4 <> 0) SELECT id, c AS pred FROM (SELECT id, c, count(*) AS k FROM p WHERE n <= 5 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC, c) = 1"))
def _(s, d):
    b = T.bands(s, d)
    return M.nearest_neighbours(b.where("id % 4 <> 0"), b.where("id % 4 = 0"), ["b0", "b1"], "class_name", 5)


_NEAR = "p AS (SELECT q.id, t.class_name AS c, round(sqrt((q.b0 - t.b0) ** 2 + (q.b1 - t.b1) ** 2 + (q.b2 - t.b2) ** 2), 9) AS d, t.id AS i FROM bands q JOIN bands t ON q.id % 4 = 0 AND t.id % 4 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, i) AS n, min(d) OVER (PARTITION BY id) AS d0 FROM p), w AS (SELECT id, k, c, count(*) AS n, round(sum(CASE WHEN d0 = 0 THEN CAST(d = 0 AS INT) ELSE 1 / greatest(d, 1e-9) END), 9) AS w FROM r JOIN (SELECT unnest([1, 3, 5, 9]) AS k) ON n <= k GROUP BY 1, 2, 3)"


@query("ml11_neighbours_by_k", sql("bands", f"+ {_NEAR} SELECT id, k, 'uniform' AS weights, c AS pred FROM w QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY n DESC, c) = 1 UNION ALL SELECT id, k, 'distance', c FROM w QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY w DESC, c) = 1"))
def _(s, d):
    """Every k of a grid and both kinds of weight from one search to the largest k."""
    from ..operators import neighbours as N

    b, cols = T.bands(s, d), ["b0", "b1", "b2"]
    train = b.where("id % 4 <> 0")
    near = N.search(b.where("id % 4 = 0"), N.index(train, cols, 9), cols)
    return N.votes(near, train, [1, 3, 5, 9], "class_name")


_W = [0.8, -0.5, 0.3]
_LINEAR = "0.8::DOUBLE * b0 - 0.5::DOUBLE * b1 + 0.3::DOUBLE * b2 + 0.1::DOUBLE"


@query("ml18_response_curve", sql("bands", "+ m AS (SELECT quantile_cont(b0, 0.5) AS m0, quantile_cont(b1, 0.5) AS m1, quantile_cont(b2, 0.5) AS m2 FROM bands WHERE class_name < 3), e AS (SELECT quantile_cont(b0, 0.01) AS l0, quantile_cont(b0, 0.99) AS h0, quantile_cont(b1, 0.01) AS l1, quantile_cont(b1, 0.99) AS h1, quantile_cont(b2, 0.01) AS l2, quantile_cont(b2, 0.99) AS h2 FROM bands), x AS (" + " UNION ALL ".join(f"SELECT 'b{j}' AS feature, i, l{j} + i * (h{j} - l{j}) / 99 AS value, " + ", ".join(f"{f'l{j} + i * (h{j} - l{j}) / 99' if k == j else f'm{k}'} AS b{k}" for k in range(3)) + " FROM m, e, range(0, 100) t(i)" for j in range(3)) + f") SELECT feature, CAST(i AS INT) AS i, round(value, 6) AS value, round(1 / (1 + exp(-({_LINEAR}))), 6) AS response FROM x"))
def _(s, d):
    b, cols = T.bands(s, d), ["b0", "b1", "b2"]
    c = M.response_curve(b, cols, M.logistic(M.linear_score(cols, _W, 0.1)), F.col("class_name") < 3)
    return c.select("feature", "i", r6("value"), r6("response"))


@query("ml16_permutation_importance")
def _(s, d):
    b, cols = T.bands(s, d).withColumn("t", (F.col("class_name") < 3).cast("int")), ["b0", "b1", "b2"]
    return M.importance(b.select("id", "t", *cols), cols, "t", M.linear_score(cols, _W, 0.1))


@query("m30_parametric_fit")
def _(s, d):
    return M.parametric_fit(T.read(s, d, "lineitem"), "l_discount", "l_extendedprice")


@query("ml7_random_forest")
def _(s, d):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    cols = [f"b{i}" for i in range(8)]
    v = VectorAssembler(inputCols=cols, outputCol="x").transform(T.bands(s, d))
    model = RandomForestClassifier(labelCol="class_name", featuresCol="x", numTrees=20, maxDepth=6, seed=42).fit(v.where("id % 5 <> 0"))
    return model.transform(v.where("id % 5 = 0")).select("id", "class_name", F.col("prediction").cast("int").alias("pred"))


@query("ml8_boosted_trees")
def _(s, d):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    cols = [f"b{i}" for i in range(8)]
    b = T.bands(s, d).withColumn("pa", (F.col("class_name") < 3).cast("int"))
    n = b.groupBy("pa").count().collect()  # two numbers
    w = {r["pa"]: r["count"] for r in n}
    b = b.withColumn("w", F.when(F.col("pa") == 1, float(w[0]) / w[1]).otherwise(1.0))
    v = VectorAssembler(inputCols=cols, outputCol="x").transform(b)
    model = GBTClassifier(labelCol="pa", featuresCol="x", weightCol="w", maxIter=8, maxDepth=3, seed=42).fit(v.where("id % 5 <> 0"))
    return model.transform(v.where("id % 5 = 0")).select("id", "pa", F.col("prediction").cast("int").alias("pred"))


@query("ml8_boosted_classes")
def _(s, d):
    """Softmax boosting with classes that weigh the same; p is the probability of the class it gives."""
    from ..operators import boosting as B

    cols, b = [f"b{i}" for i in range(8)], T.bands(s, d)
    train = b.where("id % 5 <> 0")
    model = B.fit(train, cols, "class_name", rounds=8, weights=B.class_weights(train, "class_name"))
    return model.transform(b.where("id % 5 = 0")).select("id", "class_name", F.col("pred").cast("int").alias("pred"), F.round(F.array_max("p"), 6).alias("p"))


@query("ml15_averaged_scores", sql("bands", "SELECT id, round((0.7::DOUBLE / (1 + exp(-b0)) + CASE WHEN id % 3 = 0 THEN 0 ELSE 0.3::DOUBLE / (1 + exp(-b1)) END) / (0.7::DOUBLE + CASE WHEN id % 3 = 0 THEN 0 ELSE 0.3::DOUBLE END), 6) AS score FROM bands"))
def _(s, d):
    from ..operators import tuning as U

    b = T.bands(s, d)
    one = b.select("id", M.logistic(F.col("b0")).alias("score"), F.lit(0.7).alias("w"))
    two = b.select("id", F.when(F.col("id") % 3 != 0, M.logistic(F.col("b1"))).alias("score"), F.lit(0.3).alias("w"))
    return U.averaged(one.unionByName(two), weight="w").select("id", r6("score"))


@query("ml9_elastic_net")
def _(s, d):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    cols = [f"b{i}" for i in range(8)]
    v = VectorAssembler(inputCols=cols, outputCol="x").transform(T.bands(s, d))
    model = LogisticRegression(labelCol="class_name", featuresCol="x", family="multinomial", regParam=0.01, elasticNetParam=0.5, maxIter=30).fit(v.where("id % 5 <> 0"))
    return model.transform(v.where("id % 5 = 0")).select("id", "class_name", F.col("prediction").cast("int").alias("pred"))


@query("ml13_balanced_glm")
def _(s, d):
    cols = ["b0", "b1", "b2", "b3"]
    b = T.bands(s, d).withColumn("pa", (F.col("class_name") < 3).cast("int")).withColumn("n_pixels", F.lit(1.0))
    w = A.balanced_weights(b, "pa", "n_pixels")
    return M.fit_logistic(w, cols, "pa", "weight")[1].select("id", "pa", "p")


@query("ml14_maxent")
def _(s, d):
    b = T.bands(s, d).withColumn("pa", (F.col("class_name") < 3).cast("int")).select("id", "pa", "b0", "b1", "b2")
    f, cols = M.maxent_features(b, ["b0", "b1", "b2"])
    f = f.withColumn("w", F.when(F.col("pa") == 1, 1.0).otherwise(100.0))
    return M.fit_logistic(f, cols, "pa", "w", reg=0.001, l1=1.0)[1].select("id", "pa", F.col("p").alias("suit"))


@query("ml5_grid_search")
def _(s, d):
    """Mean fold AUC of each regularisation, out of fold, and the first best."""
    cols = ["b0", "b1", "b2", "b3"]
    b = M.hashed_folds(T.bands(s, d).withColumn("pa", (F.col("class_name") < 3).cast("int")), "pa", 3, "id")
    out = None
    for reg in (0.001, 0.1):
        for fold in range(3):
            model, _ = M.fit_logistic(b.where(F.col("fold") != fold), cols, "pa", reg=reg)
            z = M.linear_score(cols, list(model.coefficients), model.intercept)
            part = b.where(F.col("fold") == fold).select(F.lit(reg).alias("reg"), "fold", "pa", z.alias("s"))
            out = part if out is None else out.unionByName(part)
    c = A.cumulative(out, "s", {"n": F.count(F.lit(1)), "pos": F.sum("pa")}, ("reg", "fold"))
    p = F.sum("pos")
    auc = c.groupBy("reg", "fold").agg(((F.sum(F.col("pos") * (F.col("n_before") + (F.col("n") + 1) / 2)) - p * (p + 1) / 2) / (p * (F.sum("n") - p))).alias("auc"))
    m = auc.groupBy("reg").agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_sd"))
    return V.ranked(m, {"auc_mean": True, "reg": False})


@query("ml22_model_choice", "WITH m AS (SELECT l_returnflag || l_linestatus AS model, avg(l_discount) AS tss, avg(l_tax) AS f1 FROM lineitem GROUP BY 1) SELECT model, row_number() OVER (ORDER BY round(tss, 9) DESC, round(f1, 9) DESC, model) AS place FROM m")
def _(s, d):
    m = T.read(s, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("model")).agg(F.round(F.avg("l_discount"), 9).alias("tss"), F.round(F.avg("l_tax"), 9).alias("f1"))
    return V.ranked(m, {"tss": True, "f1": True, "model": False}).select("model", F.col("place").cast("long").alias("place"))


@query("ml23_mask_choice", "WITH m AS (SELECT l_orderkey AS point, l_linenumber AS mask, l_discount AS good, l_quantity AS sam FROM lineitem) SELECT point, mask FROM m WHERE good >= 0.02 QUALIFY row_number() OVER (PARTITION BY point ORDER BY good * sam DESC, mask) = 1")
def _(s, d):
    m = T.read(s, d, "lineitem").where("l_discount >= 0.02").select(F.col("l_orderkey").alias("point"), F.col("l_linenumber").alias("mask"), (F.col("l_discount") * F.col("l_quantity")).alias("s"))
    return m.groupBy("point").agg(F.min_by("mask", F.struct(-F.col("s"), F.col("mask"))).alias("mask"))


# Ledgers and windows of events


@query("ss2_pending_work", "WITH l AS (SELECT CAST(user_id AS VARCHAR) AS token, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'failed' END AS status, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT CAST(c_custkey AS VARCHAR) AS token FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT token FROM l WHERE status = 'done')")
def _(s, d):
    settings = {"zoom": 18, "radius": 50}
    e = T.read(s, d, "events").select("user_id", F.when(F.col("event_type") == "purchase", "done").otherwise("failed").alias("status"), F.col("event_id").alias("seq"))
    ledger = S.tokens(e, "user_id", settings)
    return S.pending(S.tokens(T.read(s, d, "customer"), "c_custkey", settings), ledger).select("token")


@query("ss4_changed_chips", "WITH a AS (SELECT c_custkey AS id, c_mktsegment AS s FROM customer WHERE c_custkey % 10 <> 3), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 10 <> 4) SELECT id, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' ELSE 'changed' END AS what FROM a FULL JOIN b USING (id) WHERE a.s IS DISTINCT FROM b.s")
def _(s, d):
    c = T.read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("s"))
    return S.changed(c.where("id % 10 <> 3"), c.where("id % 10 <> 4").withColumn("s", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("s"))), "id", ["s"])


@query("ex1_tumbling_windows", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    w = S.tumbling(T.read(s, d, "events"), "1 day", F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("ex2_sliding_windows", "WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * unnest(range(0, 4))) AS start FROM events) SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM w GROUP BY 1")
def _(s, d):
    return S.sliding(T.read(s, d, "events"), "24 hours", "6 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("ex3_sessions", "WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k")
def _(s, d):
    return S.sessions(T.read(s, d, "events"), "12 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
