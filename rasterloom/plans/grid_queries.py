"""Queries over grids: terrain, indices, components, sieves, overlays, dynamics; with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices as I
from ..operators import dynamics as D
from ..operators import focal as FO
from ..operators import joins as J
from ..operators import lattice as L
from ..sources import tables as T
from ..sources.tables import sql
from .core_queries import _TOUCHED, r6

Q: dict[str, tuple] = {}


def query(name: str, text: str | None = None):
    def add(f):
        Q[name] = (f, text)
        return f

    return add


def _box(expr: str, radius: int, src: str = "dem", value: str = "z") -> str:
    return f"SELECT a.row, a.col, any_value(a.{value}) AS {value}, {expr} FROM {src} a JOIN {src} b ON b.row BETWEEN a.row - {radius} AND a.row + {radius} AND b.col BETWEEN a.col - {radius} AND a.col + {radius} GROUP BY a.row, a.col"


@query("w9_focal_mean", sql("dem_nodata", f"SELECT row, col, round(mean, 6) AS mean FROM ({_box('avg(b.z) AS mean', 2, 'dem_nodata')})"))
def _(s, d):
    return FO.focal_mean(T.dem_nodata(s, d), "z", 2).select("row", "col", r6("mean"))


@query("w10_focal_min_max", sql("dem_nodata", f"SELECT row, col, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ({_box('min(b.z) AS lo, max(b.z) AS hi', 3, 'dem_nodata')})"))
def _(s, d):
    g = T.dem_nodata(s, d)
    lo, hi = (FO.box(g, 3, {n: F.col("z")}, h).select("row", "col", r6(n)) for n, h in (("lo", "min"), ("hi", "max")))
    return lo.join(hi, ["row", "col"])


_DEV = "d{r} AS (SELECT row, col, CASE WHEN sd > 1e-6 THEN (z - m) / sd ELSE 0 END AS d, -{r} AS r FROM (" + "SELECT a.row, a.col, any_value(a.z) AS z, avg(b.z) AS m, sqrt(greatest(avg(b.z * b.z) - avg(b.z) * avg(b.z), 0)) AS sd FROM dem a JOIN dem b ON b.row BETWEEN a.row - {r} AND a.row + {r} AND b.col BETWEEN a.col - {r} AND a.col + {r} GROUP BY a.row, a.col))"


@query("w11_max_deviation", sql("dem", "+" + ", ".join(_DEV.format(r=r) for r in (1, 2, 3)) + ", u AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3) SELECT row, col, round(d, 5) AS maxdev, CAST(-r AS BIGINT) AS scale FROM u QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY round(abs(d), 9) DESC, r DESC) = 1"))
def _(s, d):
    return FO.max_deviation(T.dem(s, d), "z", range(1, 4)).select("row", "col", r6("maxdev", 5), F.col("scale").cast("long").alias("scale"))


def _at(dr: int, dc: int) -> str:
    return f"max(b.z) FILTER (WHERE b.row = a.row + {dr} AND b.col = a.col + {dc})".replace("+ -", "- ")


_HORN = "h AS (SELECT a.row, a.col, CASE WHEN count(*) = 9 THEN (({ne} + 2 * {e} + {se}) - ({nw} + 2 * {w} + {sw})) / 8 END AS p, CASE WHEN count(*) = 9 THEN (({nw} + 2 * {n} + {ne}) - ({sw} + 2 * {s} + {se})) / 8 END AS q FROM dem a JOIN dem b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col)".format(
    nw=_at(-1, -1), n=_at(-1, 0), ne=_at(-1, 1), w=_at(0, -1), e=_at(0, 1), sw=_at(1, -1), s=_at(1, 0), se=_at(1, 1)
)


@query("m8_horn_gradient", sql("dem", f"+{_HORN} SELECT row, col, round(p + 1e-9, 6) AS p, round(q + 1e-9, 6) AS q FROM h"))
def _(s, d):
    return FO.kernel(T.dem(s, d), "z", FO.horn()).select("row", "col", F.round(F.col("p") + 1e-9, 6).alias("p"), F.round(F.col("q") + 1e-9, 6).alias("q"))


_ASPECT = "g AS (SELECT row, col, p, q, sqrt(p * p + q * q) AS g, degrees(atan(sqrt(p * p + q * q))) AS slope, degrees(atan2(-p, -q)) + 360 AS az FROM h), t AS (SELECT row, col, slope, CASE WHEN g IS NULL THEN NULL WHEN g < 1e-9 THEN -1 ELSE az - 360 * floor(az / 360) END AS aspect FROM g)"


@query("m7_slope_aspect", sql("dem", f"+{_HORN}, {_ASPECT} SELECT row, col, round(slope, 5) AS slope, round(aspect, 4) AS aspect, CASE WHEN aspect IS NULL THEN NULL WHEN aspect < 0 THEN 0 ELSE round(sin(radians(aspect)), 5) END AS eastness, CASE WHEN aspect IS NULL THEN NULL WHEN aspect < 0 THEN 0 ELSE round(cos(radians(aspect)), 5) END AS northness FROM t"))
def _(s, d):
    t = FO.slope_aspect(FO.kernel(T.dem(s, d), "z", FO.horn()))
    return t.select("row", "col", r6("slope", 5), r6("aspect", 4), r6("eastness", 5), r6("northness", 5))


def _fit_sql(radius: int, degree: int) -> str:
    """h with the derivatives of the polynomial that fits each whole window best, by its normal equations."""
    import numpy as np

    at = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    terms = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2), *((a, degree - a) for a in range(degree + 1) if degree > 2)]
    x = np.array([[float(j) ** a * float(-i) ** b for a, b in terms] for i, j in at])
    fit = np.linalg.solve(x.T @ x, x.T)
    rows = ", ".join(f"({i}, {j}, " + ", ".join(f"{k * fit[m][n]!r}::DOUBLE" for m, k in ((1, 1), (2, 1), (3, 2), (4, 1), (5, 2))) + ")" for n, (i, j) in enumerate(at)).replace("np.float64(", "").replace(")::", "::")
    sums = ", ".join(f"CASE WHEN count(*) = {len(at)} THEN sum(b.z * w.{c}) END AS {c}" for c in "pqrst")
    return f"w(dr, dc, p, q, r, s, t) AS (VALUES {rows}), h AS (SELECT a.row, a.col, {sums} FROM dem a, w, dem b WHERE b.row = a.row + w.dr AND b.col = a.col + w.dc GROUP BY a.row, a.col)"


@query("m7_cubic_slope", sql("dem", f"+{_fit_sql(2, 3)}, {_ASPECT} SELECT row, col, round(slope, 5) AS slope, round(aspect, 3) AS aspect FROM t"))
def _(s, d):
    t = FO.slope_aspect(FO.kernel(T.dem(s, d), "z", FO.least_squares()))
    return t.select("row", "col", r6("slope", 5), r6("aspect", 3))


@query("m9_position_ruggedness", sql("dem", "SELECT a.row, a.col, round(any_value(a.z) - avg(b.z), 6) AS tpi, round(sqrt(greatest(sum((a.z - b.z) ** 2), 0) / 8), 5) AS tri FROM dem a JOIN dem b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col"))
def _(s, d):
    return FO.position_and_ruggedness(T.dem(s, d), "z").select("row", "col", r6("tpi"), r6("tri", 5))


_CURVED = "k AS (SELECT *, p * p + q * q AS g, p * p * r + 2 * p * q * s + q * q * t AS along, q * q * r - 2 * p * q * s + p * p * t AS over FROM h), m AS (SELECT *, -((1 + q * q) * r - 2 * p * q * s + (1 + p * p) * t) / (2 * (1 + g) ** 1.5) AS mean_curv, (r * t - s * s) / ((1 + g) * (1 + g)) AS gaussian, sin(atan(sqrt(g))) AS sine FROM k), f AS (SELECT *, CASE WHEN g < 1e-18 THEN 0 ELSE -over / (sqrt(g) * 0 + g * sqrt(1 + g)) END AS tangential FROM m)"


@query("m10_curvatures", sql("dem", f"+{_fit_sql(1, 2)}, {_CURVED} SELECT row, col, round(CASE WHEN g < 1e-18 THEN 0 ELSE -along / (g * (1 + g) ** 1.5) END, 5) AS profile, round(CASE WHEN g < 1e-18 THEN 0 ELSE -over / g ** 1.5 END, 4) AS plan, round(tangential, 5) AS tangential, round(mean_curv, 5) AS mean_curv, round(r * r + 2 * s * s + t * t, 4) AS total, round(gaussian, 5) AS gaussian, round(mean_curv - sqrt(greatest(mean_curv ** 2 - gaussian, 0)), 4) AS minimal, round(tangential * sine / (sine * sine + sin(radians(0.1)) ** 2), 4) AS plan_regular FROM f"))
def _(s, d):
    c = FO.curvatures(FO.kernel(T.dem(s, d), "z", FO.least_squares(degree=2, radius=1)))
    t = FO.slope_aspect(c)
    t = t.withColumn("plan_regular", FO.regular_plan(F.col("tangential"), F.col("slope")))
    return t.select("row", "col", *[r6(c, 4 if c in ("plan", "total", "minimal", "plan_regular") else 5) for c in ("profile", "plan", "tangential", "mean_curv", "total", "gaussian", "minimal", "plan_regular")])


@query("m12_scale_position", sql("dem", "+ b AS (SELECT a.row, a.col, any_value(a.z) AS z, avg(b.z) AS m, sqrt(greatest(avg(b.z * b.z) - avg(b.z) * avg(b.z), 0)) AS sd, min(b.z) AS lo, max(b.z) AS hi FROM dem a JOIN dem b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a.row, a.col) SELECT row, col, round(z - m, 6) AS dmv, round(CASE WHEN sd > 1e-6 THEN (z - m) / sd ELSE 0 END, 5) AS devmean, round(CASE WHEN hi > lo THEN (2 * z - hi - lo) / (hi - lo) ELSE 0 END, 6) AS rtp, round(CASE WHEN hi > lo THEN 100 * (z - lo) / (hi - lo) ELSE 50 END, 5) AS pct_range FROM b"))
def _(s, d):
    return FO.scale_position(T.dem(s, d), "z", 2).select("row", "col", r6("dmv"), r6("devmean", 5), r6("rtp"), r6("pct_range", 5))


@query("m13_circular_variance", sql("dem", f"+{_HORN}, {_ASPECT} SELECT a.row, a.col, round(1 - sqrt(sum(sin(radians(b.aspect))) FILTER (WHERE b.aspect >= 0) ** 2 + sum(cos(radians(b.aspect))) FILTER (WHERE b.aspect >= 0) ** 2) / count(*) FILTER (WHERE b.aspect >= 0), 5) AS circvar FROM t a JOIN t b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col"))
def _(s, d):
    t = FO.slope_aspect(FO.kernel(T.dem(s, d), "z", FO.horn()))
    return FO.circular_variance(t.select("row", "col", "aspect"), "aspect", 1).select("row", "col", r6("circvar", 5))


_NORMALS = "SELECT a.row, a.col, count(b.slope) AS n, sqrt(greatest(avg(b.slope * b.slope) - avg(b.slope) ** 2, 0)) AS sd, sqrt(sum(sin(radians(b.slope)) * CASE WHEN b.aspect < 0 THEN 0 ELSE sin(radians(b.aspect)) END) ** 2 + sum(sin(radians(b.slope)) * CASE WHEN b.aspect < 0 THEN 0 ELSE cos(radians(b.aspect)) END) ** 2 + sum(cos(radians(b.slope))) ** 2) AS len FROM t a JOIN t b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a.row, a.col"


@query("m14_roughness", sql("dem", f"+{_HORN}, {_ASPECT} SELECT row, col, round(sd, 3) AS sd_slope, round(degrees(sqrt(-2 * ln(least(greatest(len / n, 1e-9), 1)))), 3) AS sd_normals FROM ({_NORMALS}) WHERE n > 2"))
def _(s, d):
    t = FO.slope_aspect(FO.kernel(T.dem(s, d), "z", FO.horn())).select("row", "col", "slope", "aspect")
    n = FO.box(t, 2, {"n": F.when(F.col("slope").isNotNull(), 1.0)}).where("n > 2").select("row", "col")
    return FO.roughness(t, "slope", "aspect", 2).join(n, ["row", "col"]).select("row", "col", r6("sd_slope", 3), r6("sd_normals", 3))


@query("m14_elevation_percentile", sql("dem", "SELECT a.row, a.col, round(CASE WHEN sum(CAST(b.z <> a.z AS INT)) = 0 THEN 50 ELSE 100.0::DOUBLE * sum(CAST(b.z < a.z AS INT)) / count(*) END, 6) AS elev_pct FROM dem a JOIN dem b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 AND (a.row <> b.row OR a.col <> b.col) GROUP BY a.row, a.col"))
def _(s, d):
    return FO.elevation_percentile(T.dem(s, d), "z", 2).select("row", "col", r6("elev_pct"))


@query("m16_hillshade", sql("dem", f"+{_HORN}, {_ASPECT} SELECT row, col, round(255 * greatest(0, sin(radians(45)) * cos(radians(slope)) + cos(radians(45)) * CASE WHEN aspect < 0 THEN 0 ELSE sin(radians(slope)) * cos(radians(315 - aspect)) END), 4) AS shade FROM t WHERE slope IS NOT NULL"))
def _(s, d):
    t = FO.slope_aspect(FO.kernel(T.dem(s, d), "z", FO.horn())).where("slope IS NOT NULL")
    return t.withColumn("shade", FO.hillshade(F.col("slope"), F.col("aspect"))).select("row", "col", r6("shade", 4))


_LIT = "255 * greatest(0, sin(radians(45)) * cos(radians(slope)) + cos(radians(45)) * CASE WHEN aspect < 0 THEN 0 ELSE sin(radians(slope)) * cos(radians({az} - aspect)) END)"
_SIDE = "greatest(sin(radians(CASE WHEN aspect < 0 THEN 0 ELSE aspect END - {az})) ** 2, 0.0001::DOUBLE)"
_SUNS = (225, 270, 315, 360)


@query("m16_hillshade_multi", sql("dem", f"+{_HORN}, {_ASPECT} SELECT row, col, round((" + " + ".join(f"{_SIDE.format(az=a)} * {_LIT.format(az=a)}" for a in _SUNS) + ") / (" + " + ".join(_SIDE.format(az=a) for a in _SUNS) + "), 4) AS shade FROM t WHERE slope IS NOT NULL"))
def _(s, d):
    t = FO.slope_aspect(FO.kernel(T.dem(s, d), "z", FO.horn())).where("slope IS NOT NULL")
    return t.select("row", "col", F.round(FO.hillshade_multi(F.col("slope"), F.col("aspect")), 4).alias("shade"))


@query("m17_wetness", sql("dem", f"+{_HORN}, {_ASPECT} SELECT t.row, t.col, round(ln((z + 1) / greatest(tan(radians(slope)), 0.001)), 5) AS twi, round(1.4::DOUBLE * ((z + 1) / 22.13::DOUBLE) ** 0.4 * (sin(radians(slope)) / 0.0896::DOUBLE) ** 1.3, 3) AS sti, round((z + 1) * tan(radians(slope)), 4) AS spi FROM t JOIN dem USING (row, col) WHERE slope IS NOT NULL"))
def _(s, d):
    t = FO.slope_aspect(FO.kernel(T.dem(s, d), "z", FO.horn())).where("slope IS NOT NULL")
    t = t.withColumns(FO.wetness(F.col("z") + 1, F.col("slope")))
    return t.select("row", "col", r6("twi", 5), r6("sti", 3), r6("spi", 4))


@query("m18_d8_pointer", sql("dem", "+ n AS (SELECT a.row, a.col, b.row AS to_row, b.col AS to_col, (a.z - b.z) / CASE WHEN a.row <> b.row AND a.col <> b.col THEN sqrt(2.0) ELSE 1 END AS fall FROM dem a JOIN dem b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col) WHERE a.z > b.z), m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY round(fall, 9) DESC, to_row, to_col) = 1) SELECT dem.row, dem.col, to_row, to_col, round(fall, 6) AS fall FROM dem LEFT JOIN m ON dem.row = m.row AND dem.col = m.col"))
def _(s, d):
    return FO.d8(T.dem(s, d), "z").select("row", "col", "to_row", "to_col", F.round("drop", 6).alias("fall"))


_D8 = "n AS (SELECT a.row, a.col, b.row AS to_row, b.col AS to_col, (a.z - b.z) / CASE WHEN a.row <> b.row AND a.col <> b.col THEN sqrt(2.0) ELSE 1 END AS fall FROM dem a JOIN dem b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col) WHERE a.z > b.z), m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY round(fall, 9) DESC, to_row, to_col) = 1)"


@query("m18_flow_accumulation", sql("dem", f"+ {_D8}, ptr AS (SELECT dem.row * 100 + dem.col AS id, to_row * 100 + to_col AS nxt FROM dem LEFT JOIN m ON dem.row = m.row AND dem.col = m.col), up AS (SELECT id AS src, id AS cell FROM ptr UNION ALL SELECT up.src, ptr.nxt FROM up JOIN ptr ON up.cell = ptr.id WHERE ptr.nxt IS NOT NULL) SELECT CAST(cell // 100 AS INT) AS row, CAST(cell % 100 AS INT) AS col, count(*) AS sca FROM up GROUP BY cell").replace("WITH ", "WITH RECURSIVE ", 1))
def _(s, d):
    from ..operators.flow import accumulate

    return accumulate(FO.d8(T.dem(s, d), "z"))


@query("m18_filled_flow")
def _(s, d):
    """Depressions are filled before drops are sent down; over level fill they go away from higher and to lower ground."""
    from ..operators.flow import accumulate, fill_depressions, flow_pointers

    filled = L._shared(fill_depressions(T.dem(s, d), "z", 64), "filled")
    way = L._shared(flow_pointers(filled.select("row", "col", F.col("filled").alias("z")), "z", 64), "ways")
    return accumulate(way).join(way.select("row", "col", "to_row", "to_col"), ["row", "col"]).join(filled.select("row", "col", "filled"), ["row", "col"])


@query("m18_breached_flow")
def _(s, d):
    """Pits are breached within ten cells, the rest is filled, and drops are sent down."""
    from ..operators.flow import accumulate, hydrology

    way = L._shared(hydrology(T.dem_nodata(s, d), "z", 10, 64), "ways")
    return accumulate(way).join(way.select("row", "col", "z", "level", "to_row", "to_col"), ["row", "col"])


_FORMS = "ways(dr, dc, way) AS (VALUES (-1, -1, 0), (-1, 0, 1), (-1, 1, 2), (0, -1, 3), (0, 1, 4), (1, -1, 5), (1, 0, 6), (1, 1, 7)), sight AS (SELECT a.row, a.col, way, max(degrees(atan((b.z - a.z) / (k * sqrt(dr * dr + dc * dc))))) AS up, -min(degrees(atan((b.z - a.z) / (k * sqrt(dr * dr + dc * dc))))) AS down FROM dem a, ways, range(1, 6) r(k), dem b WHERE b.row = a.row + k * dr AND b.col = a.col + k * dc GROUP BY a.row, a.col, way), n AS (SELECT row, col, count(*) FILTER (WHERE up > 1 AND up >= down) AS h, count(*) FILTER (WHERE NOT (up > 1 AND up >= down) AND down > 1) AS l FROM sight GROUP BY row, col)"


@query("m19_geomorphons", sql("dem", f"+{_FORMS} SELECT row, col, h AS higher, l AS lower, CASE WHEN h + l <= 2 THEN 'flat' WHEN h = 0 THEN CASE WHEN l = 8 THEN 'peak' ELSE 'ridge' END WHEN l = 0 THEN CASE WHEN h = 8 THEN 'pit' ELSE 'valley' END WHEN l - h >= 3 THEN 'ridge' WHEN h - l >= 3 THEN 'valley' ELSE 'slope' END AS form FROM n"))
def _(s, d):
    from ..operators.flow import geomorphons

    return geomorphons(T.dem(s, d), "z", 5)


@query("m20_gaussian_smooth", sql("dem_nodata", "SELECT a.row, a.col, round(sum(b.z * exp(-((a.row - b.row) ** 2 + (a.col - b.col) ** 2) / 2.0::DOUBLE)) / sum(exp(-((a.row - b.row) ** 2 + (a.col - b.col) ** 2) / 2.0::DOUBLE)), 6) AS smooth FROM dem_nodata a JOIN dem_nodata b ON abs(a.row - b.row) <= 3 AND abs(a.col - b.col) <= 3 GROUP BY a.row, a.col"))
def _(s, d):
    return FO.gaussian_smooth(T.dem_nodata(s, d), "z", 1.0, 3).select("row", "col", r6("smooth"))


# Indices

_HAVE = {"B": "b0", "G": "b1", "R": "b2", "RE1": "b3", "N": "b4", "S1": "b5", "S2": "b6"}
_SPECTRAL = {"NDVI": "(N - R) / nullif(N + R, 0)", "SAVI": "1.5::DOUBLE * (N - R) / nullif(N + R + 0.5::DOUBLE, 0)", "EVI": "2.5::DOUBLE * (N - R) / nullif(N + 6 * R - 7.5::DOUBLE * B + 0.5::DOUBLE, 0)", "NDWI": "(G - N) / nullif(G + N, 0)", "NBR": "(N - S2) / nullif(N + S2, 0)", "BSI": "((S1 + R) - (N + B)) / nullif((S1 + R) + (N + B), 0)", "DVI": "N - R"}


@query("m1_spectral_indices", sql("bands", "+ x AS (SELECT id, " + ", ".join(f"abs({c}) + 0.1::DOUBLE AS {p}" for p, c in _HAVE.items()) + " FROM bands) SELECT id, " + ", ".join(f"round({f}, 5) AS {k}" for k, f in _SPECTRAL.items()) + " FROM x"))
def _(s, d):
    b = T.bands(s, d)
    x = b.select("id", *[(F.abs(F.col(c)) + 0.1).alias(c) for c in _HAVE.values()])
    return I.evaluate(x, _HAVE).select("id", *[r6(k, 5) for k in _SPECTRAL])


def _catalogue_sql() -> str:
    """All formulas that nine bands suffice for, over embeddings[1..9] made positive."""
    import re

    bands = {p: f"(abs(CAST(embedding[{i + 1}] AS DOUBLE)) + 0.1::DOUBLE)" for i, p in enumerate(I.POSITIONS)}
    value = bands | {k: f"{v}::DOUBLE" for k, v in I.CONSTANTS.items()}
    text = {k: re.sub(r"[A-Za-z]\w*|\d+(?:\.\d+)?", lambda m: value.get(m[0], m[0] + "::DOUBLE"), f) for k, f in I.FORMULAS.items()}
    return "SELECT vec_id AS id, " + ", ".join(f'CASE WHEN isfinite({f}) THEN round({f}, 3) + 0 END AS "{k}"' for k, f in text.items()) + " FROM embeddings"


@query("m1_index_catalogue", _catalogue_sql())
def _(s, d):
    e = T.read(s, d, "embeddings")
    x = e.select(F.col("vec_id").alias("id"), *[(F.abs(F.col("embedding")[i].cast("double")) + 0.1).alias(f"b{i}") for i in range(9)])
    return I.evaluate(x, {p: f"b{i}" for i, p in enumerate(I.POSITIONS)}).select("id", *[(F.round(k, 3) + 0.0).alias(k) for k in I.FORMULAS])


@query("m4_scale_and_nodata", sql("sar", "SELECT row, col, round(CASE WHEN (row * col) % 6 = 0 THEN NULL ELSE hh / 10000 END, 8) AS hh FROM sar"))
def _(s, d):
    raw = T.sar(s, d).select("row", "col", F.when(F.col("row") * F.col("col") % 6 == 0, -9999.0).otherwise(F.col("hh")).alias("hh"))
    return raw.select("row", "col", F.round(F.nullif("hh", F.lit(-9999.0)) / 10000, 8).alias("hh"))


@query("m5_linear_if_db", sql("sar", "+ b AS (SELECT row, col, 10 * log10(greatest(hv, 1e-10)) AS hv FROM sar) SELECT row, col, round(CASE WHEN (SELECT avg(hv) FROM b) < 0 THEN 10 ** (hv / 10) ELSE hv END, 9) AS hv FROM b"))
def _(s, d):
    g = T.sar(s, d).select("row", "col", I.to_db(F.col("hv")).alias("hv"))
    return I.linear_if_db(g, ["hv"]).select("row", "col", r6("hv", 9))


_RADAR = {"RVI": "4 * hv / (hh + hv)", "RFDI": "(hh - hv) / (hh + hv)", "HH_HV_Ratio": "hv / hh", "HH_HV_Sum": "hh + hv", "HH_HV_Diff": "hh - hv", "HH_HV_Mean": "(hh + hv) / 2", "NDI": "(hh - hv) / (hh + hv)", "HV_dB": "10 * log10(greatest(hv, 1e-10))", "HH_dB": "10 * log10(greatest(hh, 1e-10))", "Ratio_dB": "10 * log10(greatest(hv / greatest(hh, 1e-10), 1e-10))", "BMI": "(hh + hv) / 2", "VSI": "hv / (hh + hv) * 100", "Span": "hh + 2 * hv", "PDI": "sqrt(hh ** 2 + hv ** 2)"}


@query("m6_radar_indices", sql("sar", "SELECT row, col, " + ", ".join(f"round({f} + 1e-9, 5) AS {k}" for k, f in _RADAR.items()) + " FROM sar"))
def _(s, d):
    return T.sar(s, d).withColumns(I.radar_indices(F.col("hh"), F.col("hv"))).select("row", "col", *[F.round(F.col(k) + 1e-9, 5).alias(k) for k in _RADAR])


# Dynamics


@query("a21_area_by_threshold", sql("suit", "SELECT year, round(count(*) FILTER (WHERE suit >= 0.5) * 0.09::DOUBLE, 6) AS ha, round(avg(suit), 6) AS mean_suit FROM suit GROUP BY year"))
def _(s, d):
    return D.area_by_threshold(T.suit(s, d), 0.5, 0.09).select("year", r6("ha"), r6("mean_suit"))


_GRP = "CAST({c} >= 0.3 AS INT) + CAST({c} >= 0.6 AS INT)"


@query("a22_area_by_group", sql("suit", f"SELECT year, {_GRP.format(c='suit')} AS grp, round(count(*) * 0.09::DOUBLE, 6) AS ha FROM suit GROUP BY 1, 2"))
def _(s, d):
    return D.area_by_group(T.suit(s, d), [0.3, 0.6], 0.09).select("year", "grp", r6("ha"))


_ENDS = "e AS (SELECT k, arg_min(suit, year) AS f, arg_max(suit, year) AS l FROM suit GROUP BY k)"


@query("a23_transitions", sql("suit", f"+{_ENDS} SELECT {_GRP.format(c='f')} AS from_grp, {_GRP.format(c='l')} AS to_grp, round(count(*) * 0.09::DOUBLE, 6) AS ha FROM e GROUP BY 1, 2"))
def _(s, d):
    return D.transitions(T.suit(s, d), [0.3, 0.6], 0.09).select("from_grp", "to_grp", r6("ha"))


@query("a24_gain_loss", sql("suit", f"+{_ENDS}, c AS (SELECT CAST(f >= 0.5 AS INT) * 2 + CAST(l >= 0.5 AS INT) AS status FROM e) SELECT status, count(*) AS n FROM c GROUP BY status"))
def _(s, d):
    e = D.ends(T.suit(s, d))
    return e.groupBy(D.change_status(F.col("first"), F.col("last"), 0.5).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("a25_trend", sql("suit", "SELECT k, round(regr_slope(suit, year), 6) AS slope, round(CASE WHEN regr_syy(suit, year) = 0 THEN 0 ELSE regr_r2(suit, year) END, 6) AS r2 FROM suit GROUP BY k"))
def _(s, d):
    return D.trend(T.suit(s, d)).select("k", r6("slope"), r6("r2"))


@query("m23_groups", sql("suit", f"SELECT k, year, {_GRP.format(c='suit')} AS grp FROM suit"))
def _(s, d):
    return T.suit(s, d).select("k", "year", D.group_of(F.col("suit"), [0.6, 0.3]).alias("grp"))


@query("m24_change_status", sql("suit", f"+{_ENDS} SELECT k, CASE WHEN f < 0.5 AND l < 0.5 THEN 0 WHEN f < 0.5 THEN 1 WHEN l < 0.5 THEN 2 ELSE 3 END AS status FROM e"))
def _(s, d):
    return D.ends(T.suit(s, d)).select("k", D.change_status(F.col("first"), F.col("last"), 0.5).alias("status"))


@query("m25_transition_code", sql("suit", f"+{_ENDS} SELECT k, ({_GRP.format(c='f')}) * 3 + {_GRP.format(c='l')} AS code FROM e"))
def _(s, d):
    return D.ends(T.suit(s, d)).select("k", D.transition_code(F.col("first"), F.col("last"), [0.3, 0.6]).alias("code"))


@query("m26_difference", sql("suit", f"+{_ENDS} SELECT k, round(l - f, 6) AS diff FROM e"))
def _(s, d):
    return D.ends(T.suit(s, d)).select("k", F.round(F.col("last") - F.col("first"), 6).alias("diff"))


@query("d5_complete_stack", sql("suit", "SELECT k, year, round(suit, 6) AS suit FROM suit WHERE k IN (SELECT k FROM suit GROUP BY k HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM suit))"))
def _(s, d):
    return D.complete(T.suit(s, d)).select("k", "year", r6("suit"))


# Lattice

_COMP = """, e AS (SELECT a.row * 100 + a.col AS a, b.row * 100 + b.col AS b FROM cls a JOIN cls b ON a.cls = b.cls AND {near}),
r(id, o) AS (SELECT row * 100 + col, row * 100 + col FROM cls UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(o) AS comp FROM r GROUP BY id)"""
_FOUR_SQL = sql("cls", "").replace("WITH ", "WITH RECURSIVE ").rstrip() + _COMP.format(near="abs(a.row - b.row) + abs(a.col - b.col) = 1")
_EIGHT_SQL = sql("cls", "").replace("WITH ", "WITH RECURSIVE ").rstrip() + _COMP.format(near="abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1")


@query("ge10_components", _FOUR_SQL + " SELECT row, col, cls, comp FROM cls JOIN c ON id = row * 100 + col")
def _(s, d):
    return L.cell_components(T.cls(s, d), "cls", width=100)


@query("ge10_components_8", _EIGHT_SQL + " SELECT comp, count(*) AS n FROM c GROUP BY comp")
def _(s, d):
    return L.cell_components(T.cls(s, d), "cls", J.EIGHT, width=100).groupBy("comp").agg(F.count(F.lit(1)).alias("n"))


@query("ge11_patches", _FOUR_SQL + " SELECT comp, any_value(cls) AS cls, count(*) AS cells, count(*) * 0.25::DOUBLE AS area FROM cls JOIN c ON id = row * 100 + col GROUP BY comp")
def _(s, d):
    return L.patches(T.cls(s, d).withColumn("row", F.col("row")), "cls", cell_area=0.25).withColumn("comp", F.floor(F.col("comp") / (1 << 31)) * 100 + F.col("comp") % (1 << 31))


@query("st7_replace_and_dissolve", _FOUR_SQL.replace(", e AS", ", cls2 AS (SELECT row, col, CASE cls WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE cls END AS cls FROM cls), e AS").replace("FROM cls a JOIN cls b", "FROM cls2 a JOIN cls2 b") + " SELECT any_value(cls) AS cls, count(*) AS cells FROM cls2 JOIN c ON id = row * 100 + col GROUP BY comp")
def _(s, d):
    return L.dissolve(T.cls(s, d), "cls", {1: 2, 2: 3}).select("cls", "cells")


@query("ge13_majority_sieve")
def _(s, d):
    return L.sieve(T.cls(s, d), "cls", 6)


@query("ge14_structural_sieve")
def _(s, d):
    return L.structural_sieve(T.cls(s, d).withColumn("cls", F.col("cls") * 10 + F.col("col") % 2), "cls", {10: 1, 11: 1, 20: 2, 21: 2, 30: 3, 31: 3}, 6)


@query("ge15_sieve_within_group")
def _(s, d):
    g = T.cls(s, d).withColumn("type", F.floor(F.col("row") / 20).cast("int"))
    return L.sieve(g, "cls", 6, group="type")


@query("ge12_nearest_fill", sql("dem dem_nodata", "+ h AS (SELECT row, col FROM dem EXCEPT SELECT row, col FROM dem_nodata), n AS (SELECT h.row, h.col, min({d: (h.row - v.row) ** 2 + (h.col - v.col) ** 2, z: v.z}) AS b FROM h JOIN dem_nodata v ON abs(h.row - v.row) <= 25 AND abs(h.col - v.col) <= 25 GROUP BY 1, 2) SELECT row, col, z FROM dem_nodata UNION ALL SELECT row, col, b.z FROM n"))
def _(s, d):
    g = T.dem_nodata(s, d)
    return L.nearest_fill(g, T.dem(s, d).select("row", "col"), "z")


@query("m27_composite_code", sql("cls", "SELECT row, col, (row % 10) * 1000 + cls AS code, ((row % 10) * 1000 + cls) // 1000 AS geomorph, ((row % 10) * 1000 + cls) % 1000 AS type FROM cls"))
def _(s, d):
    c = T.cls(s, d).select("row", "col", (F.col("row") % 10 * 1000 + F.col("cls")).alias("code"))
    return c.select("row", "col", "code", F.floor(F.col("code") / 1000).cast("int").alias("geomorph"), (F.col("code") % 1000).alias("type"))


@query("m28_structural_class", "SELECT o_orderkey, (o_custkey % 1000) // 10 AS struct FROM orders")
def _(s, d):
    return T.read(s, d, "orders").select("o_orderkey", F.floor(F.col("o_custkey") % 1000 / 10).cast("long").alias("struct"))


@query("ge16_boundary_segments", sql("cls", "+ q AS (SELECT row + dr AS row, col + dc AS col, cls, sum(w) AS case FROM cls, (SELECT unnest([0, 0, -1, -1]) AS dr, unnest([0, -1, -1, 0]) AS dc, unnest([8, 4, 2, 1]) AS w) GROUP BY 1, 2, 3) SELECT cls, count(*) AS quads, CAST(sum(CASE WHEN \"case\" IN (5, 10) THEN 2 ELSE 1 END) AS BIGINT) AS segments FROM q WHERE \"case\" < 15 GROUP BY cls".replace("AS case FROM", "AS \"case\" FROM")))
def _(s, d):
    g = L.segments(T.cls(s, d), "cls")
    return g.groupBy("cls").agg(F.countDistinct("row", "col").alias("quads"), F.count(F.lit(1)).alias("segments"))


@query("ge19_priority_layers", sql("cls zones", f"+{_TOUCHED}, z AS (SELECT row, col, CAST(cls AS INT) + 10 AS cls, CASE WHEN zone % 2 = 0 THEN 1 ELSE 2 END AS src FROM touched), u AS (SELECT * FROM z UNION ALL SELECT row, col, cls, 3 FROM cls) SELECT row, col, cls, CASE WHEN src = 3 THEN 0 ELSE src END AS src FROM u QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY src, cls) = 1"))
def _(s, d):
    z = J.cells_of_boxes(T.zones(s, d), keep=("zone", "cls")).select("row", "col", (F.col("cls").cast("int") + 10).alias("cls"), "zone")
    return L.overlay([z.where("zone % 2 = 0"), z.where("zone % 2 = 1")], T.cls(s, d), "cls")


@query("ge20_footprint_clip", sql("cls zones", f"+{_TOUCHED}, g AS (SELECT DISTINCT t.row + a.d AS row, t.col + b.d AS col FROM touched t, range(-1, 2) a(d), range(-1, 2) b(d)) SELECT row, col, cls FROM cls WHERE (row, col) IN (SELECT (row, col) FROM g)"))
def _(s, d):
    near = L.dilate(J.cells_of_boxes(T.zones(s, d)).select("row", "col"), 1)
    return T.cls(s, d).join(near, ["row", "col"], "left_semi").select("row", "col", "cls")


@query("ge21_topology_correction")
def _(s, d):
    z = J.cells_of_boxes(T.zones(s, d), keep=("zone", "cls")).select("row", "col", (F.col("cls").cast("int") + 10).alias("cls"))
    g = L._shared(T.cls(s, d), "classes")
    return L.correct([z], g.where("(row * 7 + col * 13) % 17 <> 0"), g.select("row", "col"), "cls")


@query("ge23_overlap_removal", sql("zones", f"+{_TOUCHED} SELECT row, col, zone FROM (SELECT t.*, (x1 - x0) * (y1 - y0) AS area FROM touched t JOIN zones USING (zone)) QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY zone % 5 <> 0, area DESC, zone) = 1"))
def _(s, d):
    z = T.zones(s, d).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).withColumn("target", F.col("zone") % 5 == 0)
    return L.no_overlap(J.cells_of_boxes(z, keep=("zone", "area", "target")), "zone", "target", "area")


@query("ge24_slivers", _FOUR_SQL + ", x AS (SELECT row, col, cls, comp FROM cls JOIN c ON id = row * 100 + col), core AS (SELECT DISTINCT a.comp FROM x a JOIN x b ON a.comp = b.comp AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col, a.comp HAVING count(*) = 9) SELECT comp, any_value(cls) AS cls, count(*) AS cells FROM x WHERE comp NOT IN (SELECT comp FROM core) GROUP BY comp")
def _(s, d):
    c = L.cell_components(T.cls(s, d), "cls", width=100)
    return c.join(L.slivers(c, "comp"), "comp", "left_semi").groupBy("comp", "cls").agg(F.count(F.lit(1)).alias("cells"))


@query("ge25_topology_report", sql("cls zones", f"+{_TOUCHED} SELECT 'overlap' AS what, count(*) AS n FROM (SELECT row, col FROM touched GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'gap', count(*) FROM (SELECT row, col FROM cls EXCEPT SELECT row, col FROM touched)"))
def _(s, d):
    z = J.cells_of_boxes(T.zones(s, d)).select("row", "col")
    return L.report(z, T.cls(s, d).select("row", "col"))


@query("ge26_voronoi_split", sql("cls pts", "+ p AS (SELECT id, x / 4 AS x, y / 2.5::DOUBLE AS y FROM pts WHERE y >= 0) SELECT row, col, arg_min(id, round((col + 0.5 - x) ** 2 + (row + 0.5 - y) ** 2, 6) * 1000 + id * 1e-4) AS id FROM cls, p GROUP BY row, col"))
def _(s, d):
    p = T.pts(s, d).where("y >= 0").select("id", (F.col("x") / 4).alias("x"), (F.col("y") / 2.5).alias("y"))
    return L.split_by_points(T.cls(s, d).select("row", "col"), p)


def _flip_sql(src: str, value: int, n: int) -> str:
    """m after components of `value` with fewer than 4 cells have changed."""
    return f"e{n} AS (SELECT a.row * 100 + a.col AS a, b.row * 100 + b.col AS b FROM {src} a JOIN {src} b ON a.m = b.m AND a.m = {value} AND abs(a.row - b.row) + abs(a.col - b.col) = 1), r{n}(id, o) AS (SELECT row * 100 + col, row * 100 + col FROM {src} WHERE m = {value} UNION SELECT e{n}.b, r{n}.o FROM r{n} JOIN e{n} ON e{n}.a = r{n}.id), c{n} AS (SELECT id, min(o) AS comp FROM r{n} GROUP BY id), f{n} AS (SELECT id FROM c{n} WHERE comp IN (SELECT comp FROM c{n} GROUP BY comp HAVING count(*) < 4)), m{n} AS (SELECT row, col, CASE WHEN row * 100 + col IN (SELECT id FROM f{n}) THEN 1 - m ELSE m END AS m FROM {src})"


@query("ge28_fill_holes", sql("cls", f"+, m0 AS (SELECT row, col, CAST(cls = 1 AS INT) AS m FROM cls), {_flip_sql('m0', 0, 1)}, {_flip_sql('m1', 1, 2)} SELECT row, col, m FROM m2").replace("WITH ", "WITH RECURSIVE ", 1).replace(", , ", ", "))
def _(s, d):
    return L.fill_holes(T.cls(s, d).select("row", "col", (F.col("cls") == 1).cast("int").alias("m")), 4)


@query("ge29_masks_to_labels", sql("zones", f"+{_TOUCHED} SELECT row, col, zone AS label FROM (SELECT t.*, count(*) OVER (PARTITION BY zone) AS n FROM touched t) QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n, zone) = 1"))
def _(s, d):
    c = J.cells_of_boxes(T.zones(s, d))
    n = c.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, "zone").groupBy("row", "col").agg(F.min_by("zone", F.struct("n", "zone")).alias("label"))


@query("ge33_close_gaps", sql("zones", f"+{_TOUCHED}, t AS (SELECT DISTINCT row, col FROM touched), o AS (SELECT a.d AS dr, b.d AS dc FROM range(-1, 2) a(d), range(-1, 2) b(d)), g AS (SELECT DISTINCT row + dr AS row, col + dc AS col FROM t, o), e AS (SELECT row + dr AS row, col + dc AS col FROM g, o GROUP BY 1, 2 HAVING count(*) = 9) SELECT row, col FROM e UNION SELECT row, col FROM t"))
def _(s, d):
    return L.close_gaps(J.cells_of_boxes(T.zones(s, d)).select("row", "col").distinct())


@query("ge18_tiled_sieve")
def _(s, d):
    return L.tiled(T.cls(s, d), "cls", 10, 4)
