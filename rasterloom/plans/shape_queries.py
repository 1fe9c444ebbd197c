"""Queries over rings, parts, chips and masks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import faces as FA
from ..operators import joins as J
from ..operators import lattice as L
from ..operators import masks as K
from ..operators import polygons as PO
from ..operators import windows as V
from ..sources import tables as T
from ..sources.tables import sql
from .core_queries import _TOUCHED, r6
from .grid_queries import _FOUR_SQL

Q: dict[str, tuple] = {}


def query(name: str, text: str | None = None):
    def add(f):
        Q[name] = (f, text)
        return f

    return add


_QUADS = "q AS (SELECT row + dr AS row, col + dc AS col, cls, CAST(sum(w) AS INT) AS kind FROM cls, (SELECT unnest([0, 0, -1, -1]) AS dr, unnest([0, -1, -1, 0]) AS dc, unnest([8, 4, 2, 1]) AS w) GROUP BY 1, 2, 3)"


@query("ge16_rings", sql("cls", f"+ {_QUADS} SELECT cls, CAST(sum(CASE WHEN kind IN (5, 10) THEN 2 WHEN kind < 15 THEN 1 ELSE 0 END) AS BIGINT) AS n_segments, round(sum(CASE WHEN kind = 15 THEN 1 WHEN kind IN (7, 11, 13, 14) THEN 0.875 WHEN kind IN (5, 10) THEN 0.75 WHEN kind IN (1, 2, 4, 8) THEN 0.125 ELSE 0.5 END::DOUBLE), 3) AS area FROM q GROUP BY cls"))
def _(s, d):
    pieces = PO.ring_pieces(L.segments(T.cls(s, d), "cls"))
    r = PO.ring_measures(pieces, PO.joined_pieces(pieces))
    signed = F.when(F.col("inside") % 2 == 0, F.col("area")).otherwise(-F.col("area"))
    return r.groupBy("cls").agg(F.sum("n").alias("n_segments"), F.round(F.sum(signed), 3).alias("area"))


@query("ge22_reattach", _FOUR_SQL + ", x AS (SELECT row, col, cls, comp FROM cls JOIN c ON id = row * 100 + col), n AS (SELECT comp, cls, count(*) AS n FROM x GROUP BY 1, 2), main AS (SELECT comp FROM n QUALIFY row_number() OVER (PARTITION BY cls ORDER BY n DESC, comp) = 1), v AS (SELECT a.comp, b.cls AS vote, count(*) AS k FROM x a JOIN x b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND a.comp <> b.comp WHERE a.comp NOT IN (SELECT comp FROM main) GROUP BY 1, 2), w AS (SELECT comp, vote FROM v QUALIFY row_number() OVER (PARTITION BY comp ORDER BY k DESC, vote DESC) = 1) SELECT row, col, coalesce(vote, cls) AS cls FROM x LEFT JOIN w USING (comp)")
def _(s, d):
    return PO.reattach(T.cls(s, d), "cls")


@query("ge24_merged_slivers", _FOUR_SQL + ", x AS (SELECT row, col, cls, comp FROM cls JOIN c ON id = row * 100 + col), core AS (SELECT DISTINCT a.comp FROM x a JOIN x b ON a.comp = b.comp AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col, a.comp HAVING count(*) = 9), v AS (SELECT a.comp, b.cls AS vote, count(*) AS k FROM x a JOIN x b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND a.comp <> b.comp WHERE a.comp NOT IN (SELECT comp FROM core) GROUP BY 1, 2), w AS (SELECT comp, vote FROM v QUALIFY row_number() OVER (PARTITION BY comp ORDER BY k DESC, vote DESC) = 1) SELECT row, col, coalesce(vote, cls) AS cls FROM x LEFT JOIN w USING (comp)")
def _(s, d):
    return L.merge_slivers(T.cls(s, d), "cls")


@query("ge18_tiled_majority_sieve")
def _(s, d):
    return L.tiled_sieve(T.cls(s, d), "cls", 6, 512, 16)


@query("ge5_disc_cells", sql("pts", "+ p AS (SELECT id, x / 4 AS x, y / 10 AS y FROM pts), r AS (SELECT *, unnest(range(CAST(floor(y - 1.5::DOUBLE) AS BIGINT), CAST(ceil(y + 1.5::DOUBLE) AS BIGINT))) AS row FROM p), c AS (SELECT *, unnest(range(CAST(floor(x - 1.5::DOUBLE) AS BIGINT), CAST(ceil(x + 1.5::DOUBLE) AS BIGINT))) AS col FROM r) SELECT row, col, count(*) AS n_discs, min(id) AS first FROM c WHERE (col + 0.5::DOUBLE - x) ** 2 + (row + 0.5::DOUBLE - y) ** 2 <= 2.25 GROUP BY row, col"))
def _(s, d):
    p = T.pts(s, d).select("id", (F.col("x") / 4).alias("x"), (F.col("y") / 10).alias("y"))
    return K.disc_cells(p, 1.5).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n_discs"), F.min("id").alias("first"))


_HALF = "m AS (SELECT zone, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM zones), o AS (SELECT a.row, a.col, a.zone AS a, b.zone AS b FROM touched a JOIN touched b ON a.row = b.row AND a.col = b.col AND a.zone < b.zone)"


@query("ge27_overlap_halves", sql("zones", f"+{_TOUCHED}, {_HALF} SELECT row, col, a, b, CASE WHEN round((col + 0.5::DOUBLE - p.mx) ** 2 + (row + 0.5::DOUBLE - p.my) ** 2, 9) <= round((col + 0.5::DOUBLE - q.mx) ** 2 + (row + 0.5::DOUBLE - q.my) ** 2, 9) THEN a ELSE b END AS owner FROM o JOIN m p ON p.zone = a JOIN m q ON q.zone = b"))
def _(s, d):
    z = T.zones(s, d)
    mid = z.select("zone", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return K.split_by_half_planes(J.cells_of_boxes(z), mid, "zone")


@query("ge31_zone_crops", sql("zones", "SELECT zone, CAST(greatest(1, ceil((x1 - x0) / 1.5::DOUBLE)) AS BIGINT) AS nx, CAST(greatest(1, ceil((y1 - y0) / 1.5::DOUBLE)) AS BIGINT) AS ny, CAST(greatest(1, ceil((x1 - x0) / 1.5::DOUBLE)) * greatest(1, ceil((y1 - y0) / 1.5::DOUBLE)) AS BIGINT) AS crops FROM zones"))
def _(s, d):
    return K.crop_grid(T.zones(s, d), 1.5).select("zone", "nx", "ny", "crops")


@query("ge32_segments_or_squares", sql("zones pts", f"+{_TOUCHED}, a AS (SELECT zone, count(*) AS cells FROM touched GROUP BY zone HAVING count(*) >= 4), p AS (SELECT id, CAST(floor(x / 4) AS INT) AS col, CAST(floor(y / 10) AS INT) AS row FROM pts), h AS (SELECT id, min(zone) AS zone FROM p JOIN touched USING (row, col) JOIN a USING (zone) GROUP BY id) SELECT p.id, h.zone, CASE WHEN h.zone IS NULL THEN 'square' ELSE 'segment' END AS kind, coalesce(a.cells, 9) AS cells FROM p LEFT JOIN h USING (id) LEFT JOIN a ON a.zone = h.zone"))
def _(s, d):
    p = T.pts(s, d).select("id", F.floor(F.col("x") / 4).cast("int").alias("col"), F.floor(F.col("y") / 10).cast("int").alias("row"))
    got = K.segments_or_squares(p, J.cells_of_boxes(T.zones(s, d)), "zone", 4, 1)
    return got.groupBy("id", "zone", "kind").agg(F.count(F.lit(1)).alias("cells"))


@query("w3_group_sizes", sql("bands", "SELECT id, polygon_id, count(*) OVER (PARTITION BY polygon_id) AS size, count(*) OVER (PARTITION BY class_name) AS class_size FROM bands"))
def _(s, d):
    b = T.bands(s, d)
    return V.with_size(V.with_size(b.select("id", "polygon_id", "class_name"), ["polygon_id"], "size"), ["class_name"], "class_size").select("id", "polygon_id", "size", "class_size")


_MODELS = {"m0": "b0", "m1": "b1", "m2": "b0 - b1", "m3": "0.8::DOUBLE * b0 - 0.5::DOUBLE * b1 + 0.3::DOUBLE * b2"}


@query("ml22_models_by_score", sql("bands", "+ x AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, CAST(class_name < 3 AS INT) AS t, CAST({f} > 0 AS INT) AS p FROM bands" for m, f in _MODELS.items()) + "), c AS (SELECT model, sum(t * p)::DOUBLE AS tp, sum((1 - t) * p)::DOUBLE AS fp, sum(t * (1 - p))::DOUBLE AS fn, sum((1 - t) * (1 - p))::DOUBLE AS tn FROM x GROUP BY model), s AS (SELECT model, round(tp / (tp + fn) - fp / (fp + tn), 6) AS tss, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c) SELECT model, tss, f1, row_number() OVER (ORDER BY f1 DESC, tss DESC, model) AS place FROM s"))
def _(s, d):
    b = T.bands(s, d)
    scores = {"m0": F.col("b0"), "m1": F.col("b1"), "m2": F.col("b0") - F.col("b1"), "m3": 0.8 * F.col("b0") - 0.5 * F.col("b1") + 0.3 * F.col("b2")}
    rows = b.select((F.col("class_name") < 3).cast("int").alias("t"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (c > 0).cast("int").alias("p")) for m, c in scores.items()])).alias("m")).select("t", "m.*")
    c = K.binary_scores(rows, "model", "t", "p").select("model", r6("tss"), r6("f1"))
    return V.ranked(c, {"f1": True, "tss": True, "model": False}).select("model", "tss", "f1", F.col("place").cast("long").alias("place"))


@query("ml23_mask_ratio", sql("cls", "+ k AS (SELECT row // 5 AS point, col // 9 AS mask, avg(CAST(cls = 1 AS INT)) AS good, count(*) AS cells, avg(CAST(cls < 3 AS INT)) AS sam FROM cls GROUP BY 1, 2) SELECT point, mask, round(good, 6) AS good FROM k WHERE good >= 0.2 QUALIFY row_number() OVER (PARTITION BY point ORDER BY round(good * sam, 9) DESC, mask) = 1"))
def _(s, d):
    m = T.cls(s, d).select(F.floor(F.col("row") / 5).alias("point"), F.floor(F.col("col") / 9).alias("mask"), (F.col("cls") == 1).alias("good"), (F.col("cls") < 3).cast("int").alias("score"))
    return K.choose_mask(m, 0.2).select("point", "mask", r6("good"))


@query("ge17_faces")
def _(s, d):
    faces, _ = FA.polygonise(T.cls(s, d), "cls", 0.75)
    return faces.select("face", "cls", r6("area"), "n_cells")


@query("ge17_area_by_class", sql("cls", "SELECT cls, CAST(count(*) AS DOUBLE) AS area, count(*) AS n_cells FROM cls GROUP BY cls"))
def _(s, d):
    faces, chains = FA.polygonise(T.cls(s, d), "cls")
    ring = FA.face_rings(chains).groupBy("face").agg(F.sum("area").alias("ring_area"))
    return faces.join(ring, "face").groupBy("cls").agg(F.round(F.sum("ring_area"), 6).alias("area"), F.sum("n_cells").alias("n_cells"))
