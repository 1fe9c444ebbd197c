"""Class maps as polygons: chains that neighbours share, half-edges, rings with their holes, and classes by majority.

A face is a connected set of cells of one class (4 neighbours). Each side of a cell between two faces, or between a face
and nothing, is an edge with the smaller face on its left (x to the right, y downwards, rings of a face run as its
cells' corners (0, 0), (1, 0), (1, 1), (0, 1) do). Edges are cut into chains where other than two meet; a chain is
simplified once and used by both its faces, so no gap or overlap can arise, whatever the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ship import by_group, ship
from ..ship import stored as _shared
from .lattice import FOUR, TILE, cell_components, chained, components, label_edges
from .polygons import peucker

#: The face of what is outside the grid; no cell has this number.
OUTSIDE = -(1 << 63)
#: Directions as numbers; one more is a turn to the left.
QUARTERS = {(1, 0): 0, (0, 1): 1, (-1, 0): 2, (0, -1): 3}


def border_edges(cells: DataFrame, face: str = "comp") -> DataFrame:
    """(left, right, x1, y1, x2, y2) of cells(row, col, face): each side between two faces once, the smaller face to its left; sides of the grid have OUTSIDE to their right."""

    def beside(by: str, along: str, step: int) -> Column:
        w = W.partitionBy(by).orderBy(along)
        near = F.lag(F.struct(along, "face"), -step).over(w)
        return F.coalesce(F.when(near[along] == F.col(along) + step, near["face"]), F.lit(OUTSIDE))

    at = cells.select("row", "col", F.col(face).alias("face"))
    at = at.withColumns({"w": beside("row", "col", -1), "e": beside("row", "col", 1)}).withColumns({"n": beside("col", "row", -1), "s": beside("col", "row", 1)})
    corner = lambda dx, dy: ((F.col("col") + dx), (F.col("row") + dy))
    side = lambda near, a, b: F.struct(F.col(near).alias("right"), a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    sides = F.array(side("n", corner(0, 0), corner(1, 0)), side("e", corner(1, 0), corner(1, 1)), side("s", corner(1, 1), corner(0, 1)), side("w", corner(0, 1), corner(0, 0)))
    kept = F.filter(sides, lambda s: (s["right"] == OUTSIDE) | (s["right"] > F.col("face")))
    return at.select(F.col("face").alias("left"), F.inline(kept))


def face_chains(grid: DataFrame, cls: str, tolerance: float = 0.0, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(cells, chains): the grid with comp, its faces; and (chain, left, right, first, last, points), points an array<struct<x, y>> in order with the face `left` on the left; first and last are the directions of the first and last side before points went.

    Chains are simplified by Douglas and Peucker's rule; those of the grid's outline lose only points on straight lines,
    so the faces always cover what the cells cover. Chains of a face that the rule would leave without an area, or turn
    over, keep their corners, which is looked at again until no such face is left. A chain is walked in one task;
    borders between the same two faces end where a third face is met.
    """
    cells = _shared(cell_components(grid.select("row", "col", cls), cls, FOUR, tile=tile), "faces")
    named = chained(border_edges(cells).withColumn("id", F.xxhash64("x1", "y1", "x2", "y2")), tile).drop("id")

    def walk(rows: list[dict]) -> dict:
        after = {(r["x1"], r["y1"]): (r["x2"], r["y2"]) for r in rows}
        line = [min(((r["x1"], r["y1"]) for r in rows if r["node"]), default=min(after))]
        while (to := after.pop(line[-1], None)) is not None:
            line.append(to)
        corners = peucker(line, 0.0)
        keep = corners if rows[0]["right"] == OUTSIDE else peucker(line, tolerance)
        way = lambda p, q: QUARTERS[q[0] - p[0], q[1] - p[1]]
        points = lambda k: [{"x": float(x), "y": float(y)} for x, y in k]
        return {c: rows[0][c] for c in ("chain", "left", "right")} | {"first": way(*line[:2]), "last": way(*line[-2:]), "points": points(keep), "corners": points(corners)}

    line = "array<struct<x:double,y:double>>"
    chains = _shared(by_group(named, "chain", walk, f"chain long, left long, right long, first int, last int, points {line}, corners {line}"), "chains")
    while tolerance > 0 and not (lost := _shared(face_areas(chains).where(F.col("area") <= 1e-9).select("face"), "lost")).isEmpty():
        ends = chains.select("chain", F.explode(F.array("left", "right")).alias("face"))
        again = ends.join(lost, "face", "left_semi").select("chain").distinct().withColumn("again", F.lit(True))
        chains = _shared(chains.join(again, "chain", "left").withColumn("points", F.when(F.col("again"), F.col("corners")).otherwise(F.col("points"))).drop("again"), "chains")
    return cells, chains.drop("corners")


def segments(chains: DataFrame) -> DataFrame:
    """(left, right, x1, y1, x2, y2): the straight parts of chains."""
    n = F.size("points")
    parts = F.arrays_zip(F.slice("points", 1, n - 1).alias("p"), F.slice("points", 2, n - 1).alias("q"))
    return chains.select("left", "right", F.explode(parts).alias("s")).select("left", "right", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def face_areas(chains: DataFrame) -> DataFrame:
    """(face, area): sums over straight parts, each counted for the face on either side, so no ring is gathered."""
    half = segments(chains).withColumn("a", (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2)
    both = half.select(F.col("left").alias("face"), "a").unionByName(half.where(F.col("right") != OUTSIDE).select(F.col("right").alias("face"), (-F.col("a")).alias("a")))
    return both.groupBy("face").agg(F.sum("a").alias("area"))


def faces_of_cells(cells: DataFrame, chains: DataFrame) -> DataFrame:
    """(row, col, face): in which face of the chains each cell's centre is; one on a border is in the face with larger x.

    Along a row of cells a face's borders are added up, and what lies between two of them belongs to it while the sum is
    positive. Over all faces the sums make 1, so every cell is in a face; where simplified chains cross and it is in
    several, the smallest counts. A window is over one face's borders in one row.
    """
    # Down the page the left face has the smaller x. Each part is taken from its upper end, so equal ones meet a row in the same place.
    down = F.col("y2") > F.col("y1")
    side = lambda a, b: F.when(down, F.col(a)).otherwise(F.col(b))
    s = segments(chains).where("y1 <> y2").select(side("left", "right").alias("before"), side("right", "left").alias("behind"), *[side(f"{c}{i}", f"{c}{3 - i}").alias(f"{c}{i}") for c in "xy" for i in (1, 2)])
    first, last = F.ceil(F.col("y1") - 0.5), F.ceil(F.col("y2") - 0.5) - 1
    s = s.where(last >= first).withColumn("row", F.explode(F.sequence(first, last)))
    x = F.round(F.col("x1") + (F.col("row") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")), 9)
    ends = F.array(F.struct(F.col("behind").alias("face"), F.lit(1).alias("d")), F.struct(F.col("before").alias("face"), F.lit(-1).alias("d")))
    met = s.select("row", x.alias("x"), F.inline(ends)).where(F.col("face") != OUTSIDE).groupBy("row", "face", "x").agg(F.sum("d").alias("d"))
    w = W.partitionBy("row", "face").orderBy("x")
    spans = met.select("row", "face", F.sum("d").over(w).alias("n"), F.ceil(F.col("x") - 0.5).alias("a"), (F.ceil(F.lead("x").over(w) - 0.5) - 1).alias("b")).where("n > 0 AND b >= a")
    inside = spans.select("row", "face", F.explode(F.sequence("a", "b")).alias("col")).groupBy("row", "col").agg(F.min("face").alias("face"))
    return cells.select("row", "col").join(inside.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "face"), ["row", "col"])


def polygonise(grid: DataFrame, cls: str, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(faces, chains): (face, cls, area, n_cells) of each face, and the chains.

    cls is the class of most cells whose centres are inside, of equals the smaller; of a face without a centre inside,
    its own cells' class. Areas add up to the grid's number of cells.
    """
    cells, chains = face_chains(grid, cls, tolerance)
    inside = faces_of_cells(cells, chains).join(cells.select("row", "col", cls), ["row", "col"])
    votes = inside.groupBy("face", cls).agg(F.count(F.lit(1)).alias("n"))
    most = votes.groupBy("face").agg(F.min_by(cls, F.struct(-F.col("n"), F.col(cls))).alias("vote"), F.sum("n").alias("n_cells"))
    own = cells.groupBy(F.col("comp").alias("face")).agg(F.min(cls).alias("own"))
    out = face_areas(chains).join(own, "face").join(most, "face", "left")
    return out.select("face", F.coalesce("vote", "own").alias(cls), "area", F.coalesce("n_cells", F.lit(0).cast("long")).alias("n_cells")), chains


def cycles(steps: DataFrame) -> DataFrame:
    """(id, comp) of steps(id, next, _ty, _tx): the smallest id of each cycle. Steps inside a tile are joined in one task (a group is one tile); components() sees those between tiles."""
    import numpy as np
    import pandas as pd

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ids, to = pdf.id.to_numpy(), pdf.next.to_numpy()
        at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        held = ids[at] == to
        part = ids[label_edges(len(ids), np.flatnonzero(held), at[held])]
        out = pd.array(to, "Int64")
        out[held] = pd.NA
        return pd.DataFrame({"id": ids, "part": part, "out": out})

    ship(steps.sparkSession)
    parts = _shared(steps.groupBy("_ty", "_tx").applyInPandas(join, "id long, part long, out long"), "parts")
    met = parts.where("out IS NOT NULL").select(F.col("part").alias("a"), "out").join(parts.select("id", F.col("part").alias("b")), F.col("out") == F.col("id")).where("a <> b").select("a", "b")
    edges = _shared(met.distinct(), "edges")
    roots = components(edges, edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct())
    return parts.join(roots.select(F.col("id").alias("part"), "comp"), "part", "left").select("id", F.coalesce("comp", "part").alias("comp"))


def face_rings(chains: DataFrame, tile: int = TILE) -> DataFrame:
    """(face, ring, hole, area, points): the closed rings of each face, by half-edges; a hole's area is negative.

    Each chain is a half-edge of both its faces. Behind it comes the half-edge of the same face from the node where it
    ends; where a face touches itself in a corner, the one that turns back around the same cell. Rings are the cycles of
    these steps. A ring's chains are put together in one task.
    """
    back = lambda c: (F.col(c) + 2) % 4
    half = chains.select("chain", F.col("left").alias("face"), "first", "last", "points", F.lit(0).alias("back"))
    half = half.unionByName(chains.where(F.col("right") != OUTSIDE).select("chain", F.col("right").alias("face"), back("last").alias("first"), back("first").alias("last"), F.reverse("points").alias("points"), F.lit(1).alias("back")))
    half = _shared(half.withColumn("id", F.xxhash64("chain", "back")), "halves")
    end = lambda i: F.element_at("points", i)
    a, b = half.select("id", "face", end(-1).alias("at"), "last"), half.select(F.col("id").alias("next"), "face", end(1).alias("at"), "first")
    # Left, straight on, right, and back.
    turn = (F.col("first") - F.col("last") + 6) % 4
    steps = _shared(a.join(b, ["face", "at"]).groupBy("id").agg(F.max_by("next", turn).alias("next")), "steps")
    ring = cycles(steps.join(half.select("id", *[F.floor(end(1)[c] / tile).alias(f"_t{c}") for c in "xy"]), "id"))
    whole = half.join(steps, "id").join(ring, "id").select("face", F.col("comp").alias("ring"), "id", "next", "points")

    def put(rows: list[dict]) -> dict:
        after, of = {r["id"]: r["next"] for r in rows}, {r["id"]: r["points"] for r in rows}
        at, line = min(after), []
        while (to := after.pop(at, None)) is not None:
            line += of[at][:-1]
            at = to
        area = sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(line, line[1:] + line[:1])) / 2
        return {"face": rows[0]["face"], "ring": rows[0]["ring"], "hole": area < 0, "area": area, "points": line}

    return by_group(whole, "ring", put, "face long, ring long, hole boolean, area double, points array<struct<x:double,y:double>>")
