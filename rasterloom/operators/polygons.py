"""Polygons as rings of points, and class boundaries as chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ship import by_group, ship
from .lattice import TILE, _shared, chained, components


def inside_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule for a ring array<struct<x, y>> that doesn't repeat its first point."""
    n = F.size(ring)
    a = lambda i: F.element_at(ring, i)
    b = lambda i: F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))

    def crosses(i: Column) -> Column:
        p, q = a(i), b(i)
        over = (p["y"] > y) != (q["y"] > y)
        return F.when(over, x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], 1.0).otherwise(q["y"] - p["y"]) + p["x"]).otherwise(F.lit(False))

    return F.size(F.filter(F.sequence(F.lit(1), n), crosses)) % 2 == 1


def rasterise(polygons: DataFrame, key: str = "zone", ring: str = "ring") -> DataFrame:
    """(key, row, col): pixels whose centre is inside a polygon. Each polygon is expanded to its own box of pixels, row by row."""
    def axis(c: str) -> Column:
        return F.transform(ring, lambda p: p[c])

    box = polygons.select(key, ring, *[f(axis(c)).alias(f"{n}{c}") for c in "xy" for f, n in ((F.array_min, "lo"), (F.array_max, "hi"))])
    first, last = (lambda c: F.ceil(F.col(f"lo{c}") - 0.5)), (lambda c: F.ceil(F.col(f"hi{c}") - 0.5) - 1)
    span = lambda c: F.when(last(c) >= first(c), F.sequence(first(c), last(c))).otherwise(F.array().cast("array<bigint>"))
    cells = box.select(key, ring, F.explode(span("y")).alias("row"), span("x").alias("_c")).select(key, ring, "row", F.explode("_c").alias("col"))
    return cells.where(inside_ring(F.col(ring), F.col("col") + 0.5, F.col("row") + 0.5)).select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


def boundary_chains(grid: DataFrame, cls: str, tile: int = TILE) -> DataFrame:
    """(chain, left, right, x1, y1, x2, y2): edges between cells of different classes, cut into chains at vertices where other than two edges meet.

    left and right: the two classes, the smaller first; a chain lies between the same two, so both polygons can use it.
    """
    here = grid.select("row", "col", F.col(cls).alias("a"))
    east = here.join(grid.select("row", (F.col("col") - 1).alias("col"), F.col(cls).alias("b")), ["row", "col"]).where("a <> b")
    south = here.join(grid.select((F.col("row") - 1).alias("row"), "col", F.col(cls).alias("b")), ["row", "col"]).where("a <> b")
    pair = [F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")]
    e = east.select(*pair, (F.col("col") + 1).alias("x1"), F.col("row").alias("y1"), (F.col("col") + 1).alias("x2"), (F.col("row") + 1).alias("y2"))
    e = e.unionByName(south.select(*pair, F.col("col").alias("x1"), (F.col("row") + 1).alias("y1"), (F.col("col") + 1).alias("x2"), (F.col("row") + 1).alias("y2")))
    return chained(e.withColumn("id", F.xxhash64("x1", "y1", "x2", "y2")), tile).select("chain", "left", "right", "x1", "y1", "x2", "y2")


def simplified(chains: DataFrame, tolerance: float) -> DataFrame:
    """(chain, left, right, seq, x, y): each chain in order, simplified once by Douglas-Peucker, so that neighbours stay gap-free. Chains come in sorted streams; one chain is walked in one task."""

    def walk(rows: list[dict]) -> list[dict]:
        near: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for a, b, c, d in ((r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows):
            near.setdefault((a, b), []).append((c, d))
            near.setdefault((c, d), []).append((a, b))
        start = min((p for p, n in near.items() if len(n) == 1), default=min(near))
        line, last, at = [start], None, start
        while len(line) <= len(rows):
            step = next((p for p in sorted(near[at]) if p != last), None)
            if step is None:
                break
            last, at = at, step
            line.append(at)
            if at == start:
                break
        same = {c: rows[0][c] for c in ("chain", "left", "right")}
        return [same | {"seq": i, "x": float(x), "y": float(y)} for i, (x, y) in enumerate(peucker(line, tolerance))]

    return by_group(chains, "chain", walk, f"chain long, left {chains.schema['left'].dataType.simpleString()}, right {chains.schema['right'].dataType.simpleString()}, seq int, x double, y double")


def peucker(line: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """The points that stay; ends do. A closed line is cut at its point farthest from the start."""
    if len(line) < 3:
        return line
    if line[0] == line[-1]:
        far = max(range(len(line)), key=lambda i: ((line[i][0] - line[0][0]) ** 2 + (line[i][1] - line[0][1]) ** 2, -i))
        return peucker(line[: far + 1], tolerance)[:-1] + peucker(line[far:], tolerance) if 0 < far < len(line) - 1 else line
    stay, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        i, j = todo.pop()
        (x1, y1), (x2, y2) = line[i], line[j]
        size = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        off = [(abs((x2 - x1) * (y1 - line[k][1]) - (x1 - line[k][0]) * (y2 - y1)) / size if size else 0.0, k) for k in range(i + 1, j)]
        if off and max(off)[0] > tolerance:
            k = max(off, key=lambda o: (o[0], -o[1]))[1]
            stay.add(k)
            todo += [(i, k), (k, j)]
    return [line[i] for i in sorted(stay)]


def reattach(grid: DataFrame, cls: str, steps=None) -> DataFrame:
    """(row, col, cls): of each class the largest part stays; parts cut off from it join the class they share most edges with, ties: the larger class code. A class of one part keeps it whatever its size. Parts of equal size: the one of the first cell stays."""
    from .lattice import FOUR, cell_components, majority_vote

    c = _shared(cell_components(grid.select("row", "col", cls), cls, steps or FOUR), "parts")
    size = c.groupBy("comp", cls).agg(F.count(F.lit(1)).alias("_n"))
    main = size.groupBy(cls).agg(F.max_by("comp", F.struct("_n", -F.col("comp"))).alias("comp"))
    loose = size.join(main, "comp", "left_anti").select("comp")
    vote = majority_vote(c, "comp", cls).join(loose, "comp", "left_semi")
    return c.join(vote.select("comp", "vote"), "comp", "left").select("row", "col", F.coalesce("vote", cls).alias(cls))


def ring_pieces(segments: DataFrame, tile: int = TILE) -> DataFrame:
    """(piece, cls, closed, x, y, xx, yy, n, twice, points): segments walked together tile by tile, in half-cell units; a group is one tile.

    Open pieces run from (x, y) to (xx, yy), which are on a tile's rim or loose; twice is the sum of their segments'
    cross products. Where more than two segments of a class meet in a tile, they are paired in order. piece is the
    smallest number of its segments.
    """
    import numpy as np
    import pandas as pd

    wide = 2 * tile
    e = segments.select("cls", *[F.round(F.col(c) * 2).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])
    # Rims are half a tile off the origin, so that a grid's first row and column aren't one.
    at = lambda c: F.floor((F.least(f"{c}1", f"{c}2") + tile) / wide)
    e = e.withColumns({"id": F.xxhash64("cls", "x1", "y1", "x2", "y2"), "_tr": at("y"), "_tc": at("x")})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y1", "x1", "y2", "x2"], ignore_index=True)
        kinds = pd.factorize(pdf.cls, use_na_sentinel=False)[0]
        n = len(pdf)
        ex, ey = pdf[["x1", "x2"]].to_numpy().ravel(), pdf[["y1", "y2"]].to_numpy().ravel()
        low = lambda v, t: v - (t * wide - tile)
        lx, ly = low(ex, pdf._tc.iloc[0]), low(ey, pdf._tr.iloc[0])
        of = np.repeat(kinds, 2)
        inside = np.flatnonzero((lx > 0) & (lx < wide) & (ly > 0) & (ly < wide))
        order = inside[np.lexsort((inside, lx[inside], ly[inside], of[inside]))]
        new = np.ones(len(order), bool)
        new[1:] = (of[order][1:] != of[order][:-1]) | (ly[order][1:] != ly[order][:-1]) | (lx[order][1:] != lx[order][:-1])
        starts = np.flatnonzero(new)
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        first = np.flatnonzero((place % 2 == 0)[:-1] & ~new[1:])
        mate = np.full(2 * n, -1)
        mate[order[first]], mate[order[first + 1]] = order[first + 1], order[first]
        mates, done, out, xs, ys, ids, cls = mate.tolist(), [False] * n, [], ex.tolist(), ey.tolist(), pdf.id.tolist(), pdf.cls.tolist()
        for begin in [*np.flatnonzero(mate < 0).tolist(), *range(0, 2 * n, 2)]:
            if done[begin >> 1]:
                continue
            end, line, least, twice = begin, [begin], ids[begin >> 1], 0
            while True:
                done[end >> 1] = True
                least = min(least, ids[end >> 1])
                to = end ^ 1
                twice += xs[end] * ys[to] - xs[to] * ys[end]
                line.append(to)
                end = mates[to]
                if end < 0 or done[end >> 1]:
                    break
            out.append((least, cls[begin >> 1], end >= 0, xs[begin], ys[begin], xs[to], ys[to], len(line) - 1, twice, [xs[i] for i in line], [ys[i] for i in line]))
        return pd.DataFrame(out, columns=["piece", "cls", "closed", "x", "y", "xx", "yy", "n", "twice", "px", "py"])

    ship(segments.sparkSession)
    kind = segments.schema["cls"].dataType.simpleString()
    return _shared(e.groupBy("_tr", "_tc").applyInPandas(walk, f"piece long, cls {kind}, closed boolean, x long, y long, xx long, yy long, n long, twice long, px array<long>, py array<long>"), "pieces")


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """(ring, cls, n, twice, piece, seq, back) of ring_pieces(): closed rings as the pieces that make them, in order; back: a piece runs against its ring. Pieces that close alone are rings. A group is one ring's pieces, without their points."""
    own = pieces.where("closed").select(F.col("piece").alias("ring"), "cls", "n", "twice", "piece", F.lit(0).alias("seq"), F.lit(False).alias("back"))
    loose = pieces.where("NOT closed").drop("px", "py")
    ends = loose.select("piece", "cls", "x", "y").unionByName(loose.select("piece", "cls", F.col("xx").alias("x"), F.col("yy").alias("y")))
    w = W.partitionBy("cls", "x", "y")
    ends = ends.withColumn("_i", F.floor((F.row_number().over(w.orderBy("piece")) - 1) / 2))
    met = ends.groupBy("cls", "x", "y", "_i").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).where("a <> b")
    named = loose.join(components(met.select("a", "b"), loose.select(F.col("piece").alias("id"))), F.col("piece") == F.col("id")).withColumnRenamed("comp", "ring")

    def order(rows: list[dict]) -> list[dict]:
        at: dict[tuple[int, int], list[int]] = {}
        for i, r in enumerate(sorted(rows, key=lambda r: r["piece"])):
            for p in ((r["x"], r["y"]), (r["xx"], r["yy"])):
                at.setdefault(p, []).append(i)
        rows = sorted(rows, key=lambda r: r["piece"])
        out, left = [], set(range(len(rows)))
        for first in range(len(rows)):
            if first not in left:
                continue
            i, start, line = first, (rows[first]["x"], rows[first]["y"]), []
            end = start
            while i is not None:
                left.discard(i)
                r = rows[i]
                back = (r["x"], r["y"]) != end
                end = (r["x"], r["y"]) if back else (r["xx"], r["yy"])
                line.append((i, back))
                i = next((j for j in at[end] if j in left), None)
            if end == start:
                ring, n = min(rows[i]["piece"] for i, _ in line), sum(rows[i]["n"] for i, _ in line)
                twice = sum(-rows[i]["twice"] if back else rows[i]["twice"] for i, back in line)
                out += [{"ring": ring, "cls": rows[i]["cls"], "n": n, "twice": twice, "piece": rows[i]["piece"], "seq": k, "back": back} for k, (i, back) in enumerate(line)]
        return out

    kind = pieces.schema["cls"].dataType.simpleString()
    put = by_group(named.drop("id", "closed"), "ring", order, f"ring long, cls {kind}, n long, twice long, piece long, seq int, back boolean")
    return _shared(own.unionByName(put).where("n > 2"), "rings")


def ring_measures(pieces: DataFrame, joined: DataFrame, band: int = 64) -> DataFrame:
    """(ring, cls, n, area, inside) of rings as pieces. No ring is gathered.

    Along a line through a ring's leftmost point, the sides of other rings to its right are counted: an odd number holds
    it. Sides and points meet in bands of rows, and a group is a class's band, so work grows with the sides.
    """
    import numpy as np
    import pandas as pd

    lines = pieces.select("piece", "cls", "px", "py").join(joined.select("ring", "piece", (F.abs("twice") / 8).alias("area")), "piece").select("ring", "cls", "area", "px", "py")
    k = F.posexplode(F.slice("px", 1, F.size("px") - 1)).alias("_i", "x1")
    sides = lines.select("ring", "cls", "area", "px", "py", k).select("ring", "cls", "area", "x1", F.get("py", F.col("_i")).alias("y1"), F.get("px", F.col("_i") + 1).alias("x2"), F.get("py", F.col("_i") + 1).alias("y2")).where("y1 <> y2")
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2") - 1
    sides = sides.withColumn("_b", F.explode(F.sequence(F.floor(lo / band), F.floor(hi / band))))
    first = lines.select("ring", "cls", "area", F.array_min(F.arrays_zip("px", "py")).alias("p")).groupBy("ring").agg(F.first("cls").alias("cls"), F.first("area").alias("area"), F.min("p").alias("p"))
    points = first.select("ring", "cls", "area", F.col("p.px").alias("x1"), F.col("p.py").alias("y1"), F.lit(None).cast("long").alias("x2"), F.lit(None).cast("long").alias("y2"), F.floor(F.col("p.py") / band).alias("_b"))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf.x2.isna().to_numpy()
        q, s = pdf[asks], pdf[~asks]
        if q.empty:
            return pd.DataFrame({"ring": [], "inside": []})
        at = np.unique(q.y1.to_numpy())
        y1, y2 = s.y1.to_numpy(), s.y2.to_numpy()
        a, b = np.searchsorted(at, np.minimum(y1, y2)), np.searchsorted(at, np.maximum(y1, y2))
        side = np.repeat(np.arange(len(s)), b - a)
        line = np.arange(len(side)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[side]
        x1, x2 = s.x1.to_numpy()[side], s.x2.to_numpy()[side]
        x = (x2 - x1) * (at[line] - y1[side]) / (y2[side] - y1[side]) + x1
        lines, xs = np.append(line, np.searchsorted(at, q.y1)), np.append(x, q.x1)
        ask, ring, area = np.append(np.zeros(len(x), bool), np.ones(len(q), bool)), np.append(s.ring.to_numpy()[side], q.ring), np.append(s.area.to_numpy()[side], q.area)
        order = np.lexsort((~ask, -xs, lines))
        out, now, open_ = [], -1, {}
        for i, asked, r, size in zip(lines[order].tolist(), ask[order].tolist(), ring[order].tolist(), area[order].tolist()):
            if i != now:
                now, open_ = i, {}
            if asked:
                out.append((r, sum(other > size for o, other in open_.items() if o != r)))
            elif open_.pop(r, None) is None:
                open_[r] = size
        return pd.DataFrame(out, columns=["ring", "inside"])

    depth = sides.unionByName(points.select(*sides.columns)).groupBy("cls", "_b").applyInPandas(sweep, "ring long, inside long")
    return joined.where("seq = 0").select("ring", "cls", "n", (F.abs("twice") / 8).alias("area")).join(depth, "ring")


def rings(segments: DataFrame, smooth: int = 0, tile: int = TILE) -> DataFrame:
    """(ring, cls, n, area, points, inside) of directed or undirected segments(cls, x1, y1, x2, y2) in half-cell units: closed rings, smoothed by Chaikin's corner cutting so many times.

    n, area and inside are of the unsmoothed ring: inside says how many other, larger rings of the class hold it, so even
    ones are outer borders and odd ones holes. Rings are walked in tiles and joined at their rims; only their points are
    put together in one task a ring. ring_measures() does without.
    """
    import numpy as np

    pieces = ring_pieces(segments, tile)
    joined = joined_pieces(pieces)

    def put(rows: list[dict]) -> dict:
        line: list[tuple[int, int]] = []
        for r in sorted(rows, key=lambda r: r["seq"]):
            part = list(zip(r["px"], r["py"]))
            line += (part[::-1] if r["back"] else part)[:-1]
        i = line.index(min(line))
        p = np.array(line[i:] + line[:i], float) / 2
        for _ in range(smooth):
            q = np.roll(p, -1, axis=0)
            p = np.stack([0.75 * p + 0.25 * q, 0.25 * p + 0.75 * q], axis=1).reshape(-1, 2)
        return {"ring": rows[0]["ring"], "points": [{"x": x, "y": y} for x, y in p.tolist()]}

    points = by_group(joined.select("ring", "piece", "seq", "back").join(pieces.select("piece", "px", "py"), "piece"), "ring", put, "ring long, points array<struct<x:double,y:double>>")
    return ring_measures(pieces, joined).join(points, "ring").select("ring", "cls", "n", "area", "points", "inside")
