"""Joins of points, pixels, zones and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))
EIGHT = FOUR + ((-1, -1), (-1, 1), (1, -1), (1, 1))


def offsets(df: DataFrame, steps: tuple[tuple[int, int], ...]) -> DataFrame:
    """Repeats each row for each step, with dr and dc."""
    return df.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps]))).select(*df.columns, "_d.dr", "_d.dc")


def neighbours(grid: DataFrame, value: str, steps: tuple[tuple[int, int], ...] = FOUR) -> DataFrame:
    """(row, col, value, dr, dc, near): each cell with each neighbour that exists. One equi-join on the cell."""
    here = offsets(grid.select("row", "col", value), steps).withColumns({"_r": F.col("row") + F.col("dr"), "_c": F.col("col") + F.col("dc")})
    there = grid.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("near"))
    return here.join(there, ["_r", "_c"]).drop("_r", "_c")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df in as many partitions as shuffles have, by hash of the columns. Rows that multiply afterwards, or compress well, are else left to one task: a small file is one, partitions are merged by their stored size, and a side that looks small is broadcast."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def sample_at(points: DataFrame, grid: DataFrame, how: str = "inner") -> DataFrame:
    return points.join(grid, ["row", "col"], how)


def lookup_two_tier(df: DataFrame, code: str, lookup: DataFrame, key: str, value: str, modulus: int = 1000) -> DataFrame:
    """Adds value by the exact code, else by the code modulo modulus. lookup is a legend: a few hundred rows."""
    exact = lookup.select(F.col(key).alias("_k1"), F.col(value).alias("_v1"))
    rest = lookup.select(F.col(key).alias("_k2"), F.col(value).alias("_v2"))
    out = df.join(exact, F.col(code) == F.col("_k1"), "left").join(rest, F.col(code) % modulus == F.col("_k2"), "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_v1", "_k2", "_v2")


def cell_of(x: Column, size: float) -> Column:
    return F.floor(x / size)


def radius_pairs(points: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """(a, b, dist), a < b: pairs of points within radius. Points meet on grid cells of that size; one side looks at its own cell and at four of the eight around, the others look at it. A task holds the points of its cells once; the repeated side streams by."""
    a = points.select(F.col(key).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell_of(F.col("x"), radius).alias("cx"), cell_of(F.col("y"), radius).alias("cy"))
    b = points.select(F.col(key).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell_of(F.col("x"), radius).alias("row"), cell_of(F.col("y"), radius).alias("col"))
    b = offsets(b, tuple(s for s in EIGHT if s > (0, 0)) + ((0, 0),)).select("b", "bx", "by", (F.col("row") + F.col("dr")).alias("cx"), (F.col("col") + F.col("dc")).alias("cy"), ((F.col("dr") == 0) & (F.col("dc") == 0)).alias("same"))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    once = F.when(F.col("same"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    met = dealt(b, "cx", "cy").join(dealt(a, "cx", "cy").hint("shuffle_hash"), ["cx", "cy"]).where(once).withColumn("dist", d).where(F.col("dist") <= radius)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist")


def nearest(left: DataFrame, right: DataFrame, on: str, reach: float | None = None, size: int = 2048) -> DataFrame:
    """(id, near, dist, n_inside): for each left point the nearest right point of the same key, ties by the smaller id, and how many are within reach (without one: in the same place). Points with a null key or coordinate, and left points whose key has no right point, have no row.

    Right points of a key are cut along x into blocks of about `size` rows, by ranges over the whole table, which are
    described by their smallest and largest x and y. A left point goes to the blocks that may have its nearest point or
    the edge of its reach; blocks wholly inside the reach only add their number of rows. In a block, rows are ordered by
    y and x, and ends of runs within reach are found by binary search.
    """
    import numpy as np
    import pandas as pd

    from ..ship import ship, stored

    reach = 0.0 if reach is None else reach
    kind, key = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    right = right.select(F.col(on).alias("_on"), F.col("id").alias("_id"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).where("_on IS NOT NULL AND _x IS NOT NULL AND _y IS NOT NULL")
    left = left.select(F.col(on).alias("_on"), "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    place = F.row_number().over(W.partitionBy("_on").orderBy("_x", "_id"))
    right = stored(right.withColumn("_block", F.floor((place - 1) / size)), "right")
    ends = [f(c).alias(f"{c}{i}") for c in ("_x", "_y") for i, f in ((0, F.min), (1, F.max))]
    blocks = right.groupBy("_on", "_block").agg(F.count(F.lit(1)).alias("_n"), *ends)
    apart = lambda c: F.greatest(F.col(f"_{c}0") - F.col(c), F.col(c) - F.col(f"_{c}1"), F.lit(0.0))
    over = lambda c: F.greatest(F.col(c) - F.col(f"_{c}0"), F.col(f"_{c}1") - F.col(c))
    met = left.join(blocks, "_on").withColumns({"_least": F.sqrt(apart("x") ** 2 + apart("y") ** 2), "_most": F.sqrt(over("x") ** 2 + over("y") ** 2)})
    met = met.withColumn("_bound", F.min("_most").over(W.partitionBy("id")))
    may, whole = F.col("_least") <= F.col("_bound"), F.col("_most") <= reach
    met = stored(met.where(may | (F.col("_least") <= reach)).select("_on", "_block", "id", "x", "y", "_n", (whole & ~may).alias("_whole")), "met")

    def search(asked: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        x, y, n, m = asked.x.to_numpy(), asked.y.to_numpy(), len(asked), len(have)
        best, near, inside = np.full(n, np.inf), np.full(n, -1), np.zeros(n, np.int64)
        if not n or not m:
            return pd.DataFrame({"id": asked.id[:0], "near": have._id[:0], "dist": best[:0], "n_inside": inside[:0]})
        have = have.sort_values(["_y", "_x", "_id"], ignore_index=True)
        hx, hy, ids = have._x.to_numpy(), have._y.to_numpy(), have._id.to_numpy()
        starts = np.flatnonzero(np.append(True, hy[1:] != hy[:-1]))
        for a, b in zip(starts.tolist(), np.append(starts[1:], m).tolist()):
            line, dy2 = hx[a:b], (y - hy[a]) ** 2
            far = lambda i: np.sqrt((x - line[i]) ** 2 + dy2)
            # The first of equal x has the smallest id; of the two sides the nearer.
            after = np.searchsorted(line, x)
            for i in (np.minimum(after, b - a - 1), np.searchsorted(line, line[np.maximum(after - 1, 0)])):
                d = far(i)
                better = (d < best) | ((d == best) & (ids[a + i] < ids[near]))
                best[better], near[better] = d[better], (a + i)[better]
            # Distances grow to both sides of x, so the ends of what is within reach are found by halving, by the distance itself.
            low, high = np.zeros(n, np.int64), after.copy()
            while (open_ := low < high).any():
                mid = (low + high) // 2
                ok = far(np.minimum(mid, b - a - 1)) <= reach
                low, high = np.where(open_ & ~ok, mid + 1, low), np.where(open_ & ok, mid, high)
            first, low, high = low, after.copy(), np.full(n, b - a)
            while (open_ := low < high).any():
                mid = (low + high) // 2
                ok = far(np.minimum(mid, b - a - 1)) <= reach
                low, high = np.where(open_ & ok, mid + 1, low), np.where(open_ & ~ok, mid, high)
            inside += low - first
        return pd.DataFrame({"id": asked.id.to_numpy(), "near": ids[near], "dist": best, "n_inside": inside})

    ship(left.sparkSession)
    asked = met.where("NOT _whole").groupBy("_on", "_block").cogroup(right.groupBy("_on", "_block"))
    found = asked.applyInPandas(search, f"id {kind}, near {key}, dist double, n_inside long")
    found = found.unionByName(met.where("_whole").select("id", F.lit(None).cast(key).alias("near"), F.lit(None).cast("double").alias("dist"), F.col("_n").alias("n_inside")))
    return found.groupBy("id").agg(F.min(F.when(F.col("dist").isNotNull(), F.struct("dist", "near"))).alias("b"), F.sum("n_inside").alias("n_inside")).select("id", F.col("b.near").alias("near"), F.col("b.dist").alias("dist"), "n_inside")


def cells_of_boxes(zones: DataFrame, touched: bool = True, keep: tuple[str, ...] = ("zone",)) -> DataFrame:
    """(zone, row, col): the pixels of boxes (x0, y0, x1, y1): all they touch, or those with their centre inside."""
    if touched:
        r0, r1 = F.floor("y0"), F.ceil("y1") - 1
        c0, c1 = F.floor("x0"), F.ceil("x1") - 1
    else:
        r0, r1 = F.ceil(F.col("y0") - 0.5), F.ceil(F.col("y1") - 0.5) - 1
        c0, c1 = F.ceil(F.col("x0") - 0.5), F.ceil(F.col("x1") - 0.5) - 1
    span = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    out = dealt(zones, "y0", "x0").select(*keep, F.explode(span(r0, r1)).alias("row"), c0.alias("_c0"), c1.alias("_c1"))
    out = out.select(*keep, "row", F.explode(span(F.col("_c0"), F.col("_c1"))).alias("col"))
    return out.withColumns({c: F.col(c).cast("int") for c in ("row", "col")})


def zonal_cells(zones: DataFrame, small: int = 10, fewest: int = 3, keep: tuple[str, ...] = ("zone",)) -> DataFrame:
    """(zone, row, col): touched pixels for zones of fewer than `small` of them; else those with their centre inside, unless these are fewer than `fewest`."""
    touched, centre = cells_of_boxes(zones, True, keep), cells_of_boxes(zones, False, keep)
    nt, nc = touched.groupBy("zone").agg(F.count(F.lit(1)).alias("_nt")), centre.groupBy("zone").agg(F.count(F.lit(1)).alias("_nc"))
    use = nt.join(nc, "zone", "left").select("zone", ((F.col("_nt") < small) | (F.coalesce("_nc", F.lit(0)) < fewest)).alias("_t"))
    return touched.join(use.where("_t"), "zone", "left_semi").unionByName(centre.join(use.where("NOT _t"), "zone", "left_semi"))


def box_pairs(boxes: DataFrame, tile: float = 4.0, key: str = "zone") -> DataFrame:
    """(a, b, area), a < b: boxes whose interiors meet. They meet on tiles; a pair counts in the tile of its lower left corner."""
    b = boxes.select(key, "x0", "y0", "x1", "y1")
    tiles = b.select("*", F.explode(F.sequence(F.floor(F.col("x0") / tile), F.floor(F.col("x1") / tile))).alias("tx")).select("*", F.explode(F.sequence(F.floor(F.col("y0") / tile), F.floor(F.col("y1") / tile))).alias("ty"))
    left, right = (tiles.select("tx", "ty", *[F.col(c).alias(f"{p}{c}") for c in (key, "x0", "y0", "x1", "y1")]) for p in "lr")
    w = F.least("lx1", "rx1") - F.greatest("lx0", "rx0")
    h = F.least("ly1", "ry1") - F.greatest("ly0", "ry0")
    met = left.join(right, ["tx", "ty"]).where((F.col(f"l{key}") < F.col(f"r{key}")) & (w > 0) & (h > 0))
    first = (F.floor(F.greatest("lx0", "rx0") / tile) == F.col("tx")) & (F.floor(F.greatest("ly0", "ry0") / tile) == F.col("ty"))
    return met.where(first).select(F.col(f"l{key}").alias("a"), F.col(f"r{key}").alias("b"), (w * h).alias("area"))


def resample(grid: DataFrame, value: str, factor: float, how: str) -> DataFrame:
    """(row, col, value) on a grid `factor` times coarser: nearest, average or mode (ties: the smaller)."""
    if how == "nearest":
        # The source cell that holds the target cell's centre.
        size = grid.select((F.floor(F.col("row") / factor)).cast("int").alias("row"), (F.floor(F.col("col") / factor)).cast("int").alias("col")).distinct()
        ask = size.select("row", "col", F.floor((F.col("row") + 0.5) * factor).cast("int").alias("_r"), F.floor((F.col("col") + 0.5) * factor).cast("int").alias("_c"))
        src = grid.select(F.col("row").alias("_r"), F.col("col").alias("_c"), value)
        return ask.join(src, ["_r", "_c"]).select("row", "col", value)
    to = grid.select(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col"), value)
    if how == "average":
        return to.groupBy("row", "col").agg(F.avg(value).alias(value))
    n = to.groupBy("row", "col", value).count()
    return n.groupBy("row", "col").agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(value))


def bilinear(points: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """Adds value at (x, y) in pixel units (centres at .5) from the four cells around; null where one is missing."""
    fx, fy = F.col("x") - 0.5, F.col("y") - 0.5
    p = points.withColumns({"_c": F.floor(fx).cast("int"), "_r": F.floor(fy).cast("int"), "_u": fx - F.floor(fx), "_v": fy - F.floor(fy)})
    four = p.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (0, 1) for b in (0, 1)])))
    w = F.when(F.col("_d.dr") == 1, F.col("_v")).otherwise(1 - F.col("_v")) * F.when(F.col("_d.dc") == 1, F.col("_u")).otherwise(1 - F.col("_u"))
    four = four.withColumns({"_w": w, "row": F.col("_r") + F.col("_d.dr"), "col": F.col("_c") + F.col("_d.dc")})
    met = four.join(grid.select("row", "col", value), ["row", "col"])
    got = met.groupBy(*points.columns).agg(F.sum(F.col("_w") * F.col(value)).alias(value), F.count(F.lit(1)).alias("_n"))
    return got.where("_n = 4").drop("_n")


def priority_overlay(layers: list[DataFrame], value: str) -> DataFrame:
    """(row, col, value): the first layer's value that isn't null or zero."""
    each = [d.select("row", "col", value, F.lit(i).alias("_p")) for i, d in enumerate(layers)]
    out = each[0]
    for d in each[1:]:
        out = out.unionByName(d)
    return out.where(F.coalesce(F.col(value), F.lit(0)) != 0).groupBy("row", "col").agg(F.min_by(value, "_p").alias(value))


def longest_border(grid: DataFrame, label: str) -> DataFrame:
    """(label, near, edges): the label that each label shares most cell edges with; ties: the smaller."""
    e = neighbours(grid, label, FOUR).where(F.col(label) != F.col("near")).groupBy(label, "near").agg(F.count(F.lit(1)).alias("edges"))
    best = F.row_number().over(W.partitionBy(label).orderBy(F.desc("edges"), "near"))
    return e.withColumn("_n", best).where("_n = 1").drop("_n")
