"""Affine and map coordinates, tiles, chips, densities and clusters of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import radius_pairs
from .lattice import components

#: The sphere of web maps, and the WGS 84 ellipsoid.
HALF = math.pi * 6378137.0
A_WGS, F_WGS, K0 = 6378137.0, 1 / 298.257223563, 0.9996


def to_pixel(x: Column, y: Column, x0: float, y0: float, size: float) -> tuple[Column, Column]:
    """(row, col) of the pixel that holds a point; floor, so that it holds left of the origin too."""
    return F.floor((y0 - y) / size).cast("int"), F.floor((x - x0) / size).cast("int")


def pixel_centre(row: Column, col: Column, x0: float, y0: float, size: float) -> tuple[Column, Column]:
    return x0 + (col + 0.5) * size, y0 - (row + 0.5) * size


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon / 180 * HALF, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) / math.pi * HALF


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x / HALF * 180, F.degrees(2 * F.atan(F.exp(y / HALF * math.pi)) - math.pi / 2)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series to the third order (millimetres within a zone)."""
    n = F_WGS / (2 - F_WGS)
    a = A_WGS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    s = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    sin = F.sin(phi)
    atanh = lambda z: F.log((1 + z) / (1 - z)) / 2
    t = F.sinh(atanh(sin) - s * atanh(s * sin))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, k in enumerate(alpha, 1):
        x = x + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + K0 * a * x, F.when(lat < 0, 10_000_000.0).otherwise(0.0) + K0 * a * y


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    x, y = mercator(lon, lat)
    n = float(1 << zoom)
    return F.floor((x / HALF + 1) / 2 * n).cast("long"), F.floor((1 - y / HALF) / 2 * n).cast("long")


def chip_tiles(chips: DataFrame, zoom: int, radius_m: float) -> DataFrame:
    """(chip_id, z, x, y, off_x, off_y): tiles that a chip around (lon, lat) needs, and their pixel offsets in its window of 256 px tiles."""
    mx, my = mercator(F.col("lon"), F.col("lat"))
    r = radius_m / F.cos(F.radians("lat"))
    px = 256.0 * (1 << zoom) / (2 * HALF)
    c = chips.select("chip_id", F.floor((mx - r + HALF) * px).alias("px0"), F.floor((HALF - my - r) * px).alias("py0"), F.ceil((mx + r + HALF) * px).alias("px1"), F.ceil((HALF - my + r) * px).alias("py1"))
    c = c.select("*", F.explode(F.sequence(F.floor(F.col("px0") / 256), F.floor((F.col("px1") - 1) / 256))).alias("x"))
    c = c.select("*", F.explode(F.sequence(F.floor(F.col("py0") / 256), F.floor((F.col("py1") - 1) / 256))).alias("y"))
    return c.select("chip_id", F.lit(zoom).alias("z"), "x", "y", (F.col("x") * 256 - F.col("px0")).alias("off_x"), (F.col("y") * 256 - F.col("py0")).alias("off_y"))


def clusters(points: DataFrame, link: float) -> DataFrame:
    """(id, comp): single linkage at a distance."""
    return components(radius_pairs(points, link).select("a", "b"), points.select("id"))


def leaders(points: DataFrame, dist: float) -> DataFrame:
    """Points kept so that each other point is within dist of one of smaller id, and no two kept are within dist.

    Rounds: a point with no open neighbour of smaller id is kept, and its neighbours go. All points of a round at once.
    """
    from .lattice import _shared

    pairs = _shared(radius_pairs(points, dist).select("a", "b"), "pairs")
    open_ = _shared(points.select("id"), "open")
    kept = None
    while not open_.isEmpty():
        live = pairs.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(open_.withColumnRenamed("id", "b"), "b", "left_semi")
        now = _shared(open_.join(live.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "kept")
        gone = live.join(now.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        open_ = _shared(open_.join(now, "id", "left_anti").join(gone, "id", "left_anti"), "open")
        kept = now if kept is None else kept.unionByName(now)
    return points.join(kept, "id", "left_semi") if kept is not None else points


def split_groups(points: DataFrame, by: str, max_side: float, least_saving: float = 0.1) -> DataFrame:
    """Cuts groups along x or y while a side is longer than max_side or a cut saves at least that share of the area. Adds part.

    Each round tries the best cut of every group along both axes; groups that need none are done.
    """
    from .lattice import _shared
    from .windows import best_cut

    now = _shared(points.withColumn("part", F.col(by).cast("string")), "parts")
    while True:
        box = now.groupBy("part").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
        box = box.withColumns({"w": F.col("hix") - F.col("lox"), "h": F.col("hiy") - F.col("loy")})
        cuts = best_cut(now.select("part", "id", "x", "y"), "part", "x").select("part", F.lit("x").alias("axis"), "cut", "saving")
        cuts = cuts.unionByName(best_cut(now.select("part", "id", F.col("y").alias("x"), F.col("x").alias("y")), "part", "x").select("part", F.lit("y").alias("axis"), "cut", "saving"))
        area = F.col("w") * F.col("h")
        c = cuts.join(box, "part")
        long_side = F.greatest("w", "h") > max_side
        along = F.when(F.col("w") >= F.col("h"), "x").otherwise("y") == F.col("axis")
        c = c.where((long_side & along) | (~long_side & (area > 0) & (F.col("saving") / area >= least_saving)))
        c = c.groupBy("part").agg(F.max_by(F.struct("axis", "cut"), F.struct("saving", "axis")).alias("c")).select("part", "c.*")
        left = F.when(F.col("axis") == "x", F.col("x") <= F.col("cut")).otherwise(F.col("y") <= F.col("cut"))
        j = now.join(c, "part", "left")
        new = _shared(j.select(*points.columns, F.when(F.col("axis").isNull(), F.col("part")).otherwise(F.concat("part", F.when(left, "a").otherwise("b"))).alias("part")), "parts")
        if new.select("part").distinct().count() == now.select("part").distinct().count():
            return new
        now = new


def density(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gx, gy, density): Gaussian kernel density of points(x, y) at nodes, scaled to [0, 1]. Scott's bandwidth.

    Points are first counted on unit cells, so the pairs are nodes by occupied cells, not by points. The nodes, a coarse
    grid of some hundreds, are broadcast; the cells stay dealt over tasks, and each task adds up its own by node.
    """
    cells = points.groupBy(F.floor("x").alias("px"), F.floor("y").alias("py")).agg(F.count(F.lit(1)).alias("n"))
    m = points.agg(F.count(F.lit(1)).alias("m"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy")).withColumn("f", F.pow("m", F.lit(-1 / 3)))
    s = m.select((F.col("vx") * F.col("f")).alias("sx"), (F.col("vy") * F.col("f")).alias("sy"), (F.col("vxy") * F.col("f")).alias("sxy")).withColumn("det", F.col("sx") * F.col("sy") - F.col("sxy") ** 2)
    dx, dy = F.col("gx") - (F.col("px") + 0.5), F.col("gy") - (F.col("py") + 0.5)
    q = (dx * dx * F.col("sy") - 2 * dx * dy * F.col("sxy") + dy * dy * F.col("sx")) / F.col("det")
    side = cells.crossJoin(F.broadcast(s))
    d = side.crossJoin(F.broadcast(nodes)).groupBy("gx", "gy").agg(F.sum(F.col("n") * F.exp(-q / 2)).alias("d"))
    ends = d.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return d.crossJoin(F.broadcast(ends)).select("gx", "gy", ((F.col("d") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))).alias("density"))


def decode_rle(c: Column) -> Column:
    """Column-major run lengths, off and on in turn, as an array of (start, length) of the on runs."""
    sums = F.transform(c, lambda x, i: F.struct(F.aggregate(F.slice(c, F.lit(1), i), F.lit(0), lambda a, b: a + b).alias("start"), x.alias("length")))
    return F.transform(F.filter(sums, lambda x, i: i % 2 == 1), lambda x: x)


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two grids of one resolution on the intersection of their extents, counted from its corner."""
    ends = lambda df, n: df.agg(*[f(c).alias(f"_{n}{k}{c}") for c in ("row", "col") for f, k in ((F.min, "lo"), (F.max, "hi"))])
    box = ends(a, "a").crossJoin(ends(b, "b"))  # one row each
    box = box.select(*[F.greatest(f"_alo{c}", f"_blo{c}").alias(f"_lo{c}") for c in ("row", "col")], *[F.least(f"_ahi{c}", f"_bhi{c}").alias(f"_hi{c}") for c in ("row", "col")])
    both = a.join(b, ["row", "col"]).crossJoin(F.broadcast(box)).where(F.col("row").between(F.col("_lorow"), F.col("_hirow")) & F.col("col").between(F.col("_locol"), F.col("_hicol")))
    return both.withColumns({c: F.col(c) - F.col(f"_lo{c}") for c in ("row", "col")}).drop("_lorow", "_locol", "_hirow", "_hicol")
