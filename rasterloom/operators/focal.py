"""Focal operators on grids: kernels, boxes, terrain derivatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Half a tenth of a degree and so on: fixed values of the terrain formulas.
FLAT, SUN_AZIMUTH, SUN_HEIGHT = 1e-9, 315.0, 45.0


def box(grid: DataFrame, radius: int, sums: dict[str, Column], how: str = "sum") -> DataFrame:
    """Adds, for each name, the sum (or min, max) of its expression over the cells that exist within radius in both axes.

    Two passes of RANGE frames, along rows and then along columns: each cell is read once per pass, whatever the
    radius. A row or column of the grid is one window.
    """
    f = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    cols = [c for c in grid.columns if c not in sums]
    # The frame sees missing cells as gaps, so RANGE and not ROWS; cells of a full lattice are needed for pass two.
    along = W.partitionBy("row").orderBy("col").rangeBetween(-radius, radius)
    across = W.partitionBy("col").orderBy("row").rangeBetween(-radius, radius)
    lattice = _lattice(grid)
    full = lattice.join(grid.withColumns({f"_{k}": c for k, c in sums.items()}), ["row", "col"], "left")
    one = full.withColumns({f"_{k}": f(f"_{k}").over(along) for k in sums})
    two = one.withColumns({k: f(f"_{k}").over(across) for k in sums}).drop(*[f"_{k}" for k in sums])
    return two.where(F.col("_here")).select(*cols, *sums)


def _lattice(grid: DataFrame) -> DataFrame:
    """All cells between the grid's first and last column, for each of its rows."""
    ends = grid.agg(F.min("col").alias("_lo"), F.max("col").alias("_hi"))
    here = grid.select("row", "col", F.lit(True).alias("_here"))
    rows = grid.select("row").distinct().crossJoin(F.broadcast(ends))  # the other side is one row
    return rows.select("row", F.explode(F.sequence("_lo", "_hi")).alias("col")).join(here, ["row", "col"], "left")


def focal_mean(grid: DataFrame, value: str, radius: int, out: str = "mean") -> DataFrame:
    b = box(grid, radius, {"_s": F.col(value), "_n": F.when(F.col(value).isNotNull(), 1.0)})
    return b.withColumn(out, F.col("_s") / F.col("_n")).drop("_s", "_n")


def kernel(grid: DataFrame, value: str, weights: dict[str, list[tuple[int, int, float]]]) -> DataFrame:
    """Adds a weighted sum over neighbours for each named kernel of (dr, dc, weight); null where the grid lacks one of its cells.

    One self equi-join on the neighbour's cell for all kernels together; the offsets are a literal array.
    """
    steps = sorted({(a, b) for k in weights.values() for a, b, _ in k})
    d = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), *[F.lit(float(dict(((x, y), w) for x, y, w in k).get((a, b), 0.0))).alias(n) for n, k in weights.items()]) for a, b in steps])
    near = grid.select("row", "col", F.col(value).alias("_v"), F.explode(d).alias("_d"))
    near = near.select((F.col("row") - F.col("_d.dr")).alias("row"), (F.col("col") - F.col("_d.dc")).alias("col"), "_v", *[F.col(f"_d.{n}").alias(f"_{n}") for n in weights])
    got = near.groupBy("row", "col").agg(F.count("_v").alias("_n"), *[F.sum(F.col("_v") * F.col(f"_{n}")).alias(n) for n in weights])
    full = F.col("_n") == len(steps)
    return grid.join(got.select("row", "col", *[F.when(full, F.col(n)).alias(n) for n in weights]), ["row", "col"], "left")


def horn(cell: float = 1.0) -> dict[str, list[tuple[int, int, float]]]:
    """p = dz/dx and q = dz/dy (rows grow downwards), 3 by 3."""
    p = [(r, c, c * (2 if r == 0 else 1) / (8 * cell)) for r in (-1, 0, 1) for c in (-1, 1)]
    q = [(r, c, -r * (2 if c == 0 else 1) / (8 * cell)) for r in (-1, 1) for c in (-1, 0, 1)]
    return {"p": p, "q": q}


def least_squares(cell: float = 1.0, radius: int = 2, degree: int = 3) -> dict[str, list[tuple[int, int, float]]]:
    """p, q, r, s, t: first and second derivatives of the polynomial of that degree that fits the window best."""
    import numpy as np

    at = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    terms = [(a, b) for a in range(degree + 1) for b in range(degree + 1 - a)]
    x = np.array([[(j * cell) ** a * (-i * cell) ** b for a, b in terms] for i, j in at])
    fit = np.linalg.pinv(x)
    pick = {"p": ((1, 0), 1), "q": ((0, 1), 1), "r": ((2, 0), 2), "s": ((1, 1), 1), "t": ((0, 2), 2)}
    return {n: [(i, j, float(k * fit[terms.index(t)][m])) for m, (i, j) in enumerate(at)] for n, (t, k) in pick.items()}


def slope_aspect(df: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """slope and aspect in degrees (clockwise from north, -1 where flat), eastness, northness."""
    g = F.sqrt(F.col(p) ** 2 + F.col(q) ** 2)
    flat = g < FLAT
    aspect = F.pmod(F.degrees(F.atan2(-F.col(p), -F.col(q))) + 360.0, F.lit(360.0))
    df = df.withColumns({"slope": F.degrees(F.atan(g)), "aspect": F.when(g.isNull(), None).when(flat, -1.0).otherwise(aspect)})
    return df.withColumns({"eastness": F.when(F.col("aspect") < 0, 0.0).otherwise(F.sin(F.radians("aspect"))), "northness": F.when(F.col("aspect") < 0, 0.0).otherwise(F.cos(F.radians("aspect")))})


def curvatures(df: DataFrame) -> DataFrame:
    """Profile, plan, tangential, mean, total, Gaussian and minimal curvature from p, q, r, s, t; 0 where flat."""
    p, q, r, s, t = (F.col(c) for c in "pqrst")
    g, h = p * p + q * q, 1 + p * p + q * q
    along, over = p * p * r + 2 * p * q * s + q * q * t, q * q * r - 2 * p * q * s + p * p * t
    zero = lambda c: F.when(g < FLAT * FLAT, 0.0).otherwise(c)
    mean = -((1 + q * q) * r - 2 * p * q * s + (1 + p * p) * t) / (2 * F.pow(h, F.lit(1.5)))
    gauss = (r * t - s * s) / (h * h)
    out = {"profile": zero(-along / (g * F.pow(h, F.lit(1.5)))), "plan": zero(-over / F.pow(g, F.lit(1.5))), "tangential": zero(-over / (g * F.sqrt(h))), "mean_curv": mean, "total": r * r + 2 * s * s + t * t, "gaussian": gauss}
    df = df.withColumns(out)
    return df.withColumn("minimal", F.col("mean_curv") - F.sqrt(F.greatest(F.col("mean_curv") ** 2 - F.col("gaussian"), F.lit(0.0))))


def regular_plan(tangential: Column, slope: Column, degree: float = 0.1) -> Column:
    """Plan curvature as tangential * sin / (sin^2 + e^2), which stays finite where the ground is flat."""
    s = F.sin(F.radians(slope))
    return tangential * s / (s * s + F.sin(F.radians(F.lit(degree))) ** 2)


def position_and_ruggedness(grid: DataFrame, value: str) -> DataFrame:
    """tpi: height less the mean of the 3 by 3 window; tri: root of the sum of squared differences over 8."""
    b = box(grid, 1, {"_s": F.col(value), "_q": F.col(value) ** 2, "_n": F.when(F.col(value).isNotNull(), 1.0)})
    z = F.col(value)
    ss = F.col("_q") - 2 * z * F.col("_s") + F.col("_n") * z * z
    return b.withColumns({"tpi": z - F.col("_s") / F.col("_n"), "tri": F.sqrt(F.greatest(ss, F.lit(0.0)) / 8)}).drop("_s", "_q", "_n")


def scale_position(grid: DataFrame, value: str, radius: int) -> DataFrame:
    """dmv (from mean), devmean (in standard deviations), rtp (from middle of range, -1 to 1), pct_range (0 to 100)."""
    b = box(grid, radius, {"_s": F.col(value), "_q": F.col(value) ** 2, "_n": F.when(F.col(value).isNotNull(), 1.0)})
    lo, hi = (box(grid.select("row", "col", value), radius, {n: F.col(value)}, n.strip("_")).select("row", "col", n) for n in ("_min", "_max"))
    b = b.join(lo, ["row", "col"]).join(hi, ["row", "col"])
    z, m = F.col(value), F.col("_s") / F.col("_n")
    sd = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - m * m, F.lit(0.0)))
    span = F.col("_max") - F.col("_min")
    return b.withColumns({"dmv": z - m, "devmean": F.when(sd > 1e-6, (z - m) / sd).otherwise(0.0), "rtp": F.when(span > 0, (2 * z - F.col("_max") - F.col("_min")) / span).otherwise(0.0), "pct_range": F.when(span > 0, 100 * (z - F.col("_min")) / span).otherwise(50.0)}).drop("_s", "_q", "_n", "_min", "_max")


def max_deviation(grid: DataFrame, value: str, radii: range) -> DataFrame:
    """maxdev, scale: the deviation from the mean in standard deviations of greatest size over radii; ties: the smaller radius."""
    base = grid.select("row", "col", value)
    out = base
    for r in radii:
        s = box(base, r, {"_s": F.col(value), "_q": F.col(value) ** 2, "_n": F.when(F.col(value).isNotNull(), 1.0)})
        m = F.col("_s") / F.col("_n")
        sd = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - m * m, F.lit(0.0)))
        out = out.join(s.select("row", "col", F.when(sd > 1e-6, (F.col(value) - m) / sd).otherwise(0.0).alias(f"_d{r}")), ["row", "col"])
    best = F.array_max(F.array(*[F.struct(F.round(F.abs(F.col(f"_d{r}")), 9).alias("a"), F.lit(-r).alias("r"), F.col(f"_d{r}").alias("d")) for r in radii]))
    return out.withColumn("_b", best).select("row", "col", value, F.col("_b.d").alias("maxdev"), (-F.col("_b.r")).alias("scale"))


def circular_variance(grid: DataFrame, aspect: str, radius: int) -> DataFrame:
    """1 less the length of the mean direction over the window; flat cells don't count."""
    on = F.col(aspect) >= 0
    b = box(grid, radius, {"_x": F.when(on, F.sin(F.radians(aspect))), "_y": F.when(on, F.cos(F.radians(aspect))), "_n": F.when(on, 1.0)})
    return b.withColumn("circvar", 1 - F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2) / F.col("_n")).drop("_x", "_y", "_n")


def roughness(grid: DataFrame, slope: str, aspect: str, radius: int) -> DataFrame:
    """sd_slope over the window, and the angular deviation of the surface normals from their mean, in degrees."""
    s, a = F.radians(slope), F.radians(aspect)
    b = box(grid, radius, {"_s": F.col(slope), "_q": F.col(slope) ** 2, "_n": F.when(F.col(slope).isNotNull(), 1.0), "_x": F.sin(s) * F.when(F.col(aspect) < 0, 0.0).otherwise(F.sin(a)), "_y": F.sin(s) * F.when(F.col(aspect) < 0, 0.0).otherwise(F.cos(a)), "_z": F.cos(s)})
    m = F.col("_s") / F.col("_n")
    length = F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2 + F.col("_z") ** 2) / F.col("_n")
    return b.withColumns({"sd_slope": F.sqrt(F.greatest(F.col("_q") / F.col("_n") - m * m, F.lit(0.0))), "sd_normals": F.degrees(F.sqrt(-2 * F.log(F.least(F.greatest(length, F.lit(1e-9)), F.lit(1.0)))))}).drop("_s", "_q", "_n", "_x", "_y", "_z")


def hillshade(slope: Column, aspect: Column, azimuth: float = SUN_AZIMUTH, height: float = SUN_HEIGHT) -> Column:
    """0 to 255."""
    h, s = F.radians(F.lit(height)), F.radians(slope)
    turn = F.when(aspect < 0, F.lit(0.0)).otherwise(F.sin(s) * F.cos(F.radians(F.lit(azimuth) - aspect)))
    return 255 * F.greatest(F.lit(0.0), F.sin(h) * F.cos(s) + F.cos(h) * turn)


def hillshade_multi(slope: Column, aspect: Column, azimuths: tuple[float, ...] = (225.0, 270.0, 315.0, 360.0), height: float = SUN_HEIGHT, least: float = 1e-4) -> Column:
    """Weighted by the squared sine of the angle between aspect and light, at least `least`."""
    w = [F.greatest(F.sin(F.radians(F.when(aspect < 0, 0.0).otherwise(aspect) - a)) ** 2, F.lit(least)) for a in azimuths]
    total, top = w[0], w[0] * hillshade(slope, aspect, azimuths[0], height)
    for x, a in zip(w[1:], azimuths[1:]):
        total, top = total + x, top + x * hillshade(slope, aspect, a, height)
    return top / total


def wetness(area: Column, slope: Column) -> dict[str, Column]:
    """twi, sti and spi from the specific catchment area."""
    tan, sin = F.tan(F.radians(slope)), F.sin(F.radians(slope))
    return {"twi": F.log(area / F.greatest(tan, F.lit(0.001))), "sti": 1.4 * F.pow(area / 22.13, F.lit(0.4)) * F.pow(sin / 0.0896, F.lit(1.3)), "spi": area * tan}


def d8(grid: DataFrame, value: str) -> DataFrame:
    """(row, col, value, to_row, to_col, drop): the neighbour of steepest descent; null where there is none. Ties: the smaller row, then column."""
    from .joins import EIGHT, neighbours

    n = neighbours(grid, value, EIGHT)
    n = n.withColumn("drop", (F.col(value) - F.col("near")) / F.when((F.col("dr") != 0) & (F.col("dc") != 0), F.sqrt(F.lit(2.0))).otherwise(1.0)).where("drop > 0")
    best = n.groupBy("row", "col").agg(F.min(F.struct(-F.round("drop", 9), F.col("dr"), F.col("dc"), F.col("drop"))).alias("b"))
    return grid.join(best.select("row", "col", (F.col("row") + F.col("b.dr")).alias("to_row"), (F.col("col") + F.col("b.dc")).alias("to_col"), F.col("b.drop").alias("drop")), ["row", "col"], "left")


def elevation_percentile(grid: DataFrame, value: str, radius: int) -> DataFrame:
    """The share of the window's other cells that are lower, in percent; 50 where all are level."""
    steps = tuple((a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a or b)
    from .joins import neighbours

    n = neighbours(grid, value, steps).groupBy("row", "col").agg(F.sum((F.col("near") < F.col(value)).cast("int")).alias("lower"), F.sum((F.col("near") != F.col(value)).cast("int")).alias("other"), F.count(F.lit(1)).alias("n"))
    return grid.join(n.select("row", "col", F.when(F.col("other") == 0, 50.0).otherwise(100.0 * F.col("lower") / F.col("n")).alias("elev_pct")), ["row", "col"], "left")


def gaussian_smooth(grid: DataFrame, value: str, sigma: float, radius: int) -> DataFrame:
    """Normalised Gaussian smoothing: missing cells neither count nor spread. Two one-dimensional passes."""
    import math

    w = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-radius, radius + 1)}

    def one(df: DataFrame, axis: str) -> DataFrame:
        d = F.explode(F.array(*[F.struct(F.lit(k).alias("d"), F.lit(v).alias("w")) for k, v in w.items()])).alias("_d")
        n = df.select("row", "col", "_a", "_b", d).withColumn(axis, F.col(axis) + F.col("_d.d"))
        return n.groupBy("row", "col").agg(F.sum(F.col("_a") * F.col("_d.w")).alias("_a"), F.sum(F.col("_b") * F.col("_d.w")).alias("_b"))

    start = grid.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("_a"), F.lit(1.0).alias("_b"))
    s = one(one(start, "row"), "col").select("row", "col", (F.col("_a") / F.col("_b")).alias("smooth"))
    return grid.join(s, ["row", "col"], "left")
