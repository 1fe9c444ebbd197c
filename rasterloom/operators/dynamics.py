"""Suitability over years: groups, areas, change, trend, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(stack: DataFrame, key: str = "k", year: str = "year", value: str = "suit") -> DataFrame:
    """The pixels that have a value in every year."""
    n = stack.agg(F.countDistinct(year).alias("_n"))
    have = stack.where(F.col(value).isNotNull()).groupBy(key).agg(F.countDistinct(year).alias("_m"))
    keep = have.crossJoin(F.broadcast(n)).where("_m = _n").select(key)  # a single number
    return stack.join(keep, key, "left_semi")


def group_of(c: Column, thresholds: list[float]) -> Column:
    """How many thresholds the value reaches: 0 to N."""
    out = F.lit(0)
    for t in sorted(thresholds):
        out = out + F.when(c >= t, 1).otherwise(0)
    return F.when(c.isNotNull(), out)


def group_names(thresholds: list[float]) -> list[str]:
    t = [f"{x:g}" for x in sorted(thresholds)]
    return [f"<{t[0]}", *(f"{a}–{b}" for a, b in zip(t, t[1:])), f"≥{t[-1]}"] if t else ["unsuitable", "suitable"]


def pixel_area_ha(width: float, height: float, latitude: float | None = None) -> float:
    """In degrees where a latitude is given: a degree is 111,320 m, shorter by its cosine along a parallel."""
    import math

    if latitude is None:
        return width * height / 1e4
    return width * 111_320.0 * math.cos(math.radians(latitude)) * height * 111_320.0 / 1e4


def area_by_threshold(stack: DataFrame, threshold: float, ha: float) -> DataFrame:
    return stack.groupBy("year").agg((F.sum((F.col("suit") >= threshold).cast("int")) * ha).alias("ha"), F.avg("suit").alias("mean_suit"))


def area_by_group(stack: DataFrame, thresholds: list[float], ha: float) -> DataFrame:
    return stack.groupBy("year", group_of(F.col("suit"), thresholds).alias("grp")).agg((F.count(F.lit(1)) * ha).alias("ha"))


def ends(stack: DataFrame) -> DataFrame:
    """(k, first, last): each pixel's values in its first and last year."""
    return stack.groupBy("k").agg(F.min_by("suit", "year").alias("first"), F.max_by("suit", "year").alias("last"))


def change_status(first: Column, last: Column, threshold: float) -> Column:
    """0 never suitable, 1 gain, 2 loss, 3 stays suitable."""
    return F.when(first.isNull() | last.isNull(), None).otherwise((first >= threshold).cast("int") * 2 + (last >= threshold).cast("int"))


def transition_code(first: Column, last: Column, thresholds: list[float]) -> Column:
    return group_of(first, thresholds) * (len(thresholds) + 1) + group_of(last, thresholds)


def transitions(stack: DataFrame, thresholds: list[float], ha: float) -> DataFrame:
    """(from_grp, to_grp, ha)."""
    e = ends(stack).select(group_of(F.col("first"), thresholds).alias("from_grp"), group_of(F.col("last"), thresholds).alias("to_grp"))
    return e.groupBy("from_grp", "to_grp").agg((F.count(F.lit(1)) * ha).alias("ha"))


def trend(stack: DataFrame) -> DataFrame:
    """(k, slope, r2) per year; r2 is 0 where the values don't vary."""
    x, y = F.col("year").cast("double"), F.col("suit")
    g = stack.groupBy("k").agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("_r"), F.regr_syy(y, x).alias("_s"))
    return g.select("k", "slope", F.when(F.col("_s") == 0, 0.0).otherwise(F.col("_r")).alias("r2"))
