"""Chips, discs, half-planes and masks as sets of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import dealt


def disc_cells(points: DataFrame, radius: float) -> DataFrame:
    """(id, row, col): the cells whose centre is within radius of a point. Each point is expanded to its own box of cells."""
    span = lambda c: F.sequence(F.floor(F.col(c) - radius), F.ceil(F.col(c) + radius) - 1)
    cells = points.select("id", "x", "y", F.explode(span("y")).alias("row")).select("id", "x", "y", "row", F.explode(span("x")).alias("col"))
    return cells.where((F.col("col") + 0.5 - F.col("x")) ** 2 + (F.col("row") + 0.5 - F.col("y")) ** 2 <= radius * radius).select("id", "row", "col")


def split_by_half_planes(cells: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """(row, col, a, b, owner): for each cell that two objects claim, the one on whose side of the line halfway between their centres it is; ties: the smaller key."""
    a, b = (dealt(cells.select("row", "col", F.col(key).alias(n)), "row", "col") for n in "ab")
    both = a.join(b.hint("merge"), ["row", "col"]).where("a < b")
    for n in "ab":
        both = dealt(both, n).join(dealt(centres.select(F.col(key).alias(n), F.struct("x", "y").alias(f"_{n}")), n).hint("shuffle_hash"), n)
    far = lambda n: F.round((F.col("col") + 0.5 - F.col(f"_{n}.x")) ** 2 + (F.col("row") + 0.5 - F.col(f"_{n}.y")) ** 2, 9)
    return both.select("row", "col", "a", "b", F.when(far("a") <= far("b"), F.col("a")).otherwise(F.col("b")).alias("owner"))


def crop_grid(boxes: DataFrame, side: float) -> DataFrame:
    """Adds nx, ny, crops: into how many crops of at most `side` a box is cut along each axis."""
    n = lambda c: F.greatest(F.lit(1), F.ceil((F.col(f"{c}1") - F.col(f"{c}0")) / side)).cast("long")
    return boxes.withColumns({"nx": n("x"), "ny": n("y"), "crops": n("x") * n("y")})


def segments_or_squares(points: DataFrame, cells: DataFrame, key: str, min_cells: int, radius: int) -> DataFrame:
    """(id, key, kind, row, col): the cells of the first segment of min_cells or more that holds a point(id, row, col), else a square of cells around the point."""
    large = cells.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_cells).select(key)
    kept = cells.join(large, key, "left_semi")
    held = points.join(kept, ["row", "col"]).groupBy("id").agg(F.min(key).alias(key))
    segment = held.join(kept, key).select("id", key, F.lit("segment").alias("kind"), "row", "col")
    span = F.sequence(F.lit(-radius), F.lit(radius))
    around = points.join(held, "id", "left_anti").select("id", "row", "col", F.explode(span).alias("_a")).select("id", (F.col("row") + F.col("_a")).alias("row"), "col", F.explode(span).alias("_b"))
    square = around.select("id", F.lit(None).cast(cells.schema[key].dataType).alias(key), F.lit("square").alias("kind"), "row", (F.col("col") + F.col("_b")).alias("col"))
    return segment.unionByName(square)


def binary_scores(rows: DataFrame, model: str, truth: str, predicted: str) -> DataFrame:
    """(model, tss, f1) of 0 and 1 truths and predictions."""
    t, p = F.col(truth), F.col(predicted)
    c = rows.groupBy(model).agg(F.sum(t * p).alias("tp"), F.sum((1 - t) * p).alias("fp"), F.sum(t * (1 - p)).alias("fn"), F.sum((1 - t) * (1 - p)).alias("tn"))
    return c.select(model, (F.try_divide("tp", F.col("tp") + F.col("fn")) - F.try_divide("fp", F.col("fp") + F.col("tn"))).alias("tss"), F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def choose_mask(pixels: DataFrame, min_ratio: float) -> DataFrame:
    """(point, mask, good, cells): of each point's masks with at least min_ratio good pixels, the one of the best mean score times ratio; ties: the smaller mask."""
    m = pixels.groupBy("point", "mask").agg(F.avg(F.col("good").cast("int")).alias("good"), F.avg("score").alias("score"), F.count(F.lit(1)).alias("cells")).where(F.col("good") >= min_ratio)
    best = m.groupBy("point").agg(F.min_by(F.struct("mask", "good", "cells"), F.struct(-F.round(F.col("good") * F.col("score"), 9), F.col("mask"))).alias("b"))
    return best.select("point", "b.*")
