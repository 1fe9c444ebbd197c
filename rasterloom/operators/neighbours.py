"""Exact nearest neighbours by a k-d partition: each row meets its own box, then only the boxes that its bound cuts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship, stored

#: Boxes, and sampled rows for each, at most: both go through the driver. The sample cuts boxes only; it decides no result.
MAX_BOXES = 16_384
SAMPLED = 16
#: Distances are rounded to so many places before ties go to the smaller id, so bounds have this much slack.
PLACES = 9
SLACK = 2e-9
#: Distances of test rows to box corners that a task holds at once.
AT_ONCE = 1 << 20


@dataclass
class Tree:
    """A k-d tree in heap order: dim[i] is -1 at leaves; rows at or below cut[i] go left. Leaves are numbered by their place."""

    dim: np.ndarray
    cut: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := self.dim[at] >= 0).any():
            rows = np.flatnonzero(inner)
            d = self.dim[at[rows]]
            at[rows] = 2 * at[rows] + 1 + (x[rows, d] > self.cut[at[rows]])
        return at


def grow(sample: np.ndarray, boxes: int) -> Tree:
    """Halves the sample at the median of its widest dimension, level by level; a set of equal rows isn't cut."""
    depth = max(int(np.ceil(np.log2(max(boxes, 1)))), 0)
    size = 2 ** (depth + 1) - 1
    dim, cut = np.full(size, -1, dtype=np.int64), np.zeros(size)
    todo = [(0, sample, depth)]
    while todo:
        i, rows, left = todo.pop()
        if not left or len(rows) < 2:
            continue
        lo, hi = rows.min(0), rows.max(0)
        d = int(np.argmax(hi - lo))
        if hi[d] <= lo[d]:
            continue
        c = np.partition(rows[:, d], (len(rows) - 1) // 2)[(len(rows) - 1) // 2]
        if c >= hi[d]:
            c = rows[rows[:, d] < c, d].max()
        dim[i], cut[i] = d, c
        below = rows[:, d] <= c
        todo += [(2 * i + 1, rows[below], left - 1), (2 * i + 2, rows[~below], left - 1)]
    return Tree(dim, cut)


def in_boxes(df: DataFrame, cols: list[str], tree: Tree) -> DataFrame:
    """Adds _box to df, whose columns named cols are doubles without nulls."""

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(_box=tree.leaf(p[cols].to_numpy(float)))

    return df.mapInPandas(place, T.StructType([*df.schema.fields, T.StructField("_box", T.LongType())]))


@dataclass
class Index:
    """Training rows dealt to boxes: rows(_box, _i, _x0, ...), and on the driver each box's number, row count and corners."""

    rows: DataFrame
    tree: Tree
    box: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int


def _values(df: DataFrame, cols: list[str], key: str, name: str) -> tuple[DataFrame, list[str]]:
    xs = [f"_{name}{i}" for i in range(len(cols))]
    out = df.select(F.col(key).alias(f"_{name}"), *[(F.col(c).cast("double") + 0.0).alias(x) for c, x in zip(cols, xs)])
    return out.where(reduce(Column.__and__, [F.col(x).isNotNull() & ~F.isnan(x) for x in xs], F.lit(True))), xs


def index(train: DataFrame, cols: list[str], k: int, key: str = "id", per_box: int = 64) -> Index:
    """An index of training rows that gives up to k neighbours each. Rows with a null or NaN predictor are left out.

    Of rows that are equal in all predictors, only the k with the smallest keys can be neighbours; the others leave
    before the shuffle ends, so a point that holds most rows makes no full box.
    """
    ship(train.sparkSession)
    rows, xs = _values(train, cols, key, "i")
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*xs).orderBy("_i"))).where(F.col("_n") <= k).drop("_n")
    rows = stored(rows, "neighbours")
    n = rows.count()
    boxes = min(MAX_BOXES, max(n // max(per_box, 2 * k), 1))
    want = boxes * SAMPLED
    picked = rows.select(*xs) if n <= want else rows.select(*xs).where(F.pmod(F.xxhash64("_i"), F.lit(1 << 20)) < int(np.ceil(want / n * (1 << 20)))).limit(2 * want)
    tree = grow(picked.toPandas().to_numpy(float).reshape(-1, len(xs)), boxes)
    rows = stored(in_boxes(rows, xs, tree), "neighbours")
    ends = [f(x).alias(f"{f.__name__}{x}") for x in xs for f in (F.min, F.max)]
    b = rows.groupBy("_box").agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("_box").toPandas()  # a row for each box
    corner = lambda f: b[[f"{f}{x}" for x in xs]].to_numpy(float)
    return Index(rows, tree, b["_box"].to_numpy(np.int64), b["n"].to_numpy(np.int64), corner("min"), corner("max"), k)


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.withColumn("n", F.row_number().over(W.partitionBy("_q").orderBy("_d", "_i"))).where(F.col("n") <= k)


def _pairs(left: DataFrame, ix: Index, xs: list[str], bound: bool = False) -> DataFrame:
    """(_q, _i, _d) of rows that meet in a box; with a bound, those within it."""
    ys = [c for c in ix.rows.columns if c.startswith("_i") and c != "_i"]
    d = F.sqrt(reduce(Column.__add__, [(F.col(x) - F.col(y)) ** 2 for x, y in zip(xs, ys)]))
    met = left.join(ix.rows, "_box").withColumn("_d", F.round(d, PLACES))
    return (met.where(F.col("_d") <= F.col("_bound") + SLACK) if bound else met).select("_q", "_i", "_d")


def other_boxes(first: DataFrame, ix: Index, xs: list[str]) -> DataFrame:
    """(_q, xs, _bound, _box): the boxes besides its own that may hold a neighbour of a row, by the distance to their corners.

    first has _own, and _bound where its own box gave k rows; else the bound is the distance within which the nearest
    boxes hold k rows for certain.
    """
    box, n, low, high, k = ix.box, ix.n, ix.low, ix.high, min(ix.k, int(ix.n.sum()))
    step = max(1, AT_ONCE // max(len(box), 1))

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), step):
                rows = p.iloc[at : at + step]
                x = rows[xs].to_numpy(float)
                near, far = np.zeros((len(x), len(box))), np.zeros((len(x), len(box)))
                for j in range(x.shape[1]):
                    v = x[:, j, None]
                    near += np.maximum(np.maximum(low[None, :, j] - v, v - high[None, :, j]), 0) ** 2
                    far += np.maximum(np.abs(v - low[None, :, j]), np.abs(v - high[None, :, j])) ** 2
                bound = rows["_bound"].to_numpy(float).copy()
                for i in np.flatnonzero(np.isnan(bound)):
                    order = np.argsort(far[i], kind="stable")
                    bound[i] = np.sqrt(far[i, order[np.searchsorted(np.cumsum(n[order]), k)]])
                bound += SLACK
                hit = (np.sqrt(near) <= (bound + SLACK)[:, None]) & (box[None, :] != rows["_own"].to_numpy()[:, None])
                i, b = np.nonzero(hit)
                yield rows.iloc[i].assign(_bound=bound[i], _box=box[b])[["_q", *xs, "_bound", "_box"]]

    kind = dict(first.dtypes)["_q"]
    return first.mapInPandas(cut, f"_q {kind}, {', '.join(f'{x} double' for x in xs)}, _bound double, _box long")


def search(test: DataFrame, ix: Index, cols: list[str], key: str = "id") -> DataFrame:
    """(key, n, neighbour, distance): the nearest index rows of each test row, n = 1, 2, ...; ties: the smaller key.

    Keys of test are unique. Test rows with a null or NaN predictor have no neighbours; an empty index gives none. Each
    of the two rounds is a join on boxes, whose pairs are cut to k for each row before they are shuffled by row.
    """
    rows, xs = _values(test, cols, key, "q")
    own = in_boxes(rows, xs, ix.tree)
    one = stored(_nearest(_pairs(own, ix, xs), ix.k), "neighbours")
    bound = one.groupBy("_q").agg(F.max(F.when(F.col("n") == ix.k, F.col("_d"))).alias("_bound"))
    first = own.withColumnRenamed("_box", "_own").join(bound, "_q", "left")
    both = one.drop("n")
    if len(ix.box):
        both = both.unionByName(_pairs(other_boxes(first, ix, xs), ix, xs, bound=True))
    return _nearest(both, ix.k).select(F.col("_q").alias(key), "n", F.col("_i").alias("neighbour"), F.col("_d").alias("distance"))


def votes(near: DataFrame, train: DataFrame, ks: list[int], cls: str, key: str = "id") -> DataFrame:
    """(key, k, weights, pred) for every k up to the search's, from one search. train has the classes by key.

    Uniform: the class of most of the k; distance: by the sum of 1 / distance, and where some are at distance 0, by those
    alone. Ties: the smaller class.
    """
    v = near.join(train.select(F.col(key).alias("neighbour"), F.col(cls).alias("_c")), "neighbour")
    on_it = F.min("distance").over(W.partitionBy(key)) == 0
    v = v.withColumn("_w", F.when(on_it, (F.col("distance") == 0).cast("double")).otherwise(1 / F.greatest("distance", F.lit(10.0**-PLACES))))
    v = v.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted(set(ks))]))).where("n <= k")
    n = v.groupBy(key, "k", "_c").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("_w"), PLACES).alias("w"))
    best = lambda by: F.min_by("_c", F.struct(-F.col(by), F.col("_c")))
    return n.groupBy(key, "k").agg(best("n").alias("uniform"), best("w").alias("distance")).unpivot([key, "k"], ["uniform", "distance"], "weights", "pred")
