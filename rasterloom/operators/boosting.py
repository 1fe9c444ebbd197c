"""Softmax boosting: K trees a round, grown on gradient histograms that partitions sum up and Spark adds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship, stored

#: Gains are compared to so many significant places: sums of another order must not choose another split.
PLACES = 9
#: Rounds after which the rows' scores are stored; in between, tasks work them out from the trees.
STORE_EVERY = 8


@dataclass
class SoftmaxTrees:
    """Trees by round and class in heap order. feature -1: no cut here. A row goes right where its bin exceeds cut."""

    cols: list[str]
    classes: list[int]
    edges: list[np.ndarray]
    depth: int
    start: np.ndarray
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers of raw values: the count of edges below; null and NaN have a bin of their own, the last."""
        out = np.empty(x.shape, dtype=np.int16)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), len(e) + 1, np.searchsorted(e, x[:, j], side="left"))
        return out

    def scores(self, b: np.ndarray, since: int = 0, s: np.ndarray | None = None) -> np.ndarray:
        """Raw scores, a column for each class, from binned rows: those of the first `since` rounds are given in s."""
        s = np.tile(self.start, (len(b), 1)) if s is None else s.copy()
        for f, c, v in zip(self.feature[since:], self.cut[since:], self.value[since:]):
            for k in range(len(self.classes)):
                s[:, k] += v[k][descend(b, f[k], c[k], self.depth)]
        return s

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds p, the classes' probabilities in their order, and pred; equal probabilities give the smaller class."""
        ship(df.sparkSession)
        model = self

        @F.pandas_udf("array<double>")
        def probabilities(x: pd.DataFrame) -> pd.Series:
            return pd.Series(list(softmax(model.scores(model.bins(x.to_numpy(float))))))

        p = probabilities(F.struct(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(self.cols)]))
        names = F.array(*[F.lit(c) for c in self.classes])
        return df.withColumn("p", p).withColumn("pred", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def descend(b: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Each row's place in the heap of a tree, at most `depth` levels down."""
    at = np.zeros(len(b), dtype=np.int64)
    for _ in range(depth):
        rows = np.flatnonzero(feature[at] >= 0)
        f = at[rows]
        at[rows] = 2 * f + 1 + (b[rows, feature[f]] > cut[f])
    return at


def class_weights(train: DataFrame, label: str) -> dict[int, float]:
    """Rows over classes times a class's rows: every class weighs the same in all."""
    n = {r[label]: r["count"] for r in train.where(F.col(label).isNotNull()).groupBy(label).count().collect()}  # a row for each class
    return {c: sum(n.values()) / (len(n) * m) for c, m in n.items()}


def _significant(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        scale = 10.0 ** (PLACES - 1 - np.floor(np.log10(np.abs(x), where=x != 0, out=np.zeros_like(x))))
    return np.round(x * scale) / scale


def best_cuts(g: np.ndarray, h: np.ndarray, l2: float, min_hessian: float) -> tuple[np.ndarray, np.ndarray]:
    """(feature, cut) by node from histograms g, h[node, feature, bin]; feature -1 where no cut gains. Ties: the first feature, then bin."""
    gl, hl = np.cumsum(g, 2)[:, :, :-1], np.cumsum(h, 2)[:, :, :-1]
    gt, ht = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
    gr, hr = gt - gl, ht - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2)
    gain = np.where((hl >= min_hessian) & (hr >= min_hessian), _significant(gain), -np.inf).reshape(len(g), -1)
    top = gain.argmax(1)
    f, c = np.divmod(top, gl.shape[2])
    return np.where(gain[np.arange(len(g)), top] > 1e-12, f, -1), c


def fit(train: DataFrame, cols: list[str], label: str, rounds: int = 20, depth: int = 3, bins: int = 32, rate: float = 0.3, l2: float = 1.0, min_hessian: float = 1e-3, weights: dict[int, float] | None = None) -> SoftmaxTrees:
    """Fits K trees a round to the gradients of the weighted log-loss. label holds whole numbers; rows without one are left out.

    Rows stay binned in the shared folder. A level of all K trees is one pass: tasks add gradients and hessians by (class,
    node, feature, bin), Spark adds the tasks' sums, and the driver sees K x 2^level x features x bins numbers, however
    many rows there are. weights: by class, 1 where none is given (class_weights() balances them).
    """
    spark = train.sparkSession
    ship(spark)
    rows = train.where(F.col(label).isNotNull()).select(F.col(label).cast("long").alias("y"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)])
    counts = rows.groupBy("y").count().orderBy("y").collect()  # a row for each class
    if not counts:
        raise ValueError("no labelled rows")
    classes = [r["y"] for r in counts]
    weight = np.array([float((weights or {}).get(c, 1.0)) for c in classes])
    mass = weight * np.array([r["count"] for r in counts], dtype=float)
    quantiles = rows.approxQuantile([f"x{j}" for j in range(len(cols))], [i / bins for i in range(1, bins)], 0.1 / bins)
    model = SoftmaxTrees(list(cols), classes, [np.unique(np.array(q, dtype=float)) for q in quantiles], depth, np.log(mass / mass.sum()))
    binned = stored(_binned(rows, model), "boosting")
    kept = 0
    for _ in range(rounds):
        _grow(binned, model, kept, weight, l2, min_hessian, rate)
        if len(model.value) - kept >= STORE_EVERY:
            binned, kept = stored(_scored(binned, model, kept), "boosting"), len(model.value)
    return model


def _binned(rows: DataFrame, model: SoftmaxTrees) -> DataFrame:
    """(k, b, s): a row's class by its place, its bins, and its scores so far."""
    place = {c: k for k, c in enumerate(model.classes)}

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            b = model.bins(p[[f"x{j}" for j in range(len(model.cols))]].to_numpy(float))
            yield pd.DataFrame({"k": p["y"].map(place).astype("int32"), "b": list(b), "s": list(np.tile(model.start, (len(p), 1)))})

    return rows.mapInPandas(work, "k int, b array<smallint>, s array<double>")


def _scored(binned: DataFrame, model: SoftmaxTrees, kept: int) -> DataFrame:
    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield p.assign(s=list(model.scores(np.stack(p["b"]), kept, np.stack(p["s"]))))

    return binned.mapInPandas(work, binned.schema)


def _grow(binned: DataFrame, model: SoftmaxTrees, kept: int, weight: np.ndarray, l2: float, min_hessian: float, rate: float) -> None:
    """One round: a pass for each level, and the last one's sums give the leaves of the level below."""
    n_classes, depth, width = len(model.classes), model.depth, max(len(e) for e in model.edges) + 2
    size = 2 ** (depth + 1) - 1
    feature, cut = np.full((n_classes, size), -1, dtype=np.int64), np.zeros((n_classes, size), dtype=np.int64)
    value = np.zeros((n_classes, size))
    leaf = lambda g, h: -rate * g / (h + l2)
    for level in range(depth):
        g, h = _histograms(binned, model, kept, weight, feature, cut, level, width)
        first = 2**level - 1
        for k in range(n_classes):
            f, c = best_cuts(g[k], h[k], l2, min_hessian)
            f = np.where(h[k].sum(2)[:, 0] > 0, f, -1)
            feature[k, first : first + 2**level], cut[k, first : first + 2**level] = f, c
            for i in range(2**level):
                total = g[k, i, 0].sum(), h[k, i, 0].sum()
                if level == 0:
                    value[k, 0] = leaf(*total)
                if f[i] >= 0:
                    left = g[k, i, f[i], : c[i] + 1].sum(), h[k, i, f[i], : c[i] + 1].sum()
                    at = 2 * (first + i) + 1
                    value[k, at], value[k, at + 1] = leaf(*left), leaf(total[0] - left[0], total[1] - left[1])
    model.feature.append(feature)
    model.cut.append(cut)
    model.value.append(value)


def _histograms(binned: DataFrame, model: SoftmaxTrees, kept: int, weight: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """g, h[class, node of the level, feature, bin]."""
    n_classes, n_cols, nodes, first = len(model.classes), len(model.cols), 2**level, 2**level - 1
    shape = (n_classes, nodes, n_cols, width)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, h = np.zeros(int(np.prod(shape))), np.zeros(int(np.prod(shape)))
        for p in parts:
            if not len(p):
                continue
            b, y = np.stack(p["b"]).astype(np.int64), p["k"].to_numpy()
            prob = softmax(model.scores(b, kept, np.stack(p["s"])))
            w = weight[y]
            for k in range(n_classes):
                at = descend(b, feature[k], cut[k], level)
                here = at >= first  # rows of a node that isn't cut stay above
                grad, hess = w * (prob[:, k] - (y == k)), w * prob[:, k] * (1 - prob[:, k])
                for j in range(n_cols):
                    cell = ((k * nodes + at[here] - first) * n_cols + j) * width + b[here, j]
                    g += np.bincount(cell, grad[here], len(g))
                    h += np.bincount(cell, hess[here], len(h))
        some = np.flatnonzero(h)
        yield pd.DataFrame({"cell": some, "g": g[some], "h": h[some]})

    sums = binned.mapInPandas(work, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()  # at most K x nodes x features x bins
    out = np.zeros((2, int(np.prod(shape))))
    out[:, sums["cell"].to_numpy(np.int64)] = sums[["g", "h"]].to_numpy().T
    return out[0].reshape(shape), out[1].reshape(shape)


def log_loss(scored: DataFrame, label: str, classes: list[int], weight: Column | None = None) -> DataFrame:
    """(loss, n): the mean of -log of the true class's probability, over rows whose class the model knows."""
    own = F.element_at("p", F.array_position(F.array(*[F.lit(c).cast("long") for c in classes]), F.col(label).cast("long")).cast("int"))
    w = F.lit(1.0) if weight is None else weight
    known = scored.where(F.col(label).isin(classes))
    return known.agg((F.sum(-F.log(F.greatest(own, F.lit(1e-15))) * w) / F.sum(w)).alias("loss"), F.count(F.lit(1)).alias("n"))
