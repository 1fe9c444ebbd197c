"""A kernel machine: a radial kernel through landmarks, hinge loss, one class against the others, probabilities from held-out folds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship, stored


@dataclass
class KernelMachine:
    """classes, and for each of them (with two classes: for the second) a machine and the slope and offset of its sigmoid."""

    cols: list[str]
    classes: list[int]
    landmarks: np.ndarray
    root: np.ndarray
    gamma: float
    machines: list[LinearSVCModel]
    sigmoids: list[tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds p, the classes' probabilities in their order, and pred; ties give the smaller class. A row with a null or NaN predictor has null in both."""
        out = df.withColumn("_f", features(self.cols, self.landmarks, self.root, self.gamma))
        own = []
        for m, (a, b) in zip(self.machines, self.sigmoids):
            w, c = np.asarray(m.coefficients), float(m.intercept)
            d = F.aggregate(F.zip_with("_f", F.array(*[F.lit(float(v)) for v in w]), lambda x, y: x * y), F.lit(c), lambda s, v: s + v)
            own.append(1 / (1 + F.exp(-(a * d + b))))
        p = [1 - own[0], own[0]] if len(own) == 1 else own
        out = out.withColumn("p", F.when(F.col("_f").isNotNull(), F.array(*p))).withColumn("p", F.transform("p", lambda v: v / F.aggregate("p", F.lit(0.0), lambda s, x: s + x)))
        names = F.array(*[F.lit(c) for c in self.classes])
        return out.withColumn("pred", F.when(F.col("_f").isNotNull(), F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")))).drop("_f")


def features(cols: list[str], landmarks: np.ndarray, root: np.ndarray, gamma: float) -> Column:
    """The kernel's values at the landmarks times the inverse root of the landmarks' own kernel: their dot products are near the kernel's."""

    @F.pandas_udf("array<double>")
    def mapped(x: pd.DataFrame) -> pd.Series:
        v = x.to_numpy(float)
        ok = ~np.isnan(v).any(1)
        f = radial(np.where(ok[:, None], v, 0.0), landmarks, gamma) @ root
        return pd.Series([r if good else None for r, good in zip(f, ok)], dtype=object)

    return mapped(F.struct(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)]))


def radial(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    d = (x**2).sum(1)[:, None] + (z**2).sum(1)[None, :] - 2 * x @ z.T
    return np.exp(-gamma * np.maximum(d, 0))


def inverse_root(k: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix; directions it has next to nothing in are left out."""
    v, u = np.linalg.eigh(k)
    keep = v > 1e-10 * v.max()
    return u[:, keep] / np.sqrt(v[keep]) @ u[:, keep].T


def fit(train: DataFrame, cols: list[str], label: str, landmarks: int = 64, gamma: float | None = None, reg: float = 0.01, folds: int = 3, weights: dict[int, float] | None = None, key: str = "id", seed: int = 42) -> KernelMachine:
    """Landmarks are the centres of K-means, at most `landmarks`; gamma is 1 over (predictors x their variance) if not given.

    A machine's sigmoid is fitted to decisions on rows of folds that the machine of that decision didn't see. Rows with a
    null or NaN predictor or no label are left out. weights: by class, 1 where none is given.
    """
    ship(train.sparkSession)
    ok = " AND ".join([f"`{label}` IS NOT NULL", *[f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in cols]])
    rows = train.where(ok).select(F.col(label).cast("long").alias("_c"), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).alias("_fold"), *[F.col(c).cast("double").alias(c) for c in cols])
    stats = rows.agg(F.array_sort(F.collect_set("_c")).alias("classes"), sum(F.var_pop(c) for c in cols).alias("v"), F.count(F.lit(1)).alias("n")).first()
    classes = list(stats["classes"])
    if len(classes) < 2:
        raise ValueError("fewer than two classes")
    gamma = gamma if gamma is not None else 1 / (stats["v"] or 1.0)
    centres = KMeans(k=min(landmarks, stats["n"]), seed=seed, featuresCol="_x", maxIter=20).fit(VectorAssembler(inputCols=cols, outputCol="_x").transform(rows)).clusterCenters()
    z = np.array(centres)
    root = inverse_root(radial(z, z, gamma))
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c in classes for x in (c, float((weights or {}).get(c, 1.0)))]), F.col("_c")), F.lit(1.0))
    mapped = stored(rows.select("_c", "_fold", w.alias("_w"), features(cols, z, root, gamma).alias("_f")), "kernel").withColumn("_v", array_to_vector("_f"))
    machines, sigmoids = [], []
    for c in classes[1:] if len(classes) == 2 else classes:
        one = mapped.withColumn("_y", (F.col("_c") == c).cast("double"))
        svc = LinearSVC(featuresCol="_v", labelCol="_y", weightCol="_w", regParam=reg, maxIter=30, rawPredictionCol="_d", predictionCol="_p")
        held = [svc.fit(one.where(F.col("_fold") != f)).transform(one.where(F.col("_fold") == f)).select("_y", "_w", vector_to_array("_d")[1].alias("_d")) for f in range(folds)]
        unseen = held[0]
        for h in held[1:]:
            unseen = unseen.unionByName(h)
        s = LogisticRegression(featuresCol="_v", labelCol="_y", weightCol="_w", predictionCol="_p").fit(VectorAssembler(inputCols=["_d"], outputCol="_v").transform(unseen))
        machines.append(svc.fit(one))
        sigmoids.append((float(s.coefficients[0]), float(s.intercept)))
    return KernelMachine(list(cols), classes, z, root, gamma, machines, sigmoids)
