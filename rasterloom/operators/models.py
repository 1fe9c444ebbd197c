"""Estimators, cross-validation, importance and response of suitability and class models."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stratified_folds(df: DataFrame, cls: str, k: int, key: str, seed: int = 42) -> DataFrame:
    """Adds fold: rows of a class in hash order, dealt in turn. A class is dealt in 64 parts of its own, so none meets in one task."""
    part = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(64))
    order = F.row_number().over(W.partitionBy(cls, "_part").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key))
    return df.withColumn("_part", part).withColumn("fold", ((order - 1 + F.col("_part")) % k).cast("int")).drop("_part")


def hashed_folds(df: DataFrame, cls: str, k: int, key: str, seed: int = 42) -> DataFrame:
    """Adds fold by place in hash order within the class, modulo k. The place is counted in two steps: over 4096 ranges of the hash, then inside each, so a class that holds most rows is dealt over many tasks."""
    rows = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("_part", F.substring("_h", 1, 3))
    n = rows.groupBy(F.col(cls).alias("_c"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    n = n.select("_c", "_p", F.coalesce(F.sum("_n").over(W.partitionBy("_c").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    order = F.row_number().over(W.partitionBy(cls, "_part").orderBy("_h", key))
    rows = rows.withColumn("_i", order).join(n, F.col(cls).eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")))
    return rows.withColumn("fold", ((F.col("_before") + F.col("_i") - 1) % k).cast("int")).drop("_h", "_part", "_c", "_p", "_before", "_i")


def assign_blocks(blocks: list[dict], k: int) -> dict[int, int]:
    """Greedy: blocks with most classes, then most rows first; each to the fold where it scores best.

    blocks: dicts of block, and counts by class. Score: -size of the fold + 1000 for each class the fold lacks - what it already has of the block's classes.
    """
    folds: list[dict] = [{} for _ in range(k)]
    out = {}
    for b in sorted(blocks, key=lambda b: (-len(b["counts"]), -sum(b["counts"].values()), b["block"])):
        def score(f: dict, counts=b["counts"]) -> float:
            return -sum(f.values()) + 1000 * sum(c not in f for c in counts) - sum(f.get(c, 0) for c in counts)

        best = max(range(k), key=lambda i: (score(folds[i]), -i))
        out[b["block"]] = best
        for c, n in b["counts"].items():
            folds[best][c] = folds[best].get(c, 0) + n
    return out


def spatial_folds(df: DataFrame, cls: str, k: int = 5, n_blocks: int = 20, seed: int = 42) -> DataFrame:
    """Adds block and fold: k-means blocks of (x, y), of which there are at most n_blocks, assigned greedily."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=["x", "y"], outputCol="_xy").transform(df)
    model = KMeans(k=n_blocks, seed=seed, featuresCol="_xy", predictionCol="block", maxIter=20).fit(v)
    b = model.transform(v).drop("_xy")
    n = b.groupBy("block", cls).count().collect()  # blocks by classes
    blocks = [{"block": i, "counts": {r[cls]: r["count"] for r in n if r["block"] == i}} for i in sorted({r["block"] for r in n})]
    fold = assign_blocks(blocks, k)
    return b.withColumn("fold", F.element_at(F.create_map(*[F.lit(x) for kv in fold.items() for x in kv]), F.col("block")))


def standardise(df: DataFrame, cols: list[str], fold: str | None = None) -> DataFrame:
    """Nulls become the median, then (value - mean) / population sd, a sd of 0 taken as 1; by fold if given."""
    by = [fold] if fold else []
    med = df.groupBy(*by).agg(*[F.percentile(c, 0.5).alias(f"_p_{c}") for c in cols])
    filled = (df.join(F.broadcast(med), by) if by else df.crossJoin(F.broadcast(med))).withColumns({c: F.coalesce(c, f"_p_{c}") for c in cols})
    st = filled.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = filled.join(F.broadcast(st), by) if by else filled.crossJoin(F.broadcast(st))
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in cols}).drop(*[f"_{k}_{c}" for c in cols for k in "pms"])


def linear_score(cols: list[str], weights: list[float], intercept: float = 0.0) -> Column:
    return reduce(Column.__add__, [F.col(c) * float(w) for c, w in zip(cols, weights)], F.lit(float(intercept)))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def discriminant(df: DataFrame, cols: list[str], cls: str, kind: str = "lda", shrink: float = 0.0) -> DataFrame:
    """Adds pred by linear or quadratic discriminants. Class means and covariances are aggregates, k by k numbers each; the classes' matrices are inverted on the driver.

    shrink pulls each covariance towards its mean variance times the identity.
    """
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).orderBy(cls).collect()
    total = sum(r["n"] for r in rows)
    cov = {r[cls]: np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) for r in rows}
    if kind == "lda":
        pooled = sum(cov[r[cls]] * (r["n"] - 1) for r in rows) / (total - len(rows))
        cov = {c: pooled for c in cov}
    score = []
    for r in rows:
        s = (1 - shrink) * cov[r[cls]] + shrink * np.trace(cov[r[cls]]) / k * np.eye(k)
        inv, d = np.linalg.inv(s), [F.col(c) - float(r[f"m{i}"]) for i, c in enumerate(cols)]
        q = reduce(Column.__add__, [d[i] * d[j] * float(inv[i, j]) for i in range(k) for j in range(k)])
        score.append(F.struct(F.round(-0.5 * q - 0.5 * float(np.linalg.slogdet(s)[1]) + float(np.log(r["n"] / total)), 9).alias("s"), F.lit(-r[cls]).alias("c")))
    return df.withColumn("pred", -F.array_max(F.array(*score))["c"])


def nearest_neighbours(train: DataFrame, test: DataFrame, cols: list[str], cls: str, k: int) -> DataFrame:
    """(id, pred): the majority of the k nearest training rows by the k-d search of neighbours.py; ties: the smaller class."""
    from . import neighbours as N

    near = N.search(test, N.index(train, cols, k), cols)
    return N.votes(near, train, [k], cls).where("weights = 'uniform'").select("id", "pred")


def permuted(df: DataFrame, col: str, reps: int, key: str = "id", seed: int = 42) -> DataFrame:
    """Repeats df for each rep with col dealt anew, within parts of about equal hash: row and donor meet on their places in two hash orders."""
    r = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_part", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(16)))
    by = W.partitionBy("rep", "_part")
    a = r.withColumn("_n", F.row_number().over(by.orderBy(key)))
    donors = r.select("rep", "_part", F.col(col).alias("_v"), F.row_number().over(by.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(col), "rep", F.col(key).cast("string"))), key)).alias("_n"))
    return a.join(donors, ["rep", "_part", "_n"]).withColumn(col, F.col("_v")).drop("_v", "_n", "_part")


def importance(df: DataFrame, cols: list[str], truth: str, score: Column, reps: int = 3) -> DataFrame:
    """(feature, drop): the mean fall of the AUC when a predictor is permuted."""
    from .aggregates import cumulative

    base = df.select(F.lit("").alias("feature"), F.lit(-1).alias("rep"), F.col(truth).alias("t"), score.alias("s"))
    runs = [permuted(df, c, reps).select(F.lit(c).alias("feature"), "rep", F.col(truth).alias("t"), score.alias("s")) for c in cols]
    c = cumulative(reduce(DataFrame.unionByName, runs, base), "s", {"n": F.count(F.lit(1)), "pos": F.sum("t")}, ("feature", "rep"))
    p = F.sum("pos")
    auc = c.groupBy("feature", "rep").agg(((F.sum(F.col("pos") * (F.col("n_before") + (F.col("n") + 1) / 2)) - p * (p + 1) / 2) / (p * (F.sum("n") - p))).alias("auc"))
    b = auc.where("feature = ''").select(F.col("auc").alias("base"))
    return auc.where("feature <> ''").crossJoin(F.broadcast(b)).groupBy("feature").agg(F.avg(F.col("base") - F.col("auc")).alias("drop"))


def response_curve(df: DataFrame, cols: list[str], score: Column, presence: Column, points: int = 100) -> DataFrame:
    """(feature, i, value, response): one predictor from its 1st to 99th percentile, the others at the presence median."""
    med = df.where(presence).agg(*[F.percentile(c, 0.5).alias(f"_m_{c}") for c in cols])
    ends = df.agg(*[F.percentile(c, q).alias(f"_{n}_{c}") for c in cols for n, q in (("lo", 0.01), ("hi", 0.99))])
    grid = ends.crossJoin(F.broadcast(med)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    out = []
    for c in cols:
        v = F.col(f"_lo_{c}") + F.col("i") * (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / (points - 1)
        g = grid.select("i", *[(v if x == c else F.col(f"_m_{x}")).alias(x) for x in cols])
        out.append(g.select(F.lit(c).alias("feature"), "i", F.col(c).alias("value"), score.alias("response")))
    return reduce(DataFrame.unionByName, out)


def parametric_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: kind ('linear' or 'quadratic', which must beat the line's AIC by more than 2), coefficients a + b x + c x^2, from power sums."""
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.pow(F.col(x), F.lit(float(i)))).alias(f"x{i}") for i in range(1, 5)], *[F.sum(F.pow(F.col(x), F.lit(float(i))) * F.col(y)).alias(f"y{i}") for i in range(3)], F.sum(F.col(y) ** 2).alias("yy")).first()
    s, t, n = [r["n"], *(r[f"x{i}"] for i in range(1, 5))], [r[f"y{i}"] for i in range(3)], r["n"]
    fits = []
    for k in (2, 3):
        w = np.linalg.solve(np.array([[s[i + j] for j in range(k)] for i in range(k)]), np.array(t[:k]))
        rss = max(r["yy"] - float(w @ np.array(t[:k])), 1e-12)
        fits.append((n * np.log(rss / n) + 2 * (k + 1), [*map(float, w), *[0.0] * (3 - k)]))
    kind = int(fits[1][0] + 2 < fits[0][0])
    return df.sparkSession.createDataFrame([(("linear", "quadratic")[kind], *fits[kind][1])], "kind string, a double, b double, c double")


def maxent_features(df: DataFrame, cols: list[str], knots: int = 4) -> tuple[DataFrame, list[str]]:
    """Adds linear, quadratic, product and hinge features of columns scaled to [0, 1]."""
    e = df.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))])
    s = df.crossJoin(F.broadcast(e)).withColumns({f"l_{c}": (F.col(c) - F.col(f"_lo_{c}")) / F.greatest(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(1e-12)) for c in cols}).drop(*[f"_{n}_{c}" for c in cols for n in ("lo", "hi")])
    new = {f"q_{c}": F.col(f"l_{c}") ** 2 for c in cols}
    new |= {f"p_{a}_{b}": F.col(f"l_{a}") * F.col(f"l_{b}") for i, a in enumerate(cols) for b in cols[i + 1 :]}
    new |= {f"h_{c}_{j}": F.greatest(F.lit(0.0), (F.col(f"l_{c}") - j / (knots + 1)) / (1 - j / (knots + 1))) for c in cols for j in range(1, knots + 1)}
    return s.withColumns(new), [*[f"l_{c}" for c in cols], *new]


def fit_logistic(df: DataFrame, cols: list[str], label: str, weight: str | None = None, reg: float = 0.0, l1: float = 0.0):
    """A Spark ML logistic regression over columns; returns the model and df with p."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=cols, outputCol="_x").transform(df)
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=reg, elasticNetParam=l1, maxIter=50, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y", **({"weightCol": weight} if weight else {})).fit(v)
    return model, model.transform(v).withColumn("p", vector_to_array("_p")[1]).drop("_x", "_p", "_r", "_y")


def smooth_fit(df: DataFrame, knots: int = 8, penalty: float = 1.0, points: int = 50) -> DataFrame:
    """(x, fit, se): a linear spline of y on x with a second-difference penalty, at evenly spaced points."""
    e = df.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, step = e["lo"], (e["hi"] - e["lo"]) / (knots - 1) or 1.0
    hat = [F.greatest(F.lit(0.0), 1 - F.abs(F.col("x") - (lo + i * step)) / step) for i in range(knots)]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") ** 2).alias("yy"), *[F.sum(hat[i] * hat[j]).alias(f"b{i}_{j}") for i in range(knots) for j in range(i, min(i + 2, knots))], *[F.sum(hat[i] * F.col("y")).alias(f"t{i}") for i in range(knots)]).first()
    b = np.zeros((knots, knots))
    for i in range(knots):
        for j in range(i, min(i + 2, knots)):
            b[i, j] = b[j, i] = r[f"b{i}_{j}"]
    t, diff = np.array([r[f"t{i}"] for i in range(knots)]), np.diff(np.eye(knots), 2, axis=0)
    inv = np.linalg.inv(b + penalty * diff.T @ diff + 1e-9 * np.eye(knots))
    w = inv @ t
    var = max(r["yy"] - 2 * w @ t + w @ b @ w, 0.0) / max(r["n"] - np.trace(inv @ b), 1.0)
    rows = []
    for x in np.linspace(e["lo"], e["hi"], points):
        h = np.maximum(0, 1 - np.abs(x - (lo + np.arange(knots) * step)) / step)
        rows.append((float(x), float(h @ w), float(np.sqrt(max(var * h @ inv @ b @ inv @ h, 0.0)))))
    return df.sparkSession.createDataFrame(rows, "x double, fit double, se double")
