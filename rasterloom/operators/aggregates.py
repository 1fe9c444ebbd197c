"""Counts, areas, metrics and rank statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def everything():
    """A window over all rows of a small table of results."""
    return W.partitionBy()


def duplicates(samples: DataFrame, cls: str = "class_name") -> DataFrame:
    """(row, col, n, n_classes) of pixels with several samples."""
    return samples.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(cls).alias("n_classes")).where("n > 1")


def frequency(grid: DataFrame, cls: str = "cls") -> DataFrame:
    """(cls, n, percent), counted by the codes that occur."""
    n = grid.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(everything()))  # one row per class


def class_summary(polygons: DataFrame, cls: str, area: str) -> DataFrame:
    """(cls, n_patches, ha, share)."""
    s = polygons.groupBy(cls).agg(F.count(F.lit(1)).alias("n_patches"), (F.sum(area) / 1e4).alias("ha"))
    return s.withColumn("share", F.col("ha") * 100 / F.sum("ha").over(everything()))


def matrix(polygons: DataFrame, v: str, h: str, area: str) -> DataFrame:
    return polygons.groupBy(v, h).agg(F.count(F.lit(1)).alias("n"), F.sum(area).alias("area"))


def fold_counts(samples: DataFrame, fold: str, cls: str) -> DataFrame:
    """(fold, cls, n) with totals: a null fold or class stands for all."""
    return samples.rollup(fold, cls).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(conf: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(cls, tp, fp, fn, tn, precision, recall, f1, specificity, balanced) from a long confusion matrix; 0 for 0/0."""
    cells = conf.select(F.col(truth).alias("t"), F.col(pred).alias("p"), F.col("n").cast("double").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("cls"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0).alias("tp"), F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0.0).alias("fn"), F.lit(0.0).alias("fp")), F.struct(F.col("p").alias("cls"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("fn"), F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0.0).alias("fp")))).alias("s")).select("s.*")
    total = cells.agg(F.sum("n").alias("total"))
    m = sides.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).crossJoin(F.broadcast(total))  # a single row
    m = m.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")).drop("total")
    safe = lambda a, b: a / F.greatest(b, F.lit(1.0))
    m = m.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn")), "specificity": safe(F.col("tn"), F.col("tn") + F.col("fp"))})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return m.withColumns({"f1": f1, "balanced": (F.col("recall") + F.col("specificity")) / 2})


def overall_metrics(conf: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """One row: accuracy, kappa, macro precision, recall, f1, specificity, tss and balanced accuracy."""
    m = class_metrics(conf, truth, pred)
    seen = m.where("tp + fn > 0")
    n = F.max(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    agreed = F.sum("tp") / n
    chance = F.sum((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp"))) / (n * n)
    out = m.agg(agreed.alias("accuracy"), ((agreed - chance) / (1 - chance)).alias("kappa"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.avg("specificity").alias("specificity"))
    return out.crossJoin(F.broadcast(seen.agg(F.avg("recall").alias("balanced")))).withColumn("tss", F.col("recall") + F.col("specificity") - 1)


def aic(df: DataFrame, p_true: Column, k: int) -> DataFrame:
    """nll and aic = 2k + 2 nll, from the probability given to the true class."""
    return df.agg(F.sum(-F.log(F.greatest(p_true, F.lit(1e-15)))).alias("nll")).withColumn("aic", 2.0 * k + 2 * F.col("nll"))


# Ranks over a whole column would meet in one task. Counts by value are summed in ranges of values first, so a task
# only orders the values of one range, and the sums of the ranges (a few hundred) are added up on their own.


def cumulative(df: DataFrame, value: str, sums: dict[str, Column], by: tuple[str, ...] = (), ranges: int = 64) -> DataFrame:
    """(by.., value, sums.., <sum>_before, <sum>_total): for each distinct value, sums and those over smaller values.

    Values are ordered within ranges, which a sketch of their quantiles cuts, so that outliers don't empty the others.
    """
    n = df.groupBy(*by, value).agg(*[c.alias(k) for k, c in sums.items()])
    cuts = n.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts"))
    n = n.crossJoin(F.broadcast(cuts)).withColumn("_range", F.when(F.col(value).isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col(value)))).otherwise(0)).drop("_cuts")
    parts = n.groupBy(*by, "_range").agg(*[F.sum(k).alias(k) for k in sums])
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*by, "_range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in sums], *[F.sum(k).over(W.partitionBy(*by)).alias(f"{k}_total") for k in sums])
    inside = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    n = n.select(*by, "_range", value, *sums, *[F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(f"{k}_before") for k in sums])
    out = n.join(F.broadcast(parts) if not by else parts, [*by, "_range"])
    return out.select(*by, value, *sums, *[(F.col(f"{k}_before") + F.col(f"_{k}")).alias(f"{k}_before") for k in sums], *[f"{k}_total" for k in sums])


def average_ranks(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., value, n, avg_rank): ranks from 1, ties share their mean."""
    c = cumulative(df, value, {"n": F.count(F.lit(1))}, by)
    return c.select(*by, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Mann-Whitney with average ranks; one row: auc, n_pos, n_neg."""
    c = cumulative(df, score, {"n": F.count(F.lit(1)), "pos": F.sum(truth)})
    rank_sum = F.sum(F.col("pos") * (F.col("n_before") + (F.col("n") + 1) / 2))
    p, n = F.sum("pos"), F.sum("n") - F.sum("pos")
    return c.agg(((rank_sum - p * (p + 1) / 2) / (p * n)).alias("auc"), p.alias("n_pos"), n.alias("n_neg"))


def curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, tp, fp, pos, neg): counts at thresholds 'score or more', one row per distinct score."""
    c = cumulative(df, score, {"p": F.sum(truth), "q": F.sum(1 - F.col(truth))})
    return c.select(score, (F.col("p_total") - F.col("p_before")).alias("tp"), (F.col("q_total") - F.col("q_before")).alias("fp"), F.col("p").alias("p_here"), F.col("p_total").alias("pos"), F.col("q_total").alias("neg"))


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    c = curve(df, truth, score)
    return c.agg(F.sum(F.col("p_here") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def max_tss(df: DataFrame, truth: str, score: str) -> DataFrame:
    """threshold and tss where tpr - fpr is greatest; ties: the highest threshold."""
    j = F.round(F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg"), 12)
    return curve(df, truth, score).select(score, j.alias("j")).agg(F.max_by(score, F.struct("j", score)).alias("threshold"), F.max("j").alias("tss"))


def omission(df: DataFrame, truth: str, score: str, share: float = 0.1, threshold_from: DataFrame | None = None) -> DataFrame:
    """The share-quantile of presence scores, and the part of presences below it."""
    t = (df if threshold_from is None else threshold_from).where(F.col(truth) == 1).agg(F.percentile(score, share).alias("threshold"))
    return df.where(F.col(truth) == 1).crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.avg((F.col(score) < F.col("threshold")).cast("double")).alias("omission"))


def boyce_windows(df: DataFrame, truth: str, score: str, windows: int = 10, width: float = 0.1) -> DataFrame:
    """(i, centre, pe): the ratio of presences to expectation in moving windows over the score's range; empty ones left out."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.sum(truth).alias("np"), F.count(F.lit(1)).alias("n"))
    w = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(windows - 1)))).withColumn("span", F.col("hi") - F.col("lo"))
    w = w.withColumn("a", F.col("lo") + F.col("i") * F.col("span") * (1 - width) / (windows - 1)).withColumn("b", F.col("a") + F.col("span") * width)
    hit = df.select(F.col(truth).alias("_t"), F.col(score).alias("_s")).join(F.broadcast(w), F.col("_s").between(F.col("a"), F.col("b")))
    got = hit.groupBy("i", "a", "b", "np", "n").agg(F.sum("_t").alias("p"), F.count(F.lit(1)).alias("m"))
    return got.select("i", ((F.col("a") + F.col("b")) / 2).alias("centre"), ((F.col("p") / F.col("np")) / (F.col("m") / F.col("n"))).alias("pe"))


def boyce(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Spearman's correlation of window centres and ratios; null for fewer than 3 windows."""
    w = boyce_windows(df, truth, score)  # ten rows
    r = w.select(*[(F.rank().over(W.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(c)) - 1) / 2).alias(c) for c in ("centre", "pe")])
    return r.agg(F.when(F.count(F.lit(1)) >= 3, F.corr("centre", "pe")).alias("boyce"), F.count(F.lit(1)).alias("n_windows"))


def ranked_layers(long: DataFrame, key: str = "id", layer: str = "layer", value: str = "value") -> DataFrame:
    """Adds avg_rank within its layer to each row of a long table."""
    r = average_ranks(long, value, (layer,))
    return long.join(r.select(layer, value, "avg_rank"), [layer, value])


def spearman(wide: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, rho), a < b by position, over rows without nulls. Layers are ranked in long form and meet by row id."""
    rows = wide.select("id", *cols).na.drop()
    long = rows.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("layer"), F.col(c).alias("value")) for i, c in enumerate(cols)])).alias("s")).select("id", "s.*")
    r = ranked_layers(long).groupBy("id").agg(*[F.max(F.when(F.col("layer") == i, F.col("avg_rank"))).alias(f"r{i}") for i in range(len(cols))])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    got = r.agg(*[F.corr(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in pairs])
    return got.select(F.explode(F.array(*[F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.col(f"c{i}_{j}").alias("rho")) for i, j in pairs])).alias("s")).select("s.*")


def kruskal_wallis(long: DataFrame, group: str = "label", layer: str = "layer", value: str = "value") -> DataFrame:
    """(layer, h, k): tie-corrected H of each layer over groups."""
    r = average_ranks(long, value, (layer,))
    ties = r.groupBy(layer).agg(F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("t"))
    g = long.join(r.select(layer, value, "avg_rank"), [layer, value]).groupBy(layer, group).agg(F.sum("avg_rank").alias("r"), F.count(F.lit(1)).alias("m"))
    s = g.groupBy(layer).agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.count(F.lit(1)).alias("k")).join(ties, layer)
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return s.select(layer, h.alias("h"), "k")


def near_zero_variance(long: DataFrame, layer: str = "layer", value: str = "value", ratio: float = 19.0, unique: float = 10.0) -> DataFrame:
    """(layer, n_unique, freq_ratio, percent_unique, nzv)."""
    n = long.groupBy(layer, value).agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy(layer).agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("rows"), F.max("n").alias("first"))
    top = n.join(m.select(layer, "first"), layer).groupBy(layer).agg(F.max(F.when(F.col("n") < F.col("first"), F.col("n"))).alias("below"), F.sum((F.col("n") == F.col("first")).cast("int")).alias("firsts"))
    out = m.join(top, layer).withColumn("second", F.when(F.col("firsts") > 1, F.col("first")).otherwise(F.col("below")))
    fr = F.when(F.col("second").isNull(), F.lit(0.0)).otherwise(F.col("first") / F.col("second"))
    pu = 100.0 * F.col("n_unique") / F.col("rows")
    return out.select(layer, "n_unique", fr.alias("freq_ratio"), pu.alias("percent_unique"), ((F.col("n_unique") <= 1) | ((fr >= ratio) & (pu <= unique))).alias("nzv"))


def ensemble(scores: DataFrame, weights: DataFrame, key: str, n_models: int) -> DataFrame:
    """(key, suit): weighted mean over models with weight max(auc - 0.5, 0); null where a model has none."""
    w = weights.select("model", F.greatest(F.col("auc") - 0.5, F.lit(0.0)).alias("w"))  # one row per model
    m = scores.join(F.broadcast(w), "model").groupBy(key).agg(F.sum(F.col("w") * F.col("suit")).alias("s"), F.sum("w").alias("w"), F.count("suit").alias("n"))
    return m.select(key, F.when(F.col("n") == n_models, F.col("s") / F.col("w")).alias("suit"))


def balanced_weights(samples: DataFrame, cls: str, n_pixels: str, alpha: float = 0.5) -> DataFrame:
    """Adds weight: n_pixels^-alpha inside a class, each class adding up to N / K."""
    sums = samples.groupBy(cls).agg(F.sum(F.pow(F.col(n_pixels), F.lit(-alpha))).alias("_base"), F.count(F.lit(1)).alias("_m"))
    total = sums.agg((F.sum("_m") / F.count(F.lit(1))).alias("_each"))
    return samples.join(F.broadcast(sums.crossJoin(F.broadcast(total))), cls).withColumn("weight", F.pow(F.col(n_pixels), F.lit(-alpha)) / F.col("_base") * F.col("_each")).drop("_base", "_m", "_each")


def otsu(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """The threshold of greatest variance between classes, from a histogram of so many bins."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = df.crossJoin(F.broadcast(ends)).select("lo", "hi", F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).alias("bin"))
    h = b.groupBy("lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"))
    up = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # one row per bin
    c = h.select("lo", "hi", "bin", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(up).alias("s0"), F.sum("n").over(everything()).alias("w"), F.sum(F.col("n") * F.col("bin")).over(everything()).alias("s"))
    w1, gap = F.col("w") - F.col("w0"), F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    c = c.where(w1 > 0).withColumn("between", F.col("w0") * w1 * gap * gap)
    t = F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins
    return c.agg(F.max_by(t, F.struct(F.round("between", 3), -F.col("bin"))).alias("threshold"))


def mahalanobis(df: DataFrame, cols: list[str], reference: Column) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to the reference rows' mean. Their covariance, k by k, is inverted on the driver."""
    import numpy as np

    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = df.where(reference).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inv = np.linalg.inv(cov)
    d = [F.col(c) - float(r[f"m{i}"]) for i, c in enumerate(cols)]
    return df.withColumn("d2", reduce(Column.__add__, [d[i] * d[j] * float(inv[i, j]) for i in range(k) for j in range(k)]))


def stretch(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds stretched: value between two percentiles as 0 to 1, clipped."""
    p = df.agg(F.percentile(value, low).alias("_p"), F.percentile(value, high).alias("_q"))
    s = (F.col(value) - F.col("_p")) / F.greatest(F.col("_q") - F.col("_p"), F.lit(1e-12))
    return df.crossJoin(F.broadcast(p)).withColumn("stretched", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))).drop("_p", "_q")


def class_constants(df: DataFrame, cls: str, cols: list[str]) -> DataFrame:
    """(cls, cols..): an attribute that has one value in the class, else null."""
    return df.groupBy(cls).agg(*[F.when(F.countDistinct(c) == 1, F.max(c)).alias(c) for c in cols])


def order_statistic_ranks(n: int, level: float = 0.95) -> tuple[int, int]:
    """Ranks (from 1) of the order statistics that enclose the median with the given confidence, by the binomial law."""
    import math

    tail, k, total = (1 - level) / 2, 0, 0.0
    log_half = n * math.log(0.5)
    while k < n // 2:
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + log_half)
        if total > tail:
            break
        k += 1
    return max(k, 1), n + 1 - max(k, 1)


def medians(long: DataFrame, by: tuple[str, ...], value: str, level: float = 0.95) -> DataFrame:
    """(by.., n, median, lower, upper): the median of each group and an interval between order statistics (normal approximation of their ranks)."""
    import statistics

    z = statistics.NormalDist().inv_cdf((1 + level) / 2)
    n = long.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.percentile(value, 0.5).alias("median"))
    half = z * F.sqrt(F.col("m").cast("double")) / 2
    n = n.withColumns({"k": F.greatest(F.lit(1), F.floor(F.col("m") / 2 - half)).cast("long"), "j": F.least(F.col("m"), F.ceil(F.col("m") / 2 + half + 1)).cast("long")})
    c = cumulative(long, value, {"n": F.count(F.lit(1))}, by).join(n, list(by))
    at = lambda k: F.max(F.when((F.col("n_before") < F.col(k)) & (F.col(k) <= F.col("n_before") + F.col("n")), F.col(value)))
    return c.groupBy(*by, F.col("m"), "median").agg(at("k").alias("lower"), at("j").alias("upper")).withColumnRenamed("m", "n")
