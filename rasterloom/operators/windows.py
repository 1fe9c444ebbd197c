"""Window operators, sorts, samples and set operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ship import stored


def keep_first(df: DataFrame, by: Iterable[str], *order: Column) -> DataFrame:
    """One row per key: the first by the order."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, by: Iterable[str], seq: str) -> DataFrame:
    return keep_first(df, by, F.col(seq).desc())


def suffixed(df: DataFrame, name: str, order: str) -> DataFrame:
    """Numbers repeated names: _1, _2 and so on from the second on."""
    w = W.partitionBy(name)
    n = F.row_number().over(w.orderBy(order)) - 1
    return df.withColumn(name, F.when(n > 0, F.concat_ws("_", F.col(name), n.cast("string"))).otherwise(F.col(name)))


def forward_fill(df: DataFrame, cols: Iterable[str], order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Fills nulls from above, as merged cells of a sheet read."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def best_cut(points: DataFrame, by: str, at: str) -> DataFrame:
    """(by, cut, saving): where to cut a group along x so that the two boxes cover least. Running extents from both sides, each from its own start, so the work grows with the rows."""
    fore = W.partitionBy(by).orderBy(at, "id").rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(by).orderBy(F.desc(at), F.desc("id")).rowsBetween(W.unboundedPreceding, -1)
    e = points.select(by, at, "y", *[f(c).over(w).alias(f"{n}_{c}_{s}") for w, s in ((fore, "l"), (back, "r")) for c in (at, "y") for f, n in ((F.min, "lo"), (F.max, "hi"))],
                      *[f(c).over(W.partitionBy(by)).alias(f"{n}_{c}") for c in (at, "y") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    area = lambda s: (F.col(f"hi_{at}{s}") - F.col(f"lo_{at}{s}")) * (F.col(f"hi_y{s}") - F.col(f"lo_y{s}"))
    e = e.where(F.col(f"lo_{at}_r").isNotNull()).withColumn("saving", area("") - area("_l") - area("_r"))
    return e.groupBy(by).agg(F.min_by(at, F.struct(-F.round("saving", 6), F.col(at))).alias("cut"), F.max("saving").alias("saving"))


def ranked(df: DataFrame, keys: dict[str, bool]) -> DataFrame:
    """Adds place: the row's number by the keys (name: descending). For tables of results, one row per model."""
    return df.withColumn("place", F.row_number().over(W.orderBy(*[F.desc(k) if d else F.asc(k) for k, d in keys.items()])))


def numeric_first(c: Column) -> list[Column]:
    """Sort keys: numbers by value, then other text by its lower case."""
    n = c.try_cast("double")
    return [n.isNull(), n, F.lower(c)]


def hash_order(seed: int, *cols: str) -> Column:
    """An order that is random but the same on every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement. A top-n by hash: tasks keep n rows each."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def weighted_sample(df: DataFrame, n: int, weight: str, seed: int, key: str) -> DataFrame:
    """n rows without replacement with chances by weight (exponential keys)."""
    u = (F.conv(F.substring(hash_order(seed, key), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    return df.where(F.col(weight) > 0).withColumn("_k", -F.log(u) / F.col(weight)).orderBy("_k", key).limit(n).drop("_k")


def running_sum(df: DataFrame, size: str, order: str, parts: int = 64) -> DataFrame:
    """Adds _sum, the sum of size up to the row: over ranges of the order first, then inside each range, so no task orders all rows."""
    dealt = stored(df.repartitionByRange(parts, order).withColumn("_pid", F.spark_partition_id()), "ordered")
    sums = dealt.groupBy("_pid").agg(F.sum(size).alias("_part"))  # one row for each range
    sums = sums.select("_pid", F.coalesce(F.sum("_part").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(size).over(W.partitionBy("_pid").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn("_sum", inside).join(F.broadcast(sums), "_pid").withColumn("_sum", F.col("_sum") + F.col("_before")).drop("_pid", "_before")


def whole_groups(groups: DataFrame, size: str, order: list[Column], budget: int) -> DataFrame:
    """Groups taken whole up to a budget of rows: a group that doesn't fit is passed over, later ones may.

    groups has one row per chip. In each round a running sum takes the leading groups that fit and drops what is larger
    than the rest of the budget; each round at least halves what is open or ends.
    """
    left = groups.withColumn("_o", F.struct(*order))
    taken, rest = None, budget
    while rest > 0:
        open_ = running_sum(left.where(F.col(size) <= rest), size, "_o")
        fits = open_.where(F.col("_sum") <= rest)
        row = fits.agg(F.max("_sum").alias("s"), F.max("_o").alias("o")).first()
        if row["s"] is None:
            break
        rest -= row["s"]
        taken = fits.drop("_sum") if taken is None else taken.unionByName(fits.drop("_sum"))
        left = open_.where(F.col("_sum") > row["s"]).drop("_sum").join(fits.select("_o"), "_o", "left_anti")
    return (groups.limit(0) if taken is None else taken.drop("_o"))


def with_size(df: DataFrame, by: list[str], name: str = "size") -> DataFrame:
    """Adds how many rows share the row's key. Counts are aggregated partially and joined back, so a hot key isn't gathered in one task."""
    n = df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]).agg(F.count(F.lit(1)).alias(name))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return df.join(n, on, "left").select(*df.columns, name)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key isn't in new, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def shared_groups(df: DataFrame, group: str, fold: str) -> DataFrame:
    """(group, n_folds) of groups that are in several folds: leaks."""
    return df.groupBy(group).agg(F.countDistinct(fold).alias("n_folds")).where("n_folds > 1")
