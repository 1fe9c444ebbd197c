"""Parameter grids, names of predictors, and boosting of several classes."""

from __future__ import annotations

import json
from itertools import product

from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: By model: each parameter's values, the middle of the list first; wider grids take more of it.
VALUES = {
    "random_forest": {"numTrees": (200, 100, 500, 1000), "maxDepth": (10, 6, 14, 20), "minInstancesPerNode": (1, 3, 5)},
    "boosting": {"maxIter": (40, 20, 80, 160), "maxDepth": (3, 2, 4, 6), "stepSize": (0.1, 0.05, 0.2)},
    "elastic_net": {"regParam": (0.01, 0.001, 0.1, 1.0), "elasticNetParam": (0.5, 0.0, 1.0)},
    "discriminant": {"shrink": (0.1, 0.0, 0.5, 0.9)},
    "nearest": {"k": (5, 3, 9, 15), "weights": ("uniform", "distance")},
}
LEVELS = {"optimal": 1, "extended": 2, "maximal": 99}


def parameter_grid(model: str, level: str = "optimal", manual: dict[str, tuple] | None = None) -> list[dict[str, object]]:
    """All combinations of a model's parameters: of the first values (optimal: one each), of two (extended), of all (maximal); or, with level manual, of the given values, the others at their first."""
    have = VALUES[model]
    if level == "manual":
        if unknown := set(manual or {}) - set(have):
            raise ValueError(f"{model} has no {sorted(unknown)}")
        values = {k: tuple((manual or {}).get(k, v[:1])) for k, v in have.items()}
    else:
        values = {k: v[: LEVELS[level]] for k, v in have.items()}
    return [dict(zip(values, c)) for c in product(*values.values())]


def resolve_predictors(bands: list[str], model_names: list[str] | None = None, sidecar: str | None = None, listing: str | None = None, manual: list[str] | None = None) -> list[str]:
    """The predictors' names in model order: from the model, else from a JSON sidecar (a list, or an object with features), else from a text with a name on each line, else as given by hand. Names the bands lack, compared without case, are an error."""
    names = model_names
    if not names and sidecar:
        got = json.loads(sidecar)
        names = got.get("features") if isinstance(got, dict) else got
    if not names and listing:
        names = [x.strip() for x in listing.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    names = names or manual
    if not names:
        raise ValueError("no predictor names: neither the model nor a sidecar nor a listing has them, and none are given")
    have = {b.lower(): b for b in bands}
    if missing := [n for n in names if n.lower() not in have]:
        raise ValueError(f"bands lack {missing}")
    return [have[n.lower()] for n in names]


def boosted_classes(train: DataFrame, cols: list[str], label: str, rounds: int = 8, depth: int = 3, seed: int = 42) -> OneVsRestModel:
    """Gradient boosting of several classes (0, 1, ...): one boosted model for each class against the others."""
    one = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)
    return OneVsRest(classifier=one, labelCol=label, featuresCol="_x", predictionCol="pred", parallelism=4).fit(assembled(train, cols))


def assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="_x").transform(df)


def averaged(folds: DataFrame, key: str = "id", score: str = "score", weight: str | None = None) -> DataFrame:
    """(key, score): the mean of several models' out-of-fold scores, weighted if weight is given; null scores don't count."""
    w = F.when(F.col(score).isNotNull(), F.col(weight) if weight else F.lit(1.0))
    return folds.groupBy(key).agg(F.try_divide(F.sum(F.col(score) * w), F.sum(w)).alias(score))


def with_errors(spark: SparkSession, items: DataFrame, key: str, work, schema: str, tries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(done, failed): work(row dict) -> list of row tuples for each item; what still fails after `tries` is a row (key, error). Spark's own task retries cover lost executors; this covers items that fail by themselves."""
    import pyarrow as pa

    from ..ship import ship, stored

    ship(spark)
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                error = ""
                for _ in range(tries):
                    try:
                        out += [(str(row[key]), None, json.dumps(dict(zip(names, r)))) for r in work(row)]
                        break
                    except Exception as e:  # noqa: BLE001  the item's failure is its result
                        error = f"{type(e).__name__}: {e}"
                else:
                    out.append((str(row[key]), error, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["item", "error", "row"])

    both = stored(items.mapInArrow(run, "item string, error string, row string"), "worked")
    done = both.where("error IS NULL").select("item", F.from_json("row", schema).alias("r")).select("item", "r.*")
    return done, both.where("error IS NOT NULL").select(F.col("item").alias(key), "error")
