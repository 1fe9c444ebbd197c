"""The kernel machine finds rings that no line separates, and its probabilities hold on rows it hasn't seen."""

from __future__ import annotations

import numpy as np
import pytest

from rasterloom.operators import kernel as K
from rasterloom.operators import models as M


def rings(spark, n, seed, classes=2):
    rng = np.random.default_rng(seed)
    c = rng.integers(0, classes, n)
    r, t = 1 + 1.5 * c + rng.normal(0, 0.45, n), rng.uniform(0, 2 * np.pi, n)
    return spark.createDataFrame([(i, int(k), float(a), float(b)) for i, (k, a, b) in enumerate(zip(c, r * np.cos(t), r * np.sin(t)))], "id long, cls int, a double, b double")


def test_features_give_the_kernel():
    """With every row a landmark, dot products of features are the kernel itself."""
    x = np.random.default_rng(0).normal(size=(40, 3))
    k = K.radial(x, x, 0.7)
    f = k @ K.inverse_root(k)
    assert np.allclose(f @ f.T, k, atol=1e-6)


def test_rings_and_calibration(spark):
    train, test = rings(spark, 900, 1).coalesce(2), rings(spark, 900, 2)
    got = K.fit(train, ["a", "b"], "cls", landmarks=32).transform(test).select("cls", "pred", "p").toPandas()
    hit = (got.cls == got.pred).mean()
    line = M.fit_logistic(test, ["a", "b"], "cls")[1].toPandas()
    assert hit > 0.9 and hit > ((line.p > 0.5) == (line.cls == 1)).mean() + 0.25
    p = got.p.str[1].to_numpy()
    off = [abs(p[m].mean() - got.cls[m].mean()) * m.mean() for lo in np.arange(0, 1, 0.2) if (m := (p >= lo) & (p < lo + 0.2 + (lo > 0.7))).any()]
    assert sum(off) < 0.06 and np.allclose(got.p.apply(sum), 1)


def test_three_classes_and_odd_rows(spark):
    train = rings(spark, 400, 3, 3).coalesce(1)
    odd = spark.createDataFrame([(5000, None, 1.0, 1.0), (5001, 1, None, 1.0), (5002, 2, float("nan"), 0.0)], train.schema)
    m = K.fit(train.unionByName(odd), ["a", "b"], "cls", landmarks=24, folds=2)
    got = m.transform(train).select("cls", "pred").toPandas()
    assert m.classes == [0, 1, 2] and (got.cls == got.pred).mean() > 0.75
    left = {r["id"]: (r["p"], r["pred"]) for r in m.transform(odd).collect()}
    assert left[5001] == left[5002] == (None, None) and left[5000][1] is not None
    with pytest.raises(ValueError):
        K.fit(odd, ["a", "b"], "cls")
