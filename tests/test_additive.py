"""Additive curves: the passes add up the same equations as whole arrays, and intervals cover a known curve."""

from __future__ import annotations

import numpy as np
import pytest

from rasterloom.operators import additive as A


def brute_splines(x, low, high, knots):
    """Cubic B-splines by the recursion over knots, at values short of the upper end."""
    step = (high - low) / knots
    t = low + step * np.arange(-3, knots + 4)
    b = ((x[:, None] >= t[:-1]) & (x[:, None] < t[1:])).astype(float)
    for d in range(1, 4):
        b = (x[:, None] - t[: -d - 1]) / (d * step) * b[:, :-1] + (t[d + 1 :] - x[:, None]) / (d * step) * b[:, 1:]
    return b


def test_basis():
    x = np.random.default_rng(1).uniform(-2, 3, 200)
    t = A.Term("x", -2.0, 3.0, 7)
    assert np.allclose(t.basis(x), brute_splines(x, -2.0, 3.0, 7))
    assert np.allclose(t.basis(np.array([-9.0, 9.0])), t.basis(np.array([-2.0, 3.0])))


@pytest.mark.parametrize("family", ["gaussian", "binomial"])
def test_equals_whole_arrays(spark, family):
    """The same penalised fit, stacked as plain least squares at the smoothing that was chosen; nulls are left out."""
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (800, 2))
    eta = 2 * np.sin(6 * x[:, 0]) + x[:, 1]
    y = (rng.random(800) < 1 / (1 + np.exp(-eta))).astype(float) if family == "binomial" else eta + rng.normal(0, 0.3, 800)
    rows = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 0.5, 1.0), (0.5, float("nan"), 1.0), (0.5, 0.5, None)]
    got = A.fit(spark.createDataFrame(rows, "a double, b double, y double").repartition(3), ["a", "b"], "y", family, knots=6)
    d = np.hstack([np.ones((800, 1)), *[A.Term("", x[:, j].min(), x[:, j].max(), 6).basis(x[:, j]) for j in range(2)]])
    beta = np.zeros(d.shape[1])
    for _ in range(40):
        if family == "gaussian":
            z, w = y, np.ones(800)
        else:
            p = 1 / (1 + np.exp(-d @ beta))
            w = p * (1 - p)
            z = d @ beta + (y - p) / w
        parts = [d * np.sqrt(w)[:, None]]
        xx = d.T @ (d * w[:, None])
        for j, lam in enumerate(got.smooth):
            own = slice(1 + 9 * j, 10 + 9 * j)
            diff = np.zeros((7, d.shape[1]))
            diff[:, own] = np.diff(np.eye(9), 2, axis=0)
            parts.append(diff * np.sqrt(lam * np.trace(xx[own, own]) / np.trace(diff.T @ diff)))
        stack = np.vstack(parts)
        beta = np.linalg.lstsq(stack, np.append(np.sqrt(w) * z, np.zeros(len(stack) - 800)), rcond=None)[0]
    design = A.design(got.terms, x)
    assert np.allclose(design @ got.beta, d @ beta, atol=2e-3)
    f, _ = got.curve(0, x[:, 0])
    w_mean = (w * f).sum() / w.sum()
    assert abs(w_mean) < 1e-3 and np.corrcoef(f, np.sin(6 * x[:, 0]))[0, 1] > 0.97


def test_intervals_cover_the_known_curve(spark):
    """Over 300 draws the 95 % intervals hold the curve's centred values within 3 % of that, on average over its range."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 400)
    truth = np.sin(2 * np.pi * x) + x
    t = A.Term("x", x.min(), x.max(), 12)
    d = A.design([t], x[:, None])
    held = []
    for _ in range(300):
        y = truth + rng.normal(0, 0.4, 400)
        m = A.solve(A.Sums(400.0, d.T @ d, d.T @ y, float(y @ y)), [t], "gaussian")
        f, se = m.curve(0, x)
        held.append((np.abs(f - (truth - truth.mean())) <= 1.959964 * se).mean())
    assert abs(np.mean(held) - 0.95) <= 0.03


def test_odd_rows(spark):
    schema = "a double, y double"
    flat = A.fit(spark.createDataFrame([(1.0, 2.0)] * 5, schema), ["a"], "y")
    r = A.response(spark.createDataFrame([], schema), flat, points=3).toPandas()
    assert len(r) == 3 and np.allclose(r.fit, 0, atol=1e-6) and np.isfinite(r[["low", "high"]]).all().all()
    with pytest.raises(ValueError):
        A.fit(spark.createDataFrame([], schema), ["a"], "y")
