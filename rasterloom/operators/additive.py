"""Additive response curves: penalised cubic B-splines by iterated least squares, smoothing by generalised cross-validation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

#: Smoothing tried for each term, times the mean diagonal of its block over that of its penalty.
GRID = tuple(10.0**p for p in range(-6, 5))

#: Steps after which the smoothing is held: choosing it anew each time may swing between two values for good.
CHOOSE = 8


@dataclass
class Term:
    """A cubic B-spline over [low, high] with `knots` equal steps; outside, the value of the nearer end counts."""

    col: str
    low: float
    high: float
    knots: int

    @property
    def size(self) -> int:
        return self.knots + 3

    def basis(self, x: np.ndarray) -> np.ndarray:
        """One row of four shares that add up to 1 for each value, spread over the columns."""
        step = (self.high - self.low) / self.knots or 1.0
        u = np.clip((x - self.low) / step, 0, self.knots)
        i = np.minimum(u.astype(np.int64), self.knots - 1)
        t = u - i
        shares = np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3], 1) / 6
        out = np.zeros((len(x), self.size))
        for j in range(4):
            out[np.arange(len(x)), i + j] = shares[:, j]
        return out

    def penalty(self) -> np.ndarray:
        d = np.diff(np.eye(self.size), 2, axis=0)
        return d.T @ d


@dataclass
class Sums:
    """What a fit needs of all rows: their weight, X'WX, X'Wz, z'Wz, and X'W1 stands in the first row of X'WX."""

    n: float
    xx: np.ndarray
    xz: np.ndarray
    zz: float


@dataclass
class Fit:
    terms: list[Term]
    family: str
    beta: np.ndarray
    cov: np.ndarray
    smooth: np.ndarray
    edf: float
    scale: float
    mean: np.ndarray

    def curve(self, term: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A term's centred curve on the link's scale, and its standard errors."""
        at = slice(1 + sum(t.size for t in self.terms[:term]), 1 + sum(t.size for t in self.terms[: term + 1]))
        b = self.terms[term].basis(x) - self.mean[at]
        return b @ self.beta[at], np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", b, self.cov[at, at], b), 0))


def design(terms: list[Term], x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), *[t.basis(x[:, j]) for j, t in enumerate(terms)]])


def working(family: str, eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Working response and weight of one step of iterated least squares."""
    if family == "gaussian":
        return y, np.ones(len(y))
    p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
    w = np.maximum(p * (1 - p), 1e-6)
    return eta + (y - p) / w, w


def sums(rows: DataFrame, terms: list[Term], family: str, beta: np.ndarray) -> Sums:
    """Adds up the normal equations: each task gives its own sums, and Spark adds them by place, p x p numbers in all."""
    p = len(beta)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(p * p + p + 2)
        for df in parts:
            x = design(terms, df[[f"x{j}" for j in range(len(terms))]].to_numpy(float))
            z, w = working(family, x @ beta, df["y"].to_numpy(float))
            wx = x * w[:, None]
            total += np.concatenate([(wx.T @ x).ravel(), wx.T @ z, [z @ (w * z), len(df)]])
        some = np.flatnonzero(total)
        yield pd.DataFrame({"place": some, "v": total[some]})

    got = rows.mapInPandas(work, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toPandas()  # p x p + p + 2 rows
    v = np.zeros(p * p + p + 2)
    v[got["place"].to_numpy(np.int64)] = got["v"]
    return Sums(float(v[-1]), v[: p * p].reshape(p, p), v[p * p : p * p + p], float(v[-2]))


def solve(s: Sums, terms: list[Term], family: str, smooth: np.ndarray | None = None, sweeps: int = 3) -> Fit:
    """Coefficients for the smoothing, term by term, whose generalised cross-validation score is least.

    A term's coefficients are drawn to a mean of 0, which costs no fit, as the intercept has the constant; curves are
    centred by the rows' means. A tiny ridge holds what the rows say nothing about. The
    covariance is that of the coefficients given the data under the penalty as a prior, which is what makes intervals
    cover the true curve on average over its range.
    """
    p = len(s.xz)
    if s.n == 0:
        raise ValueError("no rows with all predictors and a response")
    blocks, at = [], 1
    for t in terms:
        block = np.zeros((p, p))
        own = slice(at, at + t.size)
        block[own, own] = t.penalty() * np.trace(s.xx[own, own]) / np.trace(t.penalty())
        blocks.append(block)
        at += t.size
    ridge = 1e-10 * np.trace(s.xx) / p * np.eye(p)
    ridge[0, 0], at = 0, 1
    for t in terms:
        ridge[at : at + t.size, at : at + t.size] += np.trace(s.xx[at : at + t.size, at : at + t.size]) / t.size**2
        at += t.size

    def attempt(lam: np.ndarray) -> tuple:
        a = np.linalg.inv(s.xx + ridge + sum(v * b for v, b in zip(lam, blocks)))
        beta = a @ s.xz
        edf = float(np.trace(a @ s.xx))
        rss = max(s.zz - 2 * beta @ s.xz + beta @ s.xx @ beta, 0.0)
        return s.n * rss / max(s.n - edf, 1e-9) ** 2, a, beta, edf, rss

    lam = np.ones(len(terms)) if smooth is None else smooth.copy()
    if smooth is None:
        for _ in range(sweeps):
            before = lam.copy()
            for j in range(len(terms)):
                lam[j] = min(GRID, key=lambda v, j=j: (attempt(np.where(np.arange(len(terms)) == j, v, lam))[0], -v))
            if (lam == before).all():
                break
    _, a, beta, edf, rss = attempt(lam)
    scale = rss / max(s.n - edf, 1.0) if family == "gaussian" else 1.0
    return Fit(terms, family, beta, a * scale, lam, edf, scale, s.xx[0] / s.xx[0, 0])


def fit(df: DataFrame, cols: list[str], y: str, family: str = "gaussian", knots: int = 10, rounds: int = 25, tol: float = 1e-6) -> Fit:
    """y on smooth curves of the columns; family gaussian, or binomial for y of 0 and 1.

    Rows with a null or NaN among them are left out. A step is one pass over the rows; gaussian needs one, binomial as
    many as its coefficients take to settle.
    """
    if family not in ("gaussian", "binomial"):
        raise ValueError(f"family {family}")
    ship(df.sparkSession)
    rows = df.select(F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)])
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in rows.columns))
    ends = rows.agg(*[f(f"x{j}").alias(f"{f.__name__}{j}") for j in range(len(cols)) for f in (F.min, F.max)]).first()
    terms = [Term(c, ends[f"min{j}"] or 0.0, ends[f"max{j}"] or 0.0, knots) for j, c in enumerate(cols)]
    beta, smooth = np.zeros(1 + sum(t.size for t in terms)), None
    for i in range(1 if family == "gaussian" else rounds):
        out = solve(sums(rows, terms, family, beta), terms, family, smooth)
        if i + 1 == CHOOSE:
            smooth = out.smooth
        if np.abs(out.beta - beta).max() <= tol * (1 + np.abs(beta).max()):
            break
        beta = out.beta
    return out


def response(df: DataFrame, model: Fit, points: int = 50, z: float = 1.959963984540054) -> DataFrame:
    """(feature, i, value, fit, low, high): each term's centred curve on the link's scale, with intervals of z standard errors."""
    rows = []
    for j, t in enumerate(model.terms):
        x = np.linspace(t.low, t.high, points)
        f, se = model.curve(j, x)
        rows += [(t.col, i, *map(float, r)) for i, r in enumerate(zip(x, f, f - z * se, f + z * se))]
    return df.sparkSession.createDataFrame(rows, "feature string, i int, value double, fit double, low double, high double")
