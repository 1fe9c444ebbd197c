"""Distribution functions for results of a few rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: Column, k: Column) -> Column:
    """The chance of a chi-squared value above x with k degrees of freedom."""

    @F.pandas_udf("double")
    def sf(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([gamma_q(b / 2, a / 2) for a, b in zip(x, k)])

    return sf(x, k.cast("double"))
