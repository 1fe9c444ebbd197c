"""Order-free comparison of two pandas tables."""

from __future__ import annotations

import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    text = lambda x: "null" if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(text(x) for x in r) for r in df.itertuples(index=False))
