from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "su", "té", "ra", "no", "pe") for b in ("n", "ri", "sha", "do", "lu", "x", "ven", "ta", "gor", "mu")]


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n words."""

    def make(n: int, seed: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Documents with nulls, repeats, blanks, very long texts and extra columns whose names clash with inner ones."""
    long = prose(30_000, 1)
    texts = [None, "", " \t\n", "One word", "one WORD", "É é", prose(80, 2), prose(80, 2), prose(80, 2).upper(), long, long + " end", "a\n\nb\n a ", "x" * 50_000, "!!! ###", "same same same same " * 300]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", 7, "k", 1.0, None) for i, t in enumerate(texts)]
    rows += [(6, texts[6], "en", "s0", 7, "k", 1.0, None), (None, "One word", None, "", 7, "k", 1.0, None), (None, None, None, None, 7, "k", 1.0, None), (3, "other text", "en", "s1", 7, "k", 1.0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k1 string, digest double, _maybe string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
