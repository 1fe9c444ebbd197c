"""The n-gram join against a comparison of all pairs, and DivideSkip against counting."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import ngram_join

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words=5):
    w = (text or "").translate(UPPER).encode().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def linked(x, y):
    n = len(x & y)
    return bool(x and y) and 100 * n >= 80 * (len(x) + len(y) - n)


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(docs, **more):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_sets(docs, **more).collect())


def test_components_of_odd_rows(odd, none):
    assert got(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert got(none) == Counter()


@pytest.mark.parametrize("rounds", [1, 3])
def test_components_of_chains_templates_and_near_copies(spark, prose, rounds):
    """Chains whose ends aren't alike, sets at and next to the threshold, a template with changing parts, equal and short texts."""
    r, texts = random.Random(3), []
    base = prose(60, 1).split()
    for i in range(40):  # each differs from the one before by one word, so the first and the last have little in common
        base[i % 60] = f"word{i}"
        texts.append(" ".join(base))
    long = prose(300, 2).split()
    for i in range(60):
        other = list(long)
        for j in r.sample(range(300), r.randrange(0, 9)):
            other[j] = f"x{i}y{j}"
        texts.append(" ".join(other))
    for n in (45, 50, 54, 90):  # cut to about 4/5
        whole = prose(n, 10 + n).split()
        texts += [" ".join(whole[: k + 4]) for k in range((n - 4) * 4 // 5 - 2, (n - 4) * 4 // 5 + 3)] + [" ".join(whole)]
    lines = [prose(12, 100 + i) for i in range(12)]
    texts += ["\n".join(r.sample(lines, 5)) for _ in range(60)]  # all shingles are common, few texts are alike
    texts += ["a b c d e f g h", "A  b c d e f g h i", "a b c d e", "a b c d", "a b\tc d", "", None, "zz"] * 2
    r.shuffle(texts)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(docs, rounds=rounds) == brute(rows)


def test_search_of_all_lists_finds_each_link_between_components(spark, prose):
    """With labels of their own, no group search: the join alone has the answer, each pair once."""
    r = random.Random(9)
    texts = []
    for g in range(6):
        base = prose(80 + 20 * g, g).split()
        for i in range(9):
            other = list(base)
            for j in r.sample(range(len(base)), r.randrange(0, 4)):
                other[j] = f"w{i}"
            texts.append(" ".join(other))
    sets = {i: s for i, s in enumerate(ngram_join.shingle_set(t.encode()) for t in texts)}
    own = {i: s for i, s in sets.items() if not any(np.array_equal(s, sets[j]) for j in range(i))}
    members = spark.createDataFrame([(i, len(s), s.tolist(), i) for i, s in own.items()], "cls long, n long, tokens array<long>, label long")
    pairs = ngram_join.candidates(members)
    assert pairs.count() == pairs.select(F.least("q", "y"), F.greatest("q", "y")).distinct().count()
    found = {tuple(sorted((p["u"], p["v"]))) for p in ngram_join.verified(pairs, members).collect()}
    want = {(i, j) for i in own for j in own if i < j and (n := len(np.intersect1d(own[i], own[j]))) * 100 >= 80 * (len(own[i]) + len(own[j]) - n)}
    assert found == want and len(want) > 20


def test_sets_in_a_group_of_one_label_make_no_pairs(spark):
    rows = [(i, 20, list(range(19)) + [100 + i], 0) for i in range(200)] + [(500, 20, list(range(19)) + [7000], 500)]
    members = spark.createDataFrame(rows, "cls long, n long, tokens array<long>, label long")
    assert ngram_join.candidates(members).count() == 200


def test_a_family_of_unlike_sets_makes_no_pairs(spark):
    """Sets of 300 out of 400 shingles, 0.6 of the union shared, are told apart before a pair is made; a linked pair among them is found."""
    r = np.random.default_rng(2)
    pool = r.integers(-(1 << 62), 1 << 62, 400)
    sets = {i: r.choice(pool, 300, replace=False) for i in range(60)}
    sets[60] = np.append(sets[7][10:], np.setdiff1d(pool, sets[7])[:10])
    members = spark.createDataFrame([(i, len(x), np.sort(x).tolist(), i) for i, x in sets.items()], "cls long, n long, tokens array<long>, label long")
    want = [(i, j) for i in sets for j in sets if i < j and linked(set(sets[i].tolist()), set(sets[j].tolist()))]
    assert [tuple(sorted((p["q"], p["y"]))) for p in ngram_join.candidates(members).collect()] == want == [(7, 60)]


def test_divide_skip_finds_each_component_of_leaders():
    r = random.Random(4)
    pool = [r.sample(range(60), r.randrange(4, 30)) for _ in range(8)]
    for _ in range(60):
        leaders, kept = ngram_join.Leaders(), []
        sets = sorted((sorted(set(r.choice(pool)) ^ set(r.sample(range(60), r.randrange(0, 5)))) for _ in range(40)), key=len)
        for s in filter(None, sets):
            alike = [i for i, k in enumerate(kept) if linked(set(s), set(k))]
            near = leaders.search(s)
            assert set(near) <= set(alike) and sorted(map(leaders.top, near)) == sorted({leaders.top(i) for i in alike})
            if leaders.add(s, near):
                kept.append(s)


def test_heads_share_enough():
    """Whatever the sets, those that are linked share hits() of the smaller one in their heads."""
    r = np.random.default_rng(6)
    for _ in range(3000):
        n = int(r.integers(1, 60))
        x = r.choice(1 << 20, n, replace=False)
        y = np.concatenate([x[: n - int(r.integers(0, n // 5 + 1))], (1 << 20) + r.choice(1 << 20, int(r.integers(0, n // 5 + 1)), replace=False)])
        if linked(set(x.tolist()), set(y.tolist())):
            mix = lambda s: np.sort(s * 0x9E3779B1 % (1 << 31))
            a, b = (mix(s)[: ngram_join.head(len(s))] for s in (x, y))
            shared = len(np.intersect1d(a, b))
            assert shared >= ngram_join.hits(min(len(x), len(y)))
            assert shared >= max(ngram_join.hits(ngram_join.overlap(len(s))) for s in (x, y))


def test_a_group_in_parts_is_joined_by_the_sets_in_its_middle(spark, prose, monkeypatch):
    """Forty texts like one in the middle and unlike each other, in parts of six."""
    monkeypatch.setattr(ngram_join, "GROUP", 6)
    r, base = random.Random(1), prose(120, 5).split()
    texts = [" ".join(base)]
    for i in range(40):
        other = list(base)
        for j in r.sample(range(0, 120, 6), 2):
            other[j] = f"x{i}y{j}"
        texts.append(" ".join(other))
    rows = [(i, t) for i, t in enumerate(texts)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)
