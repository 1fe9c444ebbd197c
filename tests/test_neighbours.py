"""The k-d search gives what all distances give, and looks at few of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import neighbours as N


def brute(train: list[tuple], test: list[tuple], k: int) -> list[tuple]:
    out = []
    usable = [t for t in train if None not in t and not any(v != v for v in t[1:])]
    for i, *x in test:
        if None in x or any(v != v for v in x):
            continue
        d = sorted((round(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x, y)))), 9), j) for j, *y in usable)
        out += [(i, n + 1, j, e) for n, (e, j) in enumerate(d[:k])]
    return sorted(out)


def found(spark, train, test, k, dims, per_box=4):
    cols = [f"x{i}" for i in range(dims)]
    schema = "id long, " + ", ".join(f"{c} double" for c in cols)
    ix = N.index(spark.createDataFrame(train, schema), cols, k, per_box=per_box)
    return ix, sorted(tuple(r) for r in N.search(spark.createDataFrame(test, schema), ix, cols).collect())


@pytest.mark.parametrize("dims,k,kind", [(1, 3, "grid"), (2, 1, "even"), (2, 5, "grid"), (3, 4, "clumps")])
def test_equals_all_distances(spark, dims, k, kind):
    """Ties on a grid, clumps far apart, rows on training rows, rows outside all boxes, nulls and NaN."""
    rng = np.random.default_rng(dims * 10 + k)
    draw = {"grid": lambda n: rng.integers(0, 6, (n, dims)).astype(float), "even": lambda n: rng.random((n, dims)), "clumps": lambda n: rng.normal(rng.integers(0, 3, (n, 1)) * 50.0, 1.0, (n, dims))}[kind]
    train = [(i, *map(float, x)) for i, x in enumerate(draw(300))]
    test = [(i, *map(float, x)) for i, x in enumerate(draw(80))] + [(1000, *[1e4] * dims), (1001, *[None] * dims), (1002, *[float("nan")] * dims), (1003, *train[7][1:])]
    train += [(900, *[None] * dims), (901, *[float("nan")] * dims)]
    _, got = found(spark, train, test, k, dims)
    want = brute(train, test, k)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-9)


def test_one_point_with_most_rows_few_rows_and_none(spark):
    same = [(i, 1.0, 1.0) for i in range(500)] + [(i, float(i % 7), 2.0) for i in range(500, 560)]
    ix, got = found(spark, same, [(1, 1.0, 1.0), (2, 6.0, 2.5)], 3, 2)
    assert got == brute(same, [(1, 1.0, 1.0), (2, 6.0, 2.5)], 3) and ix.n.sum() < 60
    few = [(1, 0.0, 0.0), (2, 3.0, 4.0)]
    assert found(spark, few, [(5, 0.0, 0.0)], 5, 2)[1] == [(5, 1, 1, 0.0), (5, 2, 2, 5.0)]
    assert found(spark, [], [(5, 0.0, 0.0)], 5, 2)[1] == []
    assert found(spark, few, [], 5, 2)[1] == []


def test_looks_at_less_than_a_tenth_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    make = lambda n: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))], "id long, x0 double, x1 double")
    train, test, cols = make(6000), make(500), ["x0", "x1"]
    ix = N.index(train, cols, 5)
    rows, xs = N._values(test, cols, "id", "q")
    own = N.in_boxes(rows, xs, ix.tree)
    one = N._nearest(N._pairs(own, ix, xs), 5)
    bound = one.groupBy("_q").agg(F.max(F.when(F.col("n") == 5, F.col("_d"))).alias("_bound"))
    cut = N.other_boxes(own.withColumnRenamed("_box", "_own").join(bound, "_q", "left"), ix, xs)
    size = dict(zip(ix.box.tolist(), ix.n.tolist()))
    looked = sum(size.get(r["_box"], 0) for df in (own, cut) for r in df.select("_box").collect())
    assert looked < 6000 * 500 / 10


def test_votes(spark):
    """A row on a training row follows the rows at distance 0 only; ties go to the smaller class."""
    near = spark.createDataFrame([(1, 1, 10, 0.0), (1, 2, 11, 0.1), (1, 3, 12, 0.1), (2, 1, 11, 1.0), (2, 2, 10, 2.0), (2, 3, 13, 2.0)], "id long, n int, neighbour long, distance double")
    train = spark.createDataFrame([(10, 5), (11, 3), (12, 3), (13, 5)], "id long, cls int")
    got = {(r["id"], r["k"], r["weights"]): r["pred"] for r in N.votes(near, train, [1, 2, 3], "cls").collect()}
    assert got == {
        (1, 1, "uniform"): 5, (1, 2, "uniform"): 3, (1, 3, "uniform"): 3, (1, 1, "distance"): 5, (1, 2, "distance"): 5, (1, 3, "distance"): 5,
        (2, 1, "uniform"): 3, (2, 2, "uniform"): 3, (2, 3, "uniform"): 5, (2, 1, "distance"): 3, (2, 2, "distance"): 3, (2, 3, "distance"): 3,
    }
