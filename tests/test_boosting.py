"""Distributed softmax boosting grows the trees that one loop over whole arrays grows, and beats one model for each class."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from rasterloom.operators import boosting as B
from rasterloom.operators import tuning as U


def fixture(spark, n=600, seed=5):
    """Three classes as a ring, a corner and the rest, one rare; some values missing."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where((x[:, :2] ** 2).sum(1) < 0.8, 0, np.where((x[:, 0] > 0.8) & (x[:, 2] > 0), 2, 1))
    miss = rng.random((n, 3)) < 0.05
    rows = [(i, int(c), *[None if m else float(v) for v, m in zip(vs, ms)]) for i, (c, vs, ms) in enumerate(zip(y, x, miss))]
    return spark.createDataFrame(rows, "id long, cls int, a double, b double, c double")


def one_loop(x, y, edges, rounds, depth, rate, l2, w):
    """Trees as {heap place: (feature, cut) or leaf}, by plain loops over rows' sets."""
    classes = sorted(set(y))
    k_of = np.searchsorted(classes, y)
    b = np.stack([np.where(np.isnan(x[:, j]), len(e) + 1, np.searchsorted(e, x[:, j], side="left")) for j, e in enumerate(edges)], 1)
    mass = np.array([w[k] * (k_of == k).sum() for k in range(len(classes))])
    s = np.tile(np.log(mass / mass.sum()), (len(y), 1))
    out = []
    for _ in range(rounds):
        e = np.exp(s)
        p = e / e.sum(1, keepdims=True)
        step, trees = np.zeros_like(s), []
        for k in range(len(classes)):
            g, h = w[k_of] * (p[:, k] - (k_of == k)), w[k_of] * p[:, k] * (1 - p[:, k])
            tree = {}

            def split(at, rows, level, k=k, g=g, h=h, tree=tree, step=step):
                best = (1e-12, None, None)
                if level < depth:
                    for f in range(b.shape[1]):
                        for c in np.unique(b[rows, f])[:-1]:
                            left = rows[b[rows, f] <= c]
                            right = rows[b[rows, f] > c]
                            if min(h[left].sum(), h[right].sum()) >= 1e-3:
                                gain = sum(g[r].sum() ** 2 / (h[r].sum() + l2) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                                if gain > best[0] * (1 + 1e-8):
                                    best = (gain, f, c)
                if best[1] is None:
                    tree[at] = step[rows, k] = -rate * g[rows].sum() / (h[rows].sum() + l2)
                    return
                tree[at] = (best[1], int(best[2]))
                split(2 * at + 1, rows[b[rows, best[1]] <= best[2]], level + 1)
                split(2 * at + 2, rows[b[rows, best[1]] > best[2]], level + 1)

            split(0, np.arange(len(y)), 0)
            trees.append(tree)
        s = s + step
        out.append(trees)
    return out


@pytest.mark.parametrize("balanced", [False, True])
def test_tree_by_tree(spark, balanced, monkeypatch):
    monkeypatch.setattr(B, "STORE_EVERY", 2)
    df = fixture(spark, 300).repartition(5)
    weights = B.class_weights(df, "cls") if balanced else None
    model = B.fit(df, ["a", "b", "c"], "cls", rounds=3, depth=3, bins=8, weights=weights)
    pdf = df.toPandas()
    w = np.array([weights[c] if weights else 1.0 for c in model.classes])
    want = one_loop(pdf[["a", "b", "c"]].to_numpy(float), pdf["cls"].to_numpy(), model.edges, 3, 3, 0.3, 1.0, w)
    for r, trees in enumerate(want):
        for k, tree in enumerate(trees):
            f, c, v = model.feature[r][k], model.cut[r][k], model.value[r][k]
            for at, node in tree.items():
                if isinstance(node, tuple):
                    assert f[at] == node[0]
                    # between empty bins any cut is the same; the first is taken
                    assert c[at] <= node[1]
                else:
                    assert f[at] == -1 and abs(v[at] - node) < 1e-9


def test_log_loss_below_one_against_the_others(spark):
    df = fixture(spark, 1500).na.fill(0.0)
    train, test, cols = df.where("id % 3 <> 0"), df.where("id % 3 = 0"), ["a", "b", "c"]
    soft = B.fit(train, cols, "cls", rounds=16)
    loss = B.log_loss(soft.transform(test), "cls", soft.classes).first()
    others = U.boosted_classes(train, cols, "cls")
    v = U.assembled(test, cols)
    ps = [np.array([r[0] for r in m.transform(v).orderBy("id").select(vector_to_array("probability")[1]).collect()]) for m in others.models]
    p = np.stack(ps, 1) / np.stack(ps, 1).sum(1, keepdims=True)
    y = np.array([r[0] for r in v.orderBy("id").select("cls").collect()])
    assert loss["n"] == len(y) and loss["loss"] < -np.log(p[np.arange(len(y)), y]).mean()
    assert soft.transform(test).where("pred = cls").count() > 0.9 * len(y)


def test_odd_rows(spark):
    """Rows without a label are left out; one class, constant and all-null columns make no cut; empty tables say so."""
    schema = "id long, cls int, a double, b double"
    one = B.fit(spark.createDataFrame([(1, 4, 1.0, None), (2, 4, 1.0, None), (3, None, 2.0, None)], schema), ["a", "b"], "cls", rounds=2)
    got = one.transform(spark.createDataFrame([(9, None, None, 5.0)], schema)).first()
    assert one.classes == [4] and got["pred"] == 4 and got["p"] == [1.0]
    with pytest.raises(ValueError):
        B.fit(spark.createDataFrame([], schema), ["a"], "cls")
    weights = B.class_weights(spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 0.0, 0.0), (3, 0, 0.0, 0.0), (4, 1, 0.0, 0.0)], schema), "cls")
    assert weights[0] * 3 == pytest.approx(weights[1])
