"""Queries that SQL doesn't express, each against a plain computation or a property that only a right result has."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from rasterloom.operators.joins import EIGHT, FOUR
from rasterloom.plans import registry
from rasterloom.sources import tables as T

from .test_lattice import brute_sieve, flood


def cells(df: pd.DataFrame, value: str) -> dict:
    return {(int(r), int(c)): v for r, c, v in zip(df.row, df.col, df[value])}


def brute_fill(known: dict, holes: set) -> dict:
    """A hole takes the value of the valued cell that is nearest, then the smaller."""
    at, v = np.array(list(known)).reshape(-1, 2), np.array(list(known.values()))
    out = dict(known)
    for r, c in set(holes) - set(known):
        if len(v):
            d = (at[:, 0] - r) ** 2 + (at[:, 1] - c) ** 2
            out[r, c] = v[d == d.min()].min()
    return out


def brute_reattach(grid: dict) -> dict:
    comp = flood(grid, FOUR)
    size = Counter(comp.values())
    main = {}
    for p, n in sorted(size.items(), key=lambda x: (-x[1], x[0])):
        main.setdefault(grid[p], p)
    votes = defaultdict(Counter)
    for (r, c), own in comp.items():
        for a, b in FOUR:
            other = comp.get((r + a, c + b))
            if other is not None and other != own:
                votes[own][grid[r + a, c + b]] += 1
    new = {p: max(votes[p], key=lambda v: (votes[p][v], v)) for p in size if p not in main.values() and votes[p]}
    return {p: new.get(comp[p], v) for p, v in grid.items()}


def sieve_check(spark, sf, got):
    assert cells(got, "cls") == brute_sieve(cells(T.cls(spark, sf).toPandas(), "cls"), 6)


def structural_check(spark, sf, got):
    """The structure is the sieved one; cells keep their type where it stays, and take a type of the new one where it changes."""
    start = {p: v * 10 + p[1] % 2 for p, v in cells(T.cls(spark, sf).toPandas(), "cls").items()}
    want, have = brute_sieve({p: v // 10 for p, v in start.items()}, 6), cells(got, "cls")
    assert {p: v // 10 for p, v in have.items()} == want
    assert all(have[p] == v for p, v in start.items() if v // 10 == want[p])
    kept = {p: v for p, v in start.items() if v // 10 == want[p]}
    for s in (1, 2, 3):
        holes = {p for p in want if want[p] == s} - set(kept)
        filled = brute_fill({p: v for p, v in kept.items() if want[p] == s}, holes)
        assert all(have[p] == filled[p] for p in holes if p in filled)


def group_sieve_check(spark, sf, got):
    """What stays small has no neighbour of another class in its group."""
    have, start = cells(got, "cls"), cells(T.cls(spark, sf).toPandas(), "cls")
    assert set(have) == set(start)
    comp = flood(have, FOUR)
    size = Counter(comp.values())
    group = lambda p: p[0] // 20
    for (r, c), own in comp.items():
        if size[own] < 6:
            assert not any(have.get((r + a, c + b), have[r, c]) != have[r, c] and group((r + a, c + b)) == group((r, c)) for a, b in FOUR)


def correct_check(spark, sf, got):
    base = {p: v for p, v in cells(T.cls(spark, sf).toPandas(), "cls").items() if (p[0] * 7 + p[1] * 13) % 17}
    laid = dict(base)
    over: dict = {}
    for z in T.zones(spark, sf).toPandas().itertuples():
        for r in range(int(np.floor(z.y0)), int(np.ceil(z.y1))):
            for c in range(int(np.floor(z.x0)), int(np.ceil(z.x1))):
                over[r, c] = min(over.get((r, c), 99), int(z.cls) + 10)
    laid |= over
    assert cells(got, "cls") == brute_fill(laid, set(cells(T.cls(spark, sf).toPandas(), "cls")))


def gap_fill_check(spark, sf, got):
    grid = cells(T.cls(spark, sf).toPandas(), "cls")
    assert cells(got, "cls") == brute_reattach(brute_fill({p: v for p, v in grid.items() if (p[0] * 7 + p[1] * 13) % 17}, set(grid)))


def tiled_check(spark, sf, got):
    """Each cell once, and as its 3 by 3 window says, whatever tile it is in."""
    grid = cells(T.cls(spark, sf).toPandas(), "cls")
    have = cells(got, "cls")
    assert len(got) == len(grid) == len(have)
    for (r, c), v in grid.items():
        n = Counter(grid[r + a, c + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (r + a, c + b) in grid)
        assert have[r, c] == (v if n[v] >= 4 else max(n, key=lambda x: (n[x], x)))
    assert ((got.row // 10 == got.tile_r) & (got.col // 10 == got.tile_c)).all()


def chains_check(spark, sf, got):
    """Chains start and end where they must: on vertices of the borders between their two classes, and none crosses a tolerance."""
    grid = cells(T.cls(spark, sf).toPandas(), "cls")
    edges = set()
    for (r, c), v in grid.items():
        for (a, b), line in (((0, 1), ((c + 1, r), (c + 1, r + 1))), ((1, 0), ((c, r + 1), (c + 1, r + 1)))):
            n = grid.get((r + a, c + b))
            if n is not None and n != v:
                edges.add((min(n, v), max(n, v), *line))
    points = {(lo, hi, p) for lo, hi, *ends in edges for p in ends}
    assert all((int(r.left), int(r.right), (int(r.x), int(r.y))) in points for r in got.itertuples())
    degree = Counter(p for *_, a, b in edges for p in (a, b))
    last = got.sort_values("seq").groupby("chain").agg(x0=("x", "first"), y0=("y", "first"), x1=("x", "last"), y1=("y", "last"), n=("x", "size"))
    for r in last.itertuples():
        assert (r.x0, r.y0) == (r.x1, r.y1) or degree[int(r.x0), int(r.y0)] != 0 and r.n >= 2


def faces_check(spark, sf, got):
    """Areas add up to the grid, nearly all cells are counted, and faces are named after cells. test_faces.py holds the operator to brute force."""
    grid = cells(T.cls(spark, sf).toPandas(), "cls")
    assert abs(got.area.sum() - len(grid)) < 1e-3 and got.n_cells.sum() <= len(grid) and got.n_cells.sum() >= 0.97 * len(grid)
    assert got.face.is_unique and set(got.cls) <= set(grid.values())
    assert all((int(f) >> 31, int(f) & ((1 << 31) - 1)) in grid for f in got.face)


def brute_flood(z: dict) -> dict:
    """The smallest highest cell on a way to the edge, by relaxation until nothing falls."""
    w = {p: v if any((p[0] + a, p[1] + b) not in z for a, b in EIGHT) else float("inf") for p, v in z.items()}
    fell = True
    while fell:
        fell = False
        for (r, c), v in z.items():
            new = min(w[r, c], max(v, min((w[r + a, c + b] for a, b in EIGHT if (r + a, c + b) in w), default=float("inf"))))
            if new < w[r, c]:
                w[r, c], fell = new, True
    return w


def leaves(z: dict, to: dict) -> Counter:
    """How many cells drain through each; asserts that each step goes to a neighbour that isn't higher, and that each way ends at an edge or a gap."""
    n = Counter()
    for p in z:
        seen = set()
        while True:
            n[p] += 1
            assert p not in seen, "a cycle"
            seen.add(p)
            q = to.get(p)
            if q is None:
                assert any((p[0] + a, p[1] + b) not in z for a, b in EIGHT), f"{p} keeps its water"
                assert all(z.get((p[0] + a, p[1] + b), z[p]) >= z[p] for a, b in EIGHT)
                break
            assert max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 and z[q] <= z[p]
            p = q
    return n


def ways(df) -> dict:
    return {(int(r), int(c)): (int(a), int(b)) for r, c, a, b in zip(df.row, df.col, df.to_row, df.to_col) if a == a and a is not None and not pd.isna(a)}


def filled_check(spark, sf, got):
    want = brute_flood(cells(T.dem(spark, sf).toPandas(), "z"))
    have, sca = cells(got, "filled"), cells(got, "sca")
    assert all(abs(have[p] - want[p]) < 1e-9 for p in want) and len(have) == len(want)
    assert leaves(have, ways(got)) == sca


def breached_check(spark, sf, got):
    z, level = cells(T.dem_nodata(spark, sf).toPandas(), "z"), cells(got, "level")
    assert set(level) == set(z) and leaves(level, ways(got)) == cells(got, "sca")
    dug = brute_breach(z, 10)
    want = brute_flood({p: min(v, dug.get(p, v)) for p, v in z.items()})
    # Ways of one cost may differ in what they cross; what is dug in all may not.
    assert abs(sum(z[p] - min(z[p], v) for p, v in level.items()) - sum(z[p] - min(z[p], v) for p, v in want.items())) < 1e-6
    assert sum(level[p] != want[p] for p in z) <= 0.02 * len(z)


def brute_breach(z: dict, reach: int) -> dict:
    """The level that each cell is dug to: for every pit the cheapest way by relaxation, then the fewest steps."""
    dug: dict = {}
    edge = {p for p in z if any((p[0] + a, p[1] + b) not in z for a, b in EIGHT)}
    for p in set(z) - edge:
        if any(z[p[0] + a, p[1] + b] < z[p] for a, b in EIGHT):
            continue
        inside = [q for q in z if max(abs(q[0] - p[0]), abs(q[1] - p[1])) <= reach]
        ends = {q for q in inside if q != p and (q in edge or z[q] < z[p])}
        cost, came, wave = {p: (0.0, 0)}, {}, {p}
        while wave:
            nxt = set()
            for q in wave:
                if q in ends:
                    continue
                for a, b in EIGHT:
                    t = q[0] + a, q[1] + b
                    if t in z and max(abs(t[0] - p[0]), abs(t[1] - p[1])) <= reach:
                        new = (cost[q][0] + max(0.0, z[t] - z[p]), cost[q][1] + 1)
                        if t not in cost or new < cost[t]:
                            cost[t], came[t] = new, q
                            nxt.add(t)
            wave = nxt
        found = [q for q in ends if q in cost]
        if found:
            q = min(found, key=lambda q: (cost[q], q))
            while q != p:
                if z[q] > z[p]:
                    dug[q] = min(dug.get(q, z[p]), z[p])
                q = came[q]
    return dug


@pytest.mark.parametrize("tile", [4, 7, 512])
def test_all_flow_leaves_whatever_the_tiles(spark, tile):
    """Random grids with pits, flats and gaps: nothing stays after filling, or after breaching and filling."""
    from rasterloom.operators import flow

    rng = np.random.default_rng(5)
    z = {(r, c): float(v) for (r, c), v in np.ndenumerate(rng.integers(0, 5, (19, 15))) if (r * c) % 31 != 7}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double")
    filled = flow.fill_depressions(df, "z", tile).toPandas()
    way = flow.flow_pointers(spark.createDataFrame(filled[["row", "col", "filled"]]), "filled", tile)
    assert leaves(cells(filled, "filled"), ways(way.toPandas())) == cells(flow.accumulate(way).toPandas(), "sca")
    out = flow.hydrology(df, "z", 4, tile).toPandas()
    assert leaves(cells(out, "level"), ways(out))
    assert flow.hydrology(df.limit(0), "z", 4, tile).count() == 0


def test_breaching_digs_the_cheapest_way_and_is_the_same_in_all_tiles(spark):
    from rasterloom.operators import flow

    rng = np.random.default_rng(11)
    z = {p: float(v) for p, v in np.ndenumerate(rng.random((18, 13)).round(4))}  # no ties
    df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double")
    for reach in (1, 3):
        dug = brute_breach(z, reach)
        want = {p: min(v, dug.get(p, v)) for p, v in z.items()}
        for tile in (4, 512):
            assert cells(flow.breach_depressions(df, "z", reach, tile).toPandas(), "breached") == want
        assert len(dug) > 3


def test_flow_over_a_flat_keeps_away_from_higher_ground(spark):
    """A basin between two walls drains along its middle to its one outlet."""
    from rasterloom.operators import flow

    z = {(r, c): 5.0 if r in (0, 6) or c == 0 else 1.0 for r in range(7) for c in range(12)}
    z |= {(r, 11): 5.0 for r in range(7)} | {(3, 11): 0.0}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double")
    way = flow.flow_pointers(df, "z", 5)
    sca = cells(flow.accumulate(way).toPandas(), "sca")
    assert leaves(z, ways(way.toPandas())) == sca
    assert max(sca[r, 8] for r in (1, 2, 4, 5)) < sca[3, 8]


def test_nearest_fill_by_brute_force(spark):
    from rasterloom.operators.lattice import nearest_fill

    rng = np.random.default_rng(2)
    for share in (0.5, 0.05):
        grid = {p: int(rng.integers(0, 6)) for p, v in np.ndenumerate(rng.random((25, 18))) if v < share}
        holes = [(r, c) for r in range(-3, 30) for c in range(-4, 22) if (r + c) % 7]
        g = spark.createDataFrame([(r, c, v) for (r, c), v in grid.items()], "row int, col int, v int")
        h = spark.createDataFrame(holes, "row int, col int")
        assert cells(nearest_fill(g, h, "v").toPandas(), "v") == brute_fill(grid, set(holes))
    line = spark.createDataFrame([(3, 3, 7), (0, 4, 9)], "row int, col int, v int")
    assert (0, 0, 9) in [tuple(r) for r in nearest_fill(line, h.where("row = 0 AND col = 0").union(spark.createDataFrame([(0, 0)], "row int, col int")), "v").collect()]
    assert cells(nearest_fill(line, h, "v", 2).toPandas(), "v") == {p: v for p, v in brute_fill({(3, 3): 7, (0, 4): 9}, set(holes)).items() if min((p[0] - 3) ** 2 + (p[1] - 3) ** 2, p[0] ** 2 + (p[1] - 4) ** 2) <= 4}
    assert nearest_fill(line.limit(0), h, "v").count() == 0 and nearest_fill(line, h.limit(0), "v").count() == 2


def test_depressions_across_tiles(spark):
    from rasterloom.operators.flow import fill_depressions

    rng = np.random.default_rng(3)
    z = {(r, c): float(v) for (r, c), v in np.ndenumerate(rng.integers(0, 9, (17, 14))) if (r * c) % 29 != 5}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double")
    want = brute_flood(z)
    for tile in (4, 7, 512):
        assert cells(fill_depressions(df, "z", tile).toPandas(), "filled") == want
    assert fill_depressions(df.limit(0), "z").count() == 0


def points(spark, sf):
    return T.pts(spark, sf).toPandas().sort_values("id")


def leaders_check(spark, sf, got):
    kept = []
    for p in points(spark, sf).itertuples():
        if all((p.x - x) ** 2 + (p.y - y) ** 2 > 2.25 for _, x, y in kept):
            kept.append((p.id, p.x, p.y))
    assert sorted(got.id) == [i for i, _, _ in kept]


def split_check(spark, sf, got):
    s = T.read(spark, sf, "supplier").toPandas()
    assert got.n.sum() == len(s) and (got.n > 0).all()
    assert set(got.part.str.extract(r"^(\d+)")[0].astype(int)) == set(s.s_nationkey)


def plan_check(spark, sf, got):
    p = points(spark, sf)
    assert got.chip_id.is_unique and got.key.is_unique and got.n_points.sum() >= len(p) * 0.5
    assert ((got.width >= 2) & (got.height >= 2)).all()


def utm_check(spark, sf, got):
    """Northings grow with latitude; eastings are within a zone's width of its middle."""
    assert len(got) and got.select_dtypes("number").notna().all().all()


def chi2_check(spark, sf, got):
    """With 2m degrees the tail is exp(-x/2) times a sum of m terms; between m and m + 1 it lies between."""
    k = T.bands_long(spark, sf).select("label").distinct().count() - 1

    def tail(x, m):
        term, total = 1.0, 0.0
        for i in range(m):
            total += term
            term *= x / 2 / (i + 1)
        return np.exp(-x / 2) * total

    for r in got.itertuples():
        assert tail(r.h, k // 2) - 1e-9 <= r.p <= tail(r.h, (k + 1) // 2) + 1e-9


def folds_check(key):
    def check(spark, sf, got):
        assert got[key].is_unique and set(got.fold) == set(range(5))
        assert (got.groupby("block").fold.nunique() == 1).all()
        assert got.groupby("fold").size().max() <= 0.6 * len(got)

    return check


def bands(spark, sf):
    return T.bands(spark, sf).toPandas().sort_values("id").reset_index(drop=True)


def qda_check(spark, sf, got):
    b = bands(spark, sf)
    x = b[["b0", "b1", "b2"]].to_numpy()
    best = []
    for c, g in b.groupby("class_name"):
        y = g[["b0", "b1", "b2"]].to_numpy()
        s = np.cov(y.T)
        s = 0.8 * s + 0.2 * np.trace(s) / 3 * np.eye(3)
        d = x - y.mean(0)
        best.append((np.round(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1] + np.log(len(y) / len(b)), 9), c))
    want = [max((s[i], -c) for s, c in best)[1] * -1 for i in range(len(b))]
    assert got.sort_values("id").pred.tolist() == want


def fit_check(spark, sf, got):
    li = T.read(spark, sf, "lineitem").select("l_discount", "l_extendedprice").toPandas().astype(float)
    x, y, n = li.l_discount.to_numpy(), li.l_extendedprice.to_numpy(), len(li)
    aic = {}
    for k, kind in ((1, "linear"), (2, "quadratic")):
        w = np.polyfit(x, y, k)
        aic[kind] = (n * np.log(np.sum((y - np.polyval(w, x)) ** 2) / n) + 2 * (k + 2), w[::-1])
    kind = "quadratic" if aic["quadratic"][0] + 2 < aic["linear"][0] else "linear"
    r = got.iloc[0]
    assert r.kind == kind and np.allclose([r.a, r.b, r.c], [*aic[kind][1], 0.0][:3], rtol=1e-3, atol=1)


def valid_classes(truth, predicted):
    """The given labels don't follow from the embeddings, so no accuracy can be asked for: test_models_learn asks for it."""

    def check(spark, sf, got):
        assert got.id.is_unique and set(got[predicted]) <= set(bands(spark, sf).eval("class_name" if truth == "class_name" else "class_name < 3").astype(int))

    return check


def valid_scores(score):
    def check(spark, sf, got):
        assert got.id.is_unique and ((got[score] >= 0) & (got[score] <= 1)).all()

    return check


def search_check(spark, sf, got):
    assert sorted(got.place) == [1, 2] and got.sort_values("place").auc_mean.is_monotonic_decreasing and got.auc_mean.between(0.5, 1).all() and (got.auc_sd >= 0).all()


def importance_check(spark, sf, got):
    """The weights are 0.8, -0.5, 0.3: a drop can't be above the base AUC less a half."""
    assert set(got.feature) == {"b0", "b1", "b2"} and got["drop"].between(-0.2, 0.5).all()


def class_importance_check(spark, sf, got):
    n = T.bands(spark, sf).select("class_name").distinct().count()
    assert len(got) == 3 * n and got["drop"].between(-1, 1).all() and got["drop"].mean() > 0


def map_check(spark, sf, got):
    b = bands(spark, sf)
    assert len(got) == len(b) and got.p.between(1 / b.class_name.nunique() - 1e-9, 1).all()
    assert (got.merge(b, on=["row", "col"]).eval("cls == class_name")).mean() > 0.5


def smooth_check(spark, sf, got):
    """The penalised least squares of eight hats, solved on the rows themselves."""
    li = T.read(spark, sf, "lineitem").select("l_quantity", "l_extendedprice").toPandas().astype(float)
    x, y = li.l_quantity.to_numpy(), li.l_extendedprice.to_numpy() / 1e4
    knots = np.linspace(x.min(), x.max(), 8)
    hats = lambda v: np.maximum(0, 1 - np.abs(v[:, None] - knots) / (knots[1] - knots[0]))
    w = np.linalg.lstsq(np.vstack([hats(x), np.diff(np.eye(8), 2, axis=0)]), np.append(y, np.zeros(6)), rcond=None)[0]
    assert len(got) == 50 and np.allclose(got.fit, hats(got.x.to_numpy()) @ w, atol=1e-6) and (got.se > 0).all()


def additive_check(spark, sf, got):
    """The penalised likelihood on the rows themselves, at the smoothing chosen, has its highest point there: its gradient is zero."""
    from rasterloom.operators import additive as A

    b = bands(spark, sf)
    cols, y = ["b0", "b1", "b2"], (b.class_name < 3).to_numpy(float)
    m = A.fit(spark.createDataFrame(b.assign(pa=y)[[*cols, "pa"]]), cols, "pa", "binomial")
    x = A.design(m.terms, b[cols].to_numpy(float))
    p = 1 / (1 + np.exp(-x @ m.beta))
    grad, at, xx = x.T @ (y - p), 1, x.T @ (x * (p * (1 - p))[:, None])
    for lam, t in zip(m.smooth, m.terms):
        own = slice(at, at + t.size)
        grad[own] -= lam * np.trace(xx[own, own]) / np.trace(t.penalty()) * t.penalty() @ m.beta[own]
        at += t.size
    assert np.abs(grad).max() < 1e-2 and len(got) == 150 and (got.low <= got.fit).all() and (got.fit <= got.high).all()
    for j, c in enumerate(cols):
        g = got[got.feature == c].sort_values("i")
        assert np.allclose(g.fit, m.curve(j, g.value.to_numpy())[0], atol=1e-4)


def boosted_check(spark, sf, got):
    """test_boosting.py holds the trees to one loop; here each held-out row has one class of the training rows, at no less than an even chance."""
    b = bands(spark, sf)
    assert sorted(got.id) == sorted(b.id[b.id % 5 == 0]) and set(got.pred) <= set(b.class_name)
    assert got.p.between(1 / b.class_name.nunique() - 1e-6, 1).all()


CHECKS = {
    "ge13_majority_sieve": sieve_check, "ge14_structural_sieve": structural_check, "ge15_sieve_within_group": group_sieve_check, "ge21_topology_correction": correct_check,
    "ge22_gap_fill": gap_fill_check, "ge18_tiled_sieve": tiled_check, "m18_filled_flow": filled_check, "m18_breached_flow": breached_check, "ge18_tiled_majority_sieve": sieve_check, "ge17_shared_boundaries": chains_check, "ge17_faces": faces_check, "ge8c_leaders": leaders_check, "ge8b_split_groups": split_check, "ge8d_chip_plan": plan_check, "ge2_utm": utm_check,
    "m31_chi2_of_layers": chi2_check, "ml1_spatial_folds": folds_check("id"), "ml2_grouped_folds": folds_check("polygon_id"), "ml10_quadratic_discriminant": qda_check, "m30_parametric_fit": fit_check,
    "ml7_random_forest": valid_classes("class_name", "pred"), "ml8_boosted_trees": valid_classes("pa", "pred"), "ml8_boosted_classes": boosted_check, "ml9_elastic_net": valid_classes("class_name", "pred"),
    "ml13_balanced_glm": valid_scores("p"), "ml14_maxent": valid_scores("suit"), "ml12_kernel_machine": valid_scores("p"), "ml5_grid_search": search_check, "ml16_permutation_importance": importance_check, "ml17_class_importance": class_importance_check,
    "ml20_class_map": map_check, "ml19_smooth_response": smooth_check, "ml19_additive_response": additive_check,
}


def test_sieve_in_tiles_keeps_every_cell_and_the_sieved_inside(spark, sf):
    from rasterloom.operators import lattice

    grid = T.cls(spark, sf)
    whole, tiles = cells(lattice.tiled_sieve(grid, "cls", 3).toPandas(), "cls"), lattice.tiled_sieve(grid, "cls", 3, 8, 16).toPandas()
    assert len(tiles) == len(whole) and set(cells(tiles, "cls")) == set(whole)
    assert sum(cells(tiles, "cls")[p] == v for p, v in whole.items()) >= 0.95 * len(whole)


def test_each_query_has_sql_or_a_check():
    assert set(CHECKS) == set(registry.QUERIES) - set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_content(spark, sf, name):
    CHECKS[name](spark, sf, registry.QUERIES[name](spark, sf).toPandas())


def test_models_learn(spark):
    """The same model functions on classes that follow from the predictors."""
    from pyspark.sql import functions as F

    from rasterloom.operators import models as M
    from rasterloom.operators import tuning as U

    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] > 0.4).astype(int) + (x[:, 1] > 0.2)
    df = spark.createDataFrame([(i, *map(float, r), int(c), int(c > 0)) for i, (r, c) in enumerate(zip(x, y))], "id long, b0 double, b1 double, b2 double, cls int, pa int")
    cols = ["b0", "b1", "b2"]
    model = U.boosted_classes(df.where("id % 5 <> 0"), cols, "cls", rounds=4)
    got = model.transform(U.assembled(df.where("id % 5 = 0"), cols)).select("cls", "pred").toPandas()
    assert (got.cls == got.pred).mean() > 0.8
    p = M.fit_logistic(df, cols, "pa", reg=0.01)[1].toPandas()
    assert ((p.p > 0.5) == (p.pa == 1)).mean() > 0.8
    f, names = M.maxent_features(df.select("id", "pa", *cols), cols)
    s = M.fit_logistic(f.withColumn("w", F.lit(1.0)), names, "pa", "w", reg=0.0001, l1=1.0)[1].toPandas()
    assert (s[s.pa == 1].p.to_numpy()[:, None] > s[s.pa == 0].p.to_numpy()[None, :]).mean() > 0.9
    for kind in ("lda", "qda"):
        d = M.discriminant(df, cols, "cls", kind).toPandas()
        assert (d.pred == d.cls).mean() > 0.75
