"""Small grids with answers by hand or by brute force."""

from __future__ import annotations

from collections import Counter, deque

from rasterloom.operators import flow, focal, geometry, lattice, models, predicates, windows
from rasterloom.operators.joins import EIGHT, FOUR


def grid(spark, text, name="cls"):
    cells = [(r, c, int(v)) for r, line in enumerate(text.split()) for c, v in enumerate(line) if v != "."]
    return spark.createDataFrame(cells, f"row int, col int, {name} int")


def as_text(df, name="cls"):
    cells = {(r["row"], r["col"]): r[name] for r in df.collect()}
    h, w = max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1
    return " ".join("".join(str(cells.get((r, c), ".")) for c in range(w)) for r in range(h))


def flood(cells: dict, steps):
    out = {}
    for start in sorted(cells):
        if start in out:
            continue
        todo = deque([start])
        out[start] = start
        while todo:
            r, c = todo.popleft()
            for a, b in steps:
                n = (r + a, c + b)
                if n in cells and n not in out and cells[n] == cells[r, c]:
                    out[n] = start
                    todo.append(n)
    return out


def test_components_by_flood_fill(spark):
    text = "1122112 1211221 2211212 1122121 2121211 1112221"
    g = grid(spark, text)
    cells = {(r["row"], r["col"]): r["cls"] for r in g.collect()}
    for steps, tile in ((FOUR, 512), (EIGHT, 512), (FOUR, 3), (EIGHT, 2)):
        got = {(r["row"], r["col"]): (r["comp"] // 100, r["comp"] % 100) for r in lattice.cell_components(g, "cls", steps, width=100, tile=tile).collect()}
        assert got == flood(cells, steps)


def test_components_with_gaps_and_empty(spark):
    g = grid(spark, "1.1 111")
    assert lattice.cell_components(g, "cls").select("comp").distinct().count() == 1
    assert lattice.cell_components(g.limit(0), "cls").count() == 0


def test_sieve_fills_a_speck_and_keeps_large_ones(spark):
    g = grid(spark, "11111 11211 11111 33333 33333")
    assert as_text(lattice.sieve(g, "cls", 3)) == "11111 11111 11111 33333 33333"


def test_sieve_tie_takes_the_larger_class(spark):
    # The single 5 borders on two cells of 1 and two of 3.
    g = grid(spark, "11133 11533 11133".replace("11533", "11533"))
    n = Counter({"1": 0, "3": 0})
    got = as_text(lattice.sieve(grid(spark, "1111 1115 3333 3333".replace("1115", "1115")), "cls", 2))
    assert got == "1111 1113 3333 3333" or got == "1111 1111 3333 3333"
    assert "5" not in as_text(lattice.sieve(g, "cls", 2)) and n


def test_sieve_of_small_ones_only_stops(spark):
    got = lattice.sieve(grid(spark, "12 34"), "cls", 10)
    assert got.count() == 4


def test_sieve_goes_on_while_small_ones_border_a_large_one(spark):
    rows = [(0, c, 1 if c < 3 else 10 + c) for c in range(36)]
    got = lattice.sieve(spark.createDataFrame(rows, "row long, col long, cls long"), "cls", 3).collect()
    assert len(got) == 36 and {r["cls"] for r in got} == {1}


def test_nearest_fill(spark):
    g = grid(spark, "1...2", "v")
    holes = spark.createDataFrame([(0, c) for c in range(5)], "row int, col int")
    assert as_text(lattice.nearest_fill(g, holes, "v"), "v") == "11122"


def test_morphology(spark):
    c = grid(spark, "11.11 11.11 11.11").select("row", "col")
    assert lattice.close_gaps(c).count() == 15
    assert lattice.erode(grid(spark, "111 111 111").select("row", "col")).count() == 1


def test_fill_holes(spark):
    g = grid(spark, "11111 10111 11111", "m")
    assert as_text(lattice.fill_holes(g, 3), "m") == "11111 11111 11111"


def test_flow_adds_up_along_a_slope(spark):
    g = spark.createDataFrame([(r, 0, float(10 - r)) for r in range(6)], "row int, col int, z double")
    got = {r["row"]: r["sca"] for r in flow.accumulate(focal.d8(g, "z")).collect()}
    assert got == {r: r + 1 for r in range(6)}


def test_geomorphon_of_a_peak(spark):
    g = spark.createDataFrame([(r, c, 10.0 - 3 * max(abs(r - 2), abs(c - 2))) for r in range(5) for c in range(5)], "row int, col int, z double")
    got = {(r["row"], r["col"]): r["form"] for r in flow.geomorphons(g, "z", 2).collect()}
    assert got[2, 2] == "peak"


def test_slope_of_a_plane(spark):
    g = spark.createDataFrame([(r, c, 2.0 * c) for r in range(7) for c in range(7)], "row int, col int, z double")
    for weights in (focal.horn(), focal.least_squares()):
        t = focal.slope_aspect(focal.kernel(g, "z", weights)).where("row = 3 AND col = 3").first()
        assert abs(t["slope"] - 63.4349) < 1e-3 and abs(t["aspect"] - 270) < 1e-6


def test_focal_mean_with_gaps(spark):
    g = spark.createDataFrame([(0, 0, 1.0), (0, 3, 5.0)], "row int, col int, z double")
    got = {r["col"]: r["mean"] for r in focal.focal_mean(g, "z", 1).collect()}
    assert got == {0: 1.0, 3: 5.0}


def test_leaders_and_clusters(spark):
    p = spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate((0, 1, 2, 3, 10))], "id long, x double, y double")
    assert sorted(r["id"] for r in geometry.leaders(p, 1.0).collect()) == [0, 2, 4]
    assert {r["id"]: r["comp"] for r in geometry.clusters(p, 1.0).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}


def test_utm_of_a_known_point(spark):
    from pyspark.sql import functions as F

    e, n = geometry.utm(F.lit(3.0), F.lit(0.0), F.lit(31))
    assert [round(x, 3) for x in spark.range(1).select(e, n).first()] == [500000.0, 0.0]
    e, n = geometry.utm(F.lit(2.2945), F.lit(48.8582), F.lit(31))
    x, y = spark.range(1).select(e, n).first()
    assert abs(x - 448251.795) < 0.01 and abs(y - 5411932.678) < 0.01


def test_greedy_blocks():
    got = models.assign_blocks([{"block": i, "counts": {i % 2: 10}} for i in range(4)], 2)
    assert sorted(Counter(got.values()).values()) == [2, 2]


def test_names_and_selections():
    assert predicates.unique_names(["S2_BAI", "S2_BaI", "x"]) == ["S2_BAI", "S2_BaI_2", "x"]
    assert predicates.selection("1,3,5-7,3") == [1, 3, 5, 6, 7]


def test_whole_groups_pass_over_what_does_not_fit(spark):
    from pyspark.sql import functions as F

    g = spark.createDataFrame([(1, 5), (2, 9), (3, 4), (4, 1)], "chip int, n int")
    assert sorted(r["chip"] for r in windows.whole_groups(g, "n", [F.col("chip")], 10).collect()) == [1, 3, 4]


def brute_sieve(cells: dict, min_cells: int) -> dict:
    """The sieve's rule, cell by cell."""
    for _ in range(30):
        comp = flood(cells, FOUR)
        size = Counter(comp.values())
        small = {c for c, n in size.items() if n < min_cells}
        if not small:
            break
        edges: dict = {}
        for (r, c), own in comp.items():
            if own in small:
                for a, b in FOUR:
                    n = comp.get((r + a, c + b))
                    if n is not None and n != own:
                        edges.setdefault(own, Counter())[n] += 1

        def votes(ok):
            out = {}
            for own, near in edges.items():
                v = Counter()
                for n, k in near.items():
                    if ok(own, n):
                        v[cells[n]] += k
                if v:
                    out[own] = max(v, key=lambda x: (v[x], x))
            return out

        new = votes(lambda own, n: n not in small) or votes(lambda own, n: (size[n], tuple(-x for x in n)) > (size[own], tuple(-x for x in own)))
        if not new:
            break
        cells = {p: new.get(comp[p], v) for p, v in cells.items()}
    return cells


def test_sieve_by_brute_force(spark):
    import random

    r = random.Random(8)
    cells = {(i, j): r.choice((1, 1, 2, 3)) for i in range(14) for j in range(11) if r.random() > 0.05}
    g = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], "row int, col int, cls int")
    got = {(x["row"], x["col"]): x["cls"] for x in lattice.sieve(g, "cls", 5).collect()}
    assert got == brute_sieve(cells, 5)


def test_sieve_in_tiles_by_brute_force(spark, monkeypatch):
    """Tiles that components and chains of votes cross give what the whole grid gives, in few passes; cells without a class stay."""
    import random

    r, made = random.Random(11), []
    monkeypatch.setattr(lattice, "_shared", lambda df, what, f=lattice._shared: (made.append(what), f(df, what))[1])
    for least, colours, tile in ((3, (1, 1, 2, 3), 9), (4, tuple(range(9)), 12), (6, (1, 2, 3), 32)):
        cells = {(i - 20, j): r.choice(colours) for i in range(60) for j in range(14) if r.random() > 0.05}
        rows = [(i, j, v) for (i, j), v in cells.items()] + [(100, 3, None)]
        g = spark.createDataFrame(rows, "row int, col int, cls int")
        made.clear()
        got = {(x["row"], x["col"]): x["cls"] for x in lattice.sieve(g, "cls", least, tile=tile).collect()}
        assert got.pop((100, 3)) is None and got == brute_sieve(cells, least)
        assert set(made) == {"sieve"}
    assert len(made) < 6


def test_sieve_in_tiles_counts_rounds(spark):
    rows = [(0, c, 1 if c < 3 else 10 + c) for c in range(36)]
    g = spark.createDataFrame(rows, "row int, col int, cls int")
    for n in (0, 1, 7, 20):
        got = lattice.sieve(g, "cls", 3, rounds=n, tile=20).collect()
        assert sum(x["cls"] == 1 for x in got) == 3 + n
