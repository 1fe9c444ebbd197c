"""Work that grows with the rows, not with their square: frames, files and groups of mended operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rasterloom.operators import joins, lattice, polygons, windows
from rasterloom.ship import stored


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString().lower()


def runs_to_the_end(plan: str) -> bool:
    """Whether a frame starts inside its partition and ends with it: such frames are worked out anew for each row."""
    return re.search(r"(?<!unboundedpreceding\$\(\), )unboundedfollowing", plan) is not None


def test_nearest_fill_has_no_frame_to_the_end(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(lattice, "_shared", lambda df, what: plans.append(plan_of(df)) or stored(df, what))
    g = spark.range(600).select((F.col("id") / 3).cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col"), F.col("id").alias("v")).where("row % 7 <> 2 AND row NOT BETWEEN 40 AND 60")
    cells = spark.range(600).select((F.col("id") / 3).cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col"))
    got = {(r["row"], r["col"]): r["v"] for r in lattice.nearest_fill(g, cells, "v").collect()}
    assert plans and not any(map(runs_to_the_end, plans))
    have = {(r["row"], r["col"]): r["v"] for r in g.collect()}
    for r in range(200):
        for c in range(3):
            assert got[r, c] == have.get((r, c), min(((r - a) ** 2 + (c - b) ** 2, v) for (a, b), v in have.items())[1])


def test_nearest_fill_over_wide_rows_and_bands(spark):
    """Bands of several rows and rows that are a band of their own give the same."""
    have = {(r, c * 1000): r * 10 + c for r in (0, 300, 511) for c in range(4)}
    g = spark.createDataFrame([(r, c, v) for (r, c), v in have.items()], "row int, col int, v int")
    holes = [(r, c) for r in (1, 150, 255, 256, 400) for c in (0, 499, 500, 2999)]
    for wide in (0, 400_000):
        ask = holes + ([(256, wide)] if wide else [])
        got = {(r["row"], r["col"]): r["v"] for r in lattice.nearest_fill(g, spark.createDataFrame(ask, "row int, col int"), "v").collect()}
        for r, c in ask:
            assert got[r, c] == min(((r - a) ** 2 + (c - b) ** 2, v) for (a, b), v in have.items())[1]


def test_best_cut_has_no_frame_to_the_end(spark):
    p = spark.createDataFrame([(i, 1, float(i), float(i % 5 + 20 * (i > 6))) for i in range(12)], "id long, g int, x double, y double")
    got = windows.best_cut(p, "g", "x")
    assert not runs_to_the_end(plan_of(got))
    assert got.first()["cut"] == 6.0


def test_a_part_is_written_once_not_by_every_task(spark):
    g = spark.range(0, 400, 1, 8).select((F.col("id") % 10).cast("int").alias("part"), "id")
    got = lattice.stored_parts(g, "part")
    assert got.count() == 400
    places = got.select("part", F.input_file_name().alias("file")).distinct().collect()
    assert len(got.inputFiles()) <= 10 and len(places) == 10


def test_chains_come_in_streams(spark):
    g = spark.createDataFrame([(r, c, 1 + (c > r)) for r in range(6) for c in range(6)], "row int, col int, cls int")
    got = polygons.simplified(polygons.boundary_chains(g, "cls"), 0.75)
    assert "flatmapgroupsinpandas" not in plan_of(got)
    assert got.select("chain").distinct().count() == 1 and got.count() >= 2


def test_cells_far_from_all_points_look_at_few(spark, monkeypatch):
    """Points in a small corner of a long grid: cells beyond the first reach find theirs through boxes, not by joining all points of a wide reach."""
    pts = [(i, (i * 7 % 50) / 2.0, (i * 13 % 60) / 2.0) for i in range(120)] + [(500, 3.0, -900.0), (501, 3.0, -900.0)]
    rows = [*range(0, 40), *range(2_000, 2_030), -700, -400]
    cells = [(r, c) for r in rows for c in range(25)]
    joined = []
    monkeypatch.setattr(lattice, "far_nearest", lambda *a, f=getattr(lattice, "far_nearest", None): (joined.append(1), f(*a))[1], raising=False)
    got = {(r["row"], r["col"]): r["id"] for r in lattice.split_by_points(spark.createDataFrame(cells, "row int, col int"), spark.createDataFrame(pts, "id long, x double, y double")).collect()}
    assert len(got) == len(cells) and joined
    for r, c in cells:
        assert got[r, c] == min((round((c + 0.5 - x) ** 2 + (r + 0.5 - y) ** 2, 6), i) for i, x, y in pts)[1]


def test_nearest_looks_at_blocks_not_at_all_pairs(spark):
    a = [(i, i % 3, float(i * 37 % 101), float(i * 11 % 7)) for i in range(60)] + [(99, 8, 0.0, 0.0)]
    b = [(i, i % 2, float(i * 53 % 97), float(i * 29 % 8)) for i in range(300)] + [(400 - i, 1, 5.0, 5.0) for i in range(3)]
    left, right = (spark.createDataFrame(x, "id long, g int, x double, y double") for x in (a, b))
    for reach, size in ((20.0, 16), (None, 40), (1000.0, 7)):
        df = joins.nearest(left, right, "g", reach, size)
        assert "flatmapcogroupsinpandas" in plan_of(df)
        want = {}
        for i, g, x, y in a:
            if d := [(((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, h, u, v in b if h == g]:
                want[i] = (min(d)[1], min(d)[0], sum(e <= (reach or 0.0) for e, _ in d))
        assert {r["id"]: (r["near"], r["dist"], r["n_inside"]) for r in df.collect()} == want


def test_class_grid_and_overlay_are_hashed_not_sorted(spark, tmp_path):
    """Rows of a cell are added up in hash tables; ties go to the first flag, a missing flag comes last, the first layer wins."""
    from rasterloom.sources import tables

    flags = {0: "AAN", 1: "NA", 2: "RRN", 3: "NR", 4: "BBA", 5: "BN", 6: "ZZNN", 7: [None, None, "N", "N"], 8: "5A"}
    rows = [(k * 10, 0, f) for k, v in flags.items() for f in v]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    g = tables.cls(spark, str(tmp_path))
    assert "sortaggregate" not in plan_of(g)
    assert {r["row"]: r["cls"] for r in g.collect()} == {0: 1, 1: 1, 2: 3, 3: 2, 4: 3, 5: 3, 6: 2, 7: 2, 8: 3}
    a, b, base = (spark.createDataFrame(x, "row int, col int, cls int") for x in ([(0, 0, 7), (0, 0, 5), (1, 0, None), (1, 0, 2)], [(0, 0, 1), (2, 0, 4)], [(0, 0, 9), (3, 0, 9)]))
    got = lattice.overlay([a, b], base, "cls")
    assert "sortaggregate" not in plan_of(got)
    assert {tuple(r) for r in got.collect()} == {(0, 0, 5, 1), (1, 0, None, 1), (2, 0, 4, 2), (3, 0, 9, 0)}


def test_radius_pairs_hold_one_side_once(spark):
    """No side is broadcast or sorted, points are repeated five times and not nine, and tasks are as many as shuffles have."""
    import random

    r = random.Random(5)
    pts = [(i, r.randint(-9, 9) / 2, r.randint(-9, 9) / 2) for i in range(150)] + [(200, None, 1.0)]
    df = joins.radius_pairs(spark.createDataFrame(pts, "id long, x double, y double"), 1.5)
    plan = plan_of(df).split("physical plan")[-1]
    assert "shuffledhashjoin" in plan and "broadcasthashjoin" not in plan and "sortmergejoin" not in plan
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = sorted((i, j) for i, x, y in pts for j, u, v in pts if i < j and None not in (x, u) and ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= 1.5)
    assert sorted((q["a"], q["b"]) for q in df.collect()) == want


def test_cells_of_boxes_and_halves_are_dealt(spark):
    from rasterloom.operators import masks

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    z = spark.createDataFrame([(i, i % 3 + 0.0, i + 0.0, i % 3 + 2.5, i + 1.5) for i in range(40)], "zone int, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    c = joins.cells_of_boxes(z)
    assert c.rdd.getNumPartitions() == n
    mid = z.select("zone", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    got = masks.split_by_half_planes(c, mid, "zone")
    assert "broadcasthashjoin" not in plan_of(got).split("physical plan")[-1]
    at = {(r["zone"], r["row"], r["col"]) for r in c.collect()}
    assert {(r["row"], r["col"], r["a"], r["b"]) for r in got.collect()} == {(r, k, a, b) for a, r, k in at for b, r2, k2 in at if a < b and (r, k) == (r2, k2)}
