"""Polygonised class maps against flood fills and even-odd counts."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from rasterloom.operators import faces

FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))
EIGHT = (*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1))


def flood(cells, steps):
    """Connected sets of cells, each by its first."""
    of = {}
    for p in sorted(cells):
        if p not in of:
            of[p], todo = p, [p]
            while todo:
                r, c = todo.pop()
                for q in ((r + a, c + b) for a, b in steps):
                    if q in cells and q not in of and (cells[q] == cells[r, c]):
                        of[q] = p
                        todo.append(q)
    return of


def winding(points, x, y):
    """How often a ring goes round a place; a place on a side counts as right of it."""
    n = 0
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if (y1 > y) != (y2 > y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x + 1e-9:
            n += 1 if y2 < y1 else -1
    return n


def made(seed, size=14, classes=2, gaps=0.06):
    r = random.Random(seed)
    return {(i, j): r.randint(1, classes) for i in range(size) for j in range(size) if r.random() >= gaps}


def frame(spark, cells):
    return spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row int, col int, cls int")


def name(face):
    return (face >> 31, face & ((1 << 31) - 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_faces_without_tolerance_are_the_components(spark, seed):
    cells = made(seed)
    of = flood(cells, FOUR)
    out, chains = faces.polygonise(frame(spark, cells), "cls")
    size = Counter(of.values())
    assert {name(r["face"]): (r["cls"], r["area"], r["n_cells"]) for r in out.collect()} == {p: (cells[p], n, n) for p, n in size.items()}
    rings = defaultdict(list)
    for r in faces.face_rings(chains).collect():
        rings[name(r["face"])].append(r)
        assert r["hole"] == (r["area"] < 0)
    for p, n in size.items():
        # What a face leaves of its box and a rim, in sets that touch at corners too: one is outside, the others are holes.
        own = {q for q, f in of.items() if f == p}
        rest = {(i, j): 0 for i in range(-1, 15) for j in range(-1, 15) if (i, j) not in own}
        assert sum(r["area"] for r in rings[p]) == n
        assert Counter(r["hole"] for r in rings[p]) == Counter({False: 1}) + Counter({True: len(set(flood(rest, EIGHT).values())) - 1})


@pytest.mark.parametrize(("seed", "classes"), [(3, 2), (4, 4)])
def test_simplified_faces_cover_the_grid_once(spark, seed, classes):
    cells = made(seed, classes=classes)
    grid, chains = faces.face_chains(frame(spark, cells), "cls", 0.75)
    areas = {r["face"]: r["area"] for r in faces.face_areas(chains).collect()}
    assert sum(areas.values()) == pytest.approx(len(cells))
    parts = defaultdict(list)
    total = Counter()
    for r in faces.face_rings(chains).collect():
        parts[r["face"]].append([(q["x"], q["y"]) for q in r["points"]])
        total[r["face"]] += r["area"]
    assert all(total[f] == pytest.approx(a) for f, a in areas.items())
    got = {(r["row"], r["col"]): r["face"] for r in faces.faces_of_cells(grid, chains).collect()}
    assert set(got) == set(cells)
    assert min(areas.values()) > 0
    for p in cells:
        round_it = {f: sum(winding(k, p[1] + 0.5, p[0] + 0.5) for k in rings) for f, rings in parts.items()}
        assert sum(round_it.values()) == 1 and got[p] == min(f for f, n in round_it.items() if n > 0)


def test_majority_class_and_empty_grid(spark):
    # The tolerance straightens the border, and the cell that stood out falls to the other face.
    cells = {(r, c): 1 if r < 4 else 2 for r in range(8) for c in range(12)} | {(3, 5): 2}
    out, _ = faces.polygonise(frame(spark, cells), "cls", 1.5)
    assert sorted((r["cls"], r["area"], r["n_cells"]) for r in out.collect()) == [(1, 48.0, 48), (2, 48.0, 48)]
    out, chains = faces.polygonise(frame(spark, cells).limit(0), "cls")
    assert out.count() == 0 and faces.face_rings(chains).count() == 0
