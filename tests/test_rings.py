"""Rings are walked in tiles: the same for every tile, and no group holds a long border."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rasterloom.operators import faces, lattice, polygons


def measured(segments, tile):
    pieces = polygons.ring_pieces(segments, tile)
    return polygons.ring_measures(pieces, polygons.joined_pieces(pieces)), pieces


def test_rings_are_the_same_for_every_tile(spark):
    r = random.Random(4)
    rows = [(y, x, r.choice((1, 1, 1, 2))) for y in range(-7, 9) for x in range(13)]
    s = lattice.segments(spark.createDataFrame(rows, "row int, col int, cls int"), "cls").localCheckpoint()
    found = []
    for tile in (5, 512):
        got, _ = measured(s, tile)
        found.append(sorted((k["cls"], k["n"], k["area"], k["inside"]) for k in got.collect()))
    assert found[0] == found[1] and any(k[3] for k in found[0])
    whole = {(k["ring"]): k for k in polygons.rings(s, tile=5).collect()}
    assert sorted((k["cls"], k["n"], k["area"], k["inside"]) for k in whole.values()) == found[0]
    for k in whole.values():
        p = [(q["x"], q["y"]) for q in k["points"]]
        assert len(p) == k["n"] and max(abs(a - c) + abs(b - d) for (a, b), (c, d) in zip(p, p[1:] + p[:1])) <= 1
        assert abs(sum(a * d - c * b for (a, b), (c, d) in zip(p, p[1:] + p[:1]))) / 2 == k["area"]
        inside = 0
        for o in whole.values():
            q = [(v["x"], v["y"]) for v in o["points"]]
            if o["cls"] == k["cls"] and o["area"] > k["area"]:
                (x, y), odd = p[0], False
                for (a, b), (c, d) in zip(q, q[1:] + q[:1]):
                    odd ^= (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a
                inside += odd
        assert inside == k["inside"]
    assert all(len(k["points"]) == 2 * whole[k["ring"]]["n"] for k in polygons.rings(s, 1, 5).collect())


def test_a_long_border_is_several_pieces(spark):
    s = lattice.segments(spark.createDataFrame([(y, x, 1) for y in range(60) for x in range(3)], "row int, col int, cls int"), "cls")
    got, pieces = measured(s, 8)
    assert [(k["n"], k["area"], k["inside"]) for k in got.collect()] == [(126, 179.5, 0)]
    assert max(k["n"] for k in pieces.select("n").collect()) <= 24


def test_chains_are_the_same_for_every_tile(spark):
    """The chains that components() of all sides gives, from tiles; rounds see rims only."""
    r = random.Random(8)
    g = spark.createDataFrame([(y, x, r.choice((1, 1, 2, 3))) for y in range(-5, 8) for x in range(11)], "row int, col int, cls int").localCheckpoint()
    for make in (lambda tile: polygons.boundary_chains(g, "cls", tile), lambda tile: faces.face_chains(g, "cls", tile=tile)[1].select("chain", "left", "right", "first", "last", F.to_json("points").alias("points"))):
        found = [sorted(tuple(k) for k in make(tile).collect()) for tile in (3, 512)]
        assert found[0] == found[1] and found[0]
    sides = [tuple(k) for k in polygons.boundary_chains(g, "cls", 3).select("chain", "left", "right", "x1", "y1", "x2", "y2").collect()]
    at: dict = {}
    for i, (_, a, b, *p) in enumerate(sides):
        for end in (tuple(p[:2]), tuple(p[2:])):
            at.setdefault(end, []).append((i, a, b))
    to = list(range(len(sides)))
    find = lambda i: i if to[i] == i else find(to[i])
    for n in at.values():
        if len(n) == 2 and n[0][1:] == n[1][1:]:
            to[find(n[0][0])] = find(n[1][0])
    assert len({(find(i), k[0]) for i, k in enumerate(sides)}) == len({find(i) for i in range(len(sides))}) == len({k[0] for k in sides})


def test_face_rings_are_the_same_for_every_tile(spark):
    r = random.Random(9)
    g = spark.createDataFrame([(y, x, r.choice((1, 1, 2))) for y in range(12) for x in range(9)], "row int, col int, cls int")
    _, chains = faces.face_chains(g, "cls", tile=4)
    found = [sorted((k["face"], k["hole"], k["area"], sorted(map(tuple, k["points"]))) for k in faces.face_rings(chains, tile).collect()) for tile in (2, 512)]
    assert found[0] == found[1] and sum(k[2] for k in found[0]) == 108
