"""Rasters through files and back."""

from __future__ import annotations

import io
import os
import struct
import zlib

import numpy as np
import pytest

from rasterloom.sources import geotiff, tables


def test_round_trip(spark, sf, tmp_path):
    geotiff.register(spark)
    g = tables.sar(spark, sf).select("row", "col", "hh", "hv").coalesce(1)
    out = str(tmp_path / "out")
    g.write.format("plaintiff").mode("append").option("x0", "10").option("y0", "50").option("size", "2").save(out)
    back = spark.read.format("plaintiff").load(out)
    assert back.columns == ["row", "col", "hh", "hv"]
    want = {(r["row"], r["col"]): (r["hh"], r["hv"]) for r in g.collect()}
    got = {(r["row"], r["col"]): (r["hh"], r["hv"]) for r in back.where("hh IS NOT NULL").collect()}
    assert got == want
    assert geotiff.read_header(geotiff.PlainTiff({"path": out}).paths()[0]).transform() == (10.0, 50.0, 2.0, 2.0)


def test_tiles_deflate_predictor_and_nodata(spark, tmp_path):
    geotiff.register(spark)
    a = np.arange(30 * 20).reshape(30, 20).astype(">i2")
    a[3, 4] = -9999
    tiles = []
    for r in (0, 16):
        for c in (0, 16):
            t = np.zeros((16, 16), ">i2")
            part = a[r : r + 16, c : c + 16]
            t[: part.shape[0], : part.shape[1]] = part
            d = t.copy()
            d[:, 1:] = t[:, 1:] - t[:, :-1]
            tiles.append(zlib.compress(d.tobytes()))
    at, body = [], b""
    for t in tiles:
        at.append(8 + len(body))
        body += t
    n = len(tiles)
    fields = [(256, 3, [20]), (257, 3, [30]), (258, 3, [16]), (259, 3, [8]), (277, 3, [1]), (317, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, at), (325, 4, [len(t) for t in tiles]), (339, 3, [2]), (42113, 2, b"-9999\0")]
    start = 8 + len(body)
    extra, entries, where = b"", b"", start + 2 + 12 * len(fields) + 4
    for tag, kind, v in fields:
        raw = v if kind == 2 else struct.pack(f">{len(v)}{'HI'[kind - 3]}", *v)
        if len(raw) <= 4:
            value = raw.ljust(4, b"\0")
        else:
            value, extra = struct.pack(">I", where + len(extra)), extra + raw
        entries += struct.pack(">HHI", tag, kind, len(v)) + value
    (tmp_path / "x.tif").write_bytes(b"MM\0*" + struct.pack(">I", start) + body + struct.pack(">H", len(fields)) + entries + b"\0" * 4 + extra)
    df = spark.read.format("plaintiff").load(str(tmp_path / "x.tif"))
    assert df.rdd.getNumPartitions() == n
    got = {(r["row"], r["col"]): r["band1"] for r in df.collect()}
    assert len(got) == 600 and got[3, 4] is None and got[29, 19] == 599.0 and got[17, 2] == 342.0


def test_unsorted_rows_in_strips_small_and_big(spark, tmp_path):
    """Rows in any order, negative rows, gaps, nulls and band names with markup, with 32- and 64-bit offsets."""
    geotiff.register(spark)
    rng = np.random.default_rng(4)
    cells = [(int(r), int(c)) for r in range(-20, 40) for c in range(3, 10) if (r + c) % 5]
    rows = [(*cells[i], float(i), None if i % 3 == 0 else i / 7) for i in rng.permutation(len(cells))]
    for big in (False, True):
        spool = geotiff.Spool(str(tmp_path / f"spool{big}"), 2, buffer=50)
        spool.fill(iter(rows))
        out = io.BytesIO()
        geotiff.encode(spool, out, ["a & <b>", "c"], 5.0, 9.0, 2.0, big=big)
        (tmp_path / f"x{big}.tif").write_bytes(out.getvalue())
        df = spark.read.format("plaintiff").load(str(tmp_path / f"x{big}.tif"))
        assert df.columns == ["row", "col", "a & <b>", "c"] and df.rdd.getNumPartitions() == 4
        got = {tuple(r)[:2]: tuple(r)[2:] for r in df.collect()}
        want = {(r + 20, c - 3): (a, b) for r, c, a, b in rows}
        assert {k: v for k, v in got.items() if v[0] is not None} == want and len(got) == 60 * 7
        assert geotiff.read_header(str(tmp_path / f"x{big}.tif")).transform() == (11.0, 49.0, 2.0, 2.0)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    geotiff.register(spark)
    out = str(tmp_path / "out")
    bad = spark.range(4000).repartition(4).selectExpr("CAST(id AS INT) AS row", "0 AS col", "IF(id = 3999, CAST(raise_error('late') AS DOUBLE), id * 1.0D) AS v")
    with pytest.raises(Exception, match="late"):
        bad.write.format("plaintiff").mode("append").save(out)
    assert not os.path.isdir(out) or os.listdir(out) == []
    bad.where("row < 3000").write.format("plaintiff").mode("append").save(out)
    assert sorted(os.listdir(out)) == [f"part-0000{i}.tif" for i in range(4)]
