"""Text and polygon sources, parameter grids, predictor names, resumable parts and item errors."""

from __future__ import annotations

import json
import uuid

import pytest

from rasterloom.functions import codes, indices
from rasterloom.operators import lattice, tuning
from rasterloom.sources import layers, text


@pytest.mark.parametrize(("raw", "want"), [(b"code;name\n1;a,b\n2;c,d\n", ("UTF-8", ";")), ("код,имя\n1,Лес\n".encode("cp1251"), ("windows-1251", ",")), ("﻿code\tname\n1\tÉ\n".encode(), ("UTF-8", "\t")), (b"", ("UTF-8", ","))])
def test_sniffing(spark, tmp_path, raw, want):
    (tmp_path / "t.csv").write_bytes(raw)
    assert text.sniff(spark, str(tmp_path / "t.csv")) == want


def test_names_and_class_maps(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("﻿Code ;Class\n1; Лес \n2;\n2.0;Луг\nx;y\n;z\n".encode())
    assert [tuple(r) for r in text.read_names(spark, str(path)).collect()] == [("1", "Лес"), ("2", None), ("2.0", "Луг"), ("x", "y"), (None, "z")]
    assert {tuple(r) for r in text.read_class_map(spark, str(path)).collect()} == {(1, "Лес"), (2, "Луг")}
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no code"):
        text.read_class_map(spark, str(path))


def test_samples_with_data(spark, tmp_path):
    df = spark.createDataFrame([("oak", 1, 2.0, 3.0, 4), (None, 1, 2.0, 5.0, 6), ("oak", 1, 2.0, None, 4)], "sp string, x int, y double, b1 double, b0 int")
    got = text.samples_with_data(df, "sp", "x", "y", ["b1", "b0"])
    assert got.columns == ["species", "x", "y", "b1", "b0"]
    text.write_samples_with_data(got, str(tmp_path / "swd"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "swd"), header=True, inferSchema=True).collect()} == {("oak", 1.0, 2.0, 3.0, 4.0), ("background", 1.0, 2.0, 5.0, 6.0)}


def test_layers_keep_their_rings(spark, tmp_path):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.5)]
    df = spark.createDataFrame([(1, "a", [{"x": x, "y": y} for x, y in ring]), (2, "b", []), (3, "1", None)], f"id long, kind string, ring {layers.RING}")
    layers.with_wkb(df).write.parquet(str(tmp_path / "zones.parquet"))
    df.select("id").write.parquet(str(tmp_path / "more.parquet"))
    assert {r["layer"] for r in layers.list_layers(spark, str(tmp_path)).collect()} == {"zones", "more"}
    back = {r["id"]: r["rings"] for r in layers.with_rings(layers.read_layer(spark, str(tmp_path / "zones.parquet"))).collect()}
    assert [[(p["x"], p["y"]) for p in r] for r in back[1]] == [ring] and back[2] is None and back[3] is None
    assert [r["id"] for r in layers.read_layer(spark, str(tmp_path / "zones.parquet"), "id", ["1", 3]).orderBy("id").collect()] == [1, 3]
    assert [r["id"] for r in layers.read_layer(spark, str(tmp_path / "zones.parquet"), "kind", [1]).collect()] == [3]
    many = b"\x01\x06\x00\x00\x00\x02\x00\x00\x00" + layers.ring_to_wkb(ring) + layers.ring_to_wkb(ring[::-1])
    assert layers.wkb_to_rings(many) == [ring, ring[::-1]]
    with pytest.raises(ValueError, match="no polygon"):
        layers.wkb_to_rings(b"\x01\x01\x00\x00\x00" + b"\0" * 16)


def test_parameter_grids():
    assert tuning.parameter_grid("nearest") == [{"k": 5, "weights": "uniform"}]
    assert len(tuning.parameter_grid("random_forest", "extended")) == 8 and len(tuning.parameter_grid("elastic_net", "maximal")) == 12
    assert tuning.parameter_grid("nearest", "manual", {"k": (7, 8)}) == [{"k": 7, "weights": "uniform"}, {"k": 8, "weights": "uniform"}]
    with pytest.raises(ValueError, match="has no"):
        tuning.parameter_grid("nearest", "manual", {"q": (1,)})


def test_predictor_names():
    bands = ["NDVI", "slope", "B4"]
    assert tuning.resolve_predictors(bands, ["ndvi", "b4"], json.dumps(["slope"])) == ["NDVI", "B4"]
    assert tuning.resolve_predictors(bands, sidecar=json.dumps({"features": ["slope"]})) == ["slope"]
    assert tuning.resolve_predictors(bands, [], "[]", "# names\nB4\n\nNDVI\n") == ["B4", "NDVI"]
    assert tuning.resolve_predictors(bands, manual=["slope"]) == ["slope"]
    for bad in ({"manual": ["x"]}, {}):
        with pytest.raises(ValueError):
            tuning.resolve_predictors(bands, **bad)


def test_band_names_and_formulas(spark):
    assert indices.parameters(["B02", "B03", "B04", "B8A"]) == {"B": "B02", "G": "B03", "R": "B04", "N": "B8A"}
    assert indices.parameters([f"band{i}" for i in range(10, 19)]) == dict(zip(indices.POSITIONS, [f"band{i}" for i in range(10, 19)]))
    assert indices.parameters(["blue", "nir", "nir2"]) == {"B": "blue"}
    df = spark.createDataFrame([(0.1, 0.2, 0.0), (0.1, 0.0, 0.0)], "b double, n double, r double")
    got = indices.evaluate(df, {"N": "n", "R": "r"}, {"NDVI": indices.FORMULAS["NDVI"], "SR": indices.FORMULAS["SR"], "BNDVI": indices.FORMULAS["BNDVI"]})
    assert [tuple(r)[3:] for r in got.collect()] == [(1.0, None), (None, None)] and "BNDVI" not in got.columns


def test_pairs_and_escapes(spark):
    assert codes.replacement_pairs("4=1; 5=2;4 = 1") == {4: 1, 5: 2}
    with pytest.raises(ValueError, match="is to become"):
        codes.replacement_pairs("4=1; 4=2")
    df = spark.createDataFrame([("a<b & \"c\" > 'd'",)], "t string")
    assert df.select(codes.xml_escape(df["t"])).first()[0] == "a&lt;b &amp; &quot;c&quot; &gt; &apos;d&apos;"


def test_parts_that_are_done_stay(spark):
    from pyspark.sql import functions as F

    name = f"test-parts-{uuid.uuid4().hex}"
    grid = spark.range(40).select(F.col("id").alias("v"), (F.col("id") % 4).cast("int").alias("tile"))
    first = lattice.stored_parts(grid.where("tile < 2"), "tile", name)
    assert first.count() == 20
    again = lattice.stored_parts(grid.withColumn("v", F.col("v") + 1000), "tile", name)
    assert {r["tile"]: r["v"] for r in again.groupBy("tile").agg(F.max("v").alias("v")).collect()} == {0: 36, 1: 37, 2: 1038, 3: 1039}
    assert again.count() == 40


def test_failing_items_are_rows(spark):
    items = spark.createDataFrame([(i,) for i in range(6)], "id long")

    def work(row):
        if row["id"] == 4:
            raise KeyError("broken")
        return [(row["id"] * k, "x") for k in range(2)]

    done, failed = tuning.with_errors(spark, items, "id", work, "v long, t string")
    assert sorted((r["item"], r["v"], r["t"]) for r in done.collect()) == sorted((str(i), i * k, "x") for i in range(6) if i != 4 for k in range(2))
    assert [tuple(r) for r in failed.collect()] == [("4", "KeyError: 'broken'")]


def test_encoding_is_judged_by_the_whole_file(spark, tmp_path):
    """One byte that isn't UTF-8, far behind the start, makes the whole table Windows-1251."""
    from rasterloom.sources.text import read_names, sniff

    path = tmp_path / "late.csv"
    path.write_bytes(b"code;name\n" + b"".join(b"%d;forest\n" % i for i in range(20_000)) + "20000;лес\n".encode("cp1251"))
    assert sniff(spark, str(path)) == ("windows-1251", ";")
    df = read_names(spark, str(path))
    assert df.count() == 20_001 and df.where("code = 20000").first()["name"] == "лес"
    path.write_bytes("﻿code,name\n1,лес\n".encode())
    assert sniff(spark, str(path)) == ("UTF-8", ",") and read_names(spark, str(path)).columns == ["code", "name"]
    (tmp_path / "empty.csv").write_bytes(b"")
    assert sniff(spark, str(tmp_path / "empty.csv"))[0] == "UTF-8"
