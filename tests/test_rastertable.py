"""A folder of rasters as a table: right rows, and only the files and blocks that filters leave are opened."""

from __future__ import annotations

import os

import pytest

from rasterloom.sources import geotiff, rastertable


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two models by three years, each in three files of ten raster rows, with two bands."""
    root = str(tmp_path_factory.mktemp("rasters"))
    geotiff.register(spark)
    rastertable.register(spark)
    for m in ("dry", "wet"):
        for y in (2020, 2030, 2040):
            g = spark.range(600).selectExpr("CAST(id DIV 20 AS INT) AS row", "CAST(id % 20 AS INT) AS col", f"CASE WHEN id % 7 > 0 THEN id + {y} END AS low", f"{y} - id * {len(m)} + 0.5D AS high")
            g.repartitionByRange(3, "row").sortWithinPartitions("row", "col").write.format("plaintiff").mode("append").save(f"{root}/model={m}/year={y}")
    return root


def table(spark, folder):
    return spark.read.format("rastertable").load(folder)


def test_all_rows(spark, folder):
    df = table(spark, folder)
    assert df.rdd.getNumPartitions() == 18
    n = {(r["model"], r["year"], r["band"]): r["n"] for r in df.groupBy("model", "year", "band").agg({"value": "count"}).withColumnRenamed("count(value)", "n").collect()}
    assert n == {(m, y, b): 600 if b == "high" else 600 - 86 for m in ("dry", "wet") for y in (2020, 2030, 2040) for b in ("low", "high")}
    r = df.where("model = 'wet' AND year = 2030 AND band = 'low' AND x = 3.5 AND y = -12.5").collect()
    assert [x["value"] for x in r] == [12 * 20 + 3 + 2030]


@pytest.mark.parametrize("where,pieces,rows", [
    ("year = 2030", 6, 2 * (600 + 514)),
    ("year > 2020 AND model = 'dry'", 6, 2 * (600 + 514)),
    ("model IN ('wet', 'none') AND band = 'high' AND y > -10", 3, 3 * 200),
    ("band = 'high' AND y BETWEEN -20 AND -10 AND year = 2020", 6, 2 * 200),
    ("band = 'absent'", 0, 0),
    ("model IS NULL", 18, 0),
    ("year = 2030 OR year = 2040", 18, 4 * (600 + 514)),
    ("value > 1e9", 18, 0),
    ("x > 1000", 0, 0),
])
def test_filters_choose_files_and_blocks(spark, folder, where, pieces, rows):
    """A file touches a range that ends on its edge; kinds of filter that aren't understood leave all."""
    df = table(spark, folder).where(where)
    assert df.count() == rows and df.rdd.getNumPartitions() <= max(pieces, 1)


def test_files_without_names_and_broken_files_left_out_by_filters(spark, folder, tmp_path):
    """A file that the filters leave out isn't opened; one whose path says nothing has nulls."""
    plain = next(os.path.join(d, n) for d, _, names in os.walk(folder) for n in names)
    os.makedirs(tmp_path / "model=dry" / "year=1999")
    (tmp_path / "model=dry" / "year=1999" / "x.tif").write_bytes(b"no raster")
    with open(plain, "rb") as f:
        (tmp_path / "plain.tif").write_bytes(f.read())
    df = table(spark, str(tmp_path))
    assert df.where("year = 2000").count() == 0
    got = df.where("path = 'plain.tif'").select("model", "year").distinct().collect()
    assert [tuple(r) for r in got] == [(None, None)]
