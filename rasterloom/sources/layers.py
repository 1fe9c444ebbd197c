"""Polygon layers: tables of attributes with rings as well-known binary."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

RING = "array<struct<x:double,y:double>>"


def ring_to_wkb(points: list[tuple[float, float]]) -> bytes:
    """A polygon of one ring, closed if it isn't; little-endian."""
    ring = points if points and points[0] == points[-1] else [*points, *points[:1]]
    return struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)


def wkb_to_rings(raw: bytes) -> list[list[tuple[float, float]]]:
    """The rings of a polygon or of a multipolygon's parts, without their last, repeated points."""
    rings: list[list[tuple[float, float]]] = []

    def geometry(at: int) -> int:
        order = "<" if raw[at] == 1 else ">"
        kind, n = struct.unpack_from(order + "II", raw, at + 1)
        at += 9
        if kind % 1000 == 6:
            for _ in range(n):
                at = geometry(at)
            return at
        if kind % 1000 != 3:
            raise ValueError(f"geometry of kind {kind} is no polygon")
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", raw, at)
            flat = struct.unpack_from(order + f"{2 * m}d", raw, at + 4)
            rings.append(list(zip(flat[::2], flat[1::2]))[:-1])
            at += 4 + 16 * m
        return at

    if raw:
        geometry(0)
    return rings


def _schema(df: DataFrame, keep: list[str], more: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), more])


def with_wkb(df: DataFrame, ring: str = "ring", to: str = "geometry") -> DataFrame:
    """Replaces a ring column by its well-known binary; null and empty rings are null."""
    keep = [c for c in df.columns if c != ring]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = batch.column(ring).to_pylist()
            made = pa.array([ring_to_wkb([(p["x"], p["y"]) for p in r]) if r else None for r in rings], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], [*keep, to])

    ship(df.sparkSession)
    return df.mapInArrow(run, _schema(df, keep, f"{to} binary"))


def with_rings(df: DataFrame, geometry: str = "geometry", to: str = "rings") -> DataFrame:
    """Replaces well-known binary by an array of rings."""
    keep = [c for c in df.columns if c != geometry]
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = [None if g is None else [[{"x": x, "y": y} for x, y in r] for r in wkb_to_rings(g)] for g in batch.column(geometry).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rings, kind)], [*keep, to])

    ship(df.sparkSession)
    return df.mapInArrow(run, _schema(df, keep, f"{to} array<{RING}>"))


def list_layers(spark: SparkSession, root: str) -> DataFrame:
    """(layer, files, bytes): the layers below a folder, one Parquet folder or file each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+?)(?:\.parquet)?(?:/part-[^/]*)?$", 1)
    return files.groupBy(name.alias("layer")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def read_layer(spark: SparkSession, path: str, field: str | None = None, values: list[object] | None = None) -> DataFrame:
    """A layer, or its rows whose field is one of values, compared as text; the filter on a text field reaches the scan."""
    df = spark.read.parquet(path)
    if field is None:
        return df
    column: Column = F.col(f"`{field}`")
    text = dict(df.dtypes)[field] == "string"
    return df.where((column if text else column.cast("string")).isin([str(v) for v in values or []]))
