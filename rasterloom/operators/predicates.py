"""Projections, filters and masks over pixels, samples and points."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that are never predictors.
SERVICE = ("class_name", "polygon_id", "n_pixels", "x", "y", "row", "col", "id", "pa", "fold")
#: The names that longitude and latitude columns go by.
LON = ("lon", "long", "longitude", "x", "decimallongitude", "lng")
LAT = ("lat", "latitude", "y", "decimallatitude")


def predictors(df: DataFrame, service: Iterable[str] = SERVICE) -> list[str]:
    """Numeric columns that aren't service columns."""
    skip = {s.lower() for s in service}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name.lower() not in skip]


def usable(c: Column, nodata: float | None = None) -> Column:
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return ok if nodata is None else ok & (c != nodata)


def all_valid(df: DataFrame, cols: Iterable[str], nodata: float | None = None) -> DataFrame:
    return df.where(reduce(Column.__and__, [usable(F.col(c), nodata) for c in cols]))


def any_valid(df: DataFrame, cols: Iterable[str], nodata: float | None = None) -> DataFrame:
    return df.where(reduce(Column.__or__, [usable(F.col(c), nodata) for c in cols]))


def in_bounds(df: DataFrame, height: int, width: int) -> DataFrame:
    return df.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def split_by_bbox(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float] = (-180.0, -85.0, 180.0, 85.0)) -> DataFrame:
    """Adds status: 'ok' or why a point is rejected; one relation holds good and rejected rows."""
    x, y = F.col(lon), F.col(lat)
    inside = x.between(box[0], box[2]) & y.between(box[1], box[3])
    return df.withColumn("status", F.when(x.isNull() | y.isNull(), "not a number").when(inside, "ok").otherwise("outside"))


def number(c: Column) -> Column:
    """Text with a decimal point or comma as double; null if it is none."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def is_in_text(c: Column, values: Iterable[object]) -> Column:
    """Compares as trimmed text, whatever the column's type."""
    return F.trim(c.cast("string")).isin([str(v).strip() for v in values])


def as_type_of(df: DataFrame, col: str, literal: object) -> Column:
    return F.lit(literal).cast(df.schema[col].dataType)


def binarise(c: Column, threshold: float | Column, nodata: int = 255) -> Column:
    return F.when(c.isNull(), nodata).when(c >= threshold, 1).otherwise(0)


def alias_of(columns: Iterable[str], aliases: Iterable[str]) -> str | None:
    """The first column, in the order of the aliases, that goes by one of them in any case."""
    have = {c.lower().strip(): c for c in columns}
    return next((have[a] for a in aliases if a in have), None)


def with_lon_lat(df: DataFrame) -> DataFrame:
    """Renames a table's coordinate columns, by their aliases, to lon and lat."""
    lon, lat = alias_of(df.columns, LON), alias_of(df.columns, LAT)
    if lon is None or lat is None:
        raise ValueError(f"no longitude or latitude among {df.columns}")
    return df.select(F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), *[c for c in df.columns if c not in (lon, lat)])


def unique_names(names: Iterable[str]) -> list[str]:
    """Renames what differs in case only: the later ones get _2, _3 and so on."""
    seen: set[str] = set()
    out = []
    for name in names:
        new, k = name, 2
        while new.lower() in seen:
            new, k = f"{name}_{k}", k + 1
        seen.add(new.lower())
        out.append(new)
    return out


def selection(text: str) -> list[int]:
    """'1,3,5-7' as numbers, each once, in order of appearance."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, _, b = part.partition("-")
        out += [i for i in range(int(a), int(b or a) + 1) if i not in out]
    return out


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule for a fixed ring."""
    crossings = []
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 != y2:
            crossings.append(F.when(((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0))
    return reduce(Column.__add__, crossings, F.lit(0)) % 2 == 1


def crop_to(df: DataFrame, other: DataFrame, pad: int = 0) -> DataFrame:
    """The rows of df inside the footprint of other, grown by pad cells."""
    box = other.agg(*[f(c).alias(f"_{f.__name__}_{c}") for f in (F.min, F.max) for c in ("row", "col")])
    inside = [F.col(c).between(F.col(f"_min_{c}") - pad, F.col(f"_max_{c}") + pad) for c in ("row", "col")]
    return df.crossJoin(F.broadcast(box)).where(inside[0] & inside[1]).select(*df.columns)
