"""A folder of rasters as one table, of which only the files, bands and blocks that a query's filters leave are read.

spark.read.format("rastertable").load(folder) gives (model, year, path, band, x, y, value), a row for each cell and band
that has a value; x and y are the cell's middle. Model and year come from the path below the folder, by the option
`pattern` (groups model and year; null where it doesn't match). Filters on year, model, path and band choose files and
bands, filters on x and y choose strips and tiles; what a block can't decide for all its cells Spark checks again.
Python data sources are not told which columns a query needs, so a row is made whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .geotiff import Header, decoded, read_header

SCHEMA = "model string, year int, path string, band string, x double, y double, value double"
PATTERN = r"(?:model=|suit_)(?P<model>[^/_]+)[/_](?:year=)?(?P<year>(?:19|20)\d\d)"


@dataclass
class Wanted:
    """What the pushed filters leave of a column: a range, and a set if there is one."""

    low: float = -np.inf
    high: float = np.inf
    values: frozenset | None = None

    def holds(self, v) -> bool:
        """An unknown value passes no filter: all of these are false for null."""
        if self.values is None and self.low == -np.inf and self.high == np.inf:
            return True
        return v is not None and (self.values is None or v in self.values) and (isinstance(v, str) or self.low <= v <= self.high)

    def meets(self, low: float, high: float) -> bool:
        return low <= self.high and high >= self.low and (self.values is None or any(low <= v <= high for v in self.values))

    def narrowed(self, f: Filter) -> Wanted | None:
        """With one filter more; None for kinds that aren't understood. An open end is the next number a double can be."""
        if isinstance(f, IsNotNull):
            return self
        if isinstance(f, (EqualTo, In)):
            new = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            return Wanted(self.low, self.high, new if self.values is None else new & self.values)
        number = isinstance(getattr(f, "value", None), (int, float))
        if number and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            low = f.value if isinstance(f, GreaterThanOrEqual) else float(np.nextafter(f.value, np.inf))
            return Wanted(max(self.low, low), self.high, self.values)
        if number and isinstance(f, (LessThan, LessThanOrEqual)):
            high = f.value if isinstance(f, LessThanOrEqual) else float(np.nextafter(f.value, -np.inf))
            return Wanted(self.low, min(self.high, high), self.values)
        return None


@dataclass
class Piece(InputPartition):
    """One strip or tile of a file: where its parts are, and the bands to give."""

    path: str
    model: str | None
    year: int | None
    header: Header
    parts: list
    bands: list[int]


class Reader(DataSourceReader):
    def __init__(self, root: str, pattern: str):
        self.root, self.pattern = root, re.compile(pattern)
        self.want: dict[str, Wanted] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            at = getattr(f, "attribute", ())
            new = self.want.get(at[0], Wanted()).narrowed(f) if len(at) == 1 and at[0] != "value" else None
            if new is not None:
                self.want[at[0]] = new
            yield f  # checked again, since a block may lie across a filter's edge

    def _holds(self, col: str, v) -> bool:
        return self.want.get(col, Wanted()).holds(v)

    def partitions(self) -> list[InputPartition]:
        """Headers are read of the files that are left only."""
        out: list[InputPartition] = []
        for path in sorted(os.path.join(d, n) for d, _, names in os.walk(self.root) for n in names if n.lower().endswith((".tif", ".tiff"))):
            m = self.pattern.search(os.path.relpath(path, self.root))
            model, year = (m["model"], int(m["year"])) if m else (None, None)
            if self._holds("model", model) and self._holds("year", year) and self._holds("path", os.path.relpath(path, self.root)):
                out += self._pieces(path, model, year)
        return out

    def _pieces(self, path: str, model: str | None, year: int | None) -> list[Piece]:
        h = read_header(path)
        bands = [i for i, n in enumerate(h.names) if self._holds("band", n)]
        x0, y0, dx, dy = h.transform()
        at: dict[tuple[int, int], list] = {}
        for b in h.blocks():
            _, _, r, c, bh, bw, band = b
            inside = self.want.get("x", Wanted()).meets(x0 + c * dx, x0 + (c + bw) * dx) and self.want.get("y", Wanted()).meets(y0 - (r + bh) * dy, y0 - r * dy)
            if inside and (band < 0 or band in bands):
                at.setdefault((r, c), []).append(b)
        return [Piece(path, model, year, h, parts, bands) for parts in at.values()] if bands else []

    def read(self, partition: Piece | None) -> Iterator:
        """Spark asks for no partition (None) where none is left."""
        import pyarrow as pa

        if partition is None:
            return
        p = partition
        x0, y0, dx, dy = p.header.transform()
        with open(p.path, "rb") as f:
            for part in p.parts:
                a = decoded(f, p.header, part)
                for band in p.bands if part[6] < 0 else [part[6]]:
                    v = a[:, :, band if part[6] < 0 else 0]
                    r, c = np.nonzero(~np.isnan(v))
                    same = lambda value, kind, n=len(r): pa.array([value] * n, kind)
                    yield pa.RecordBatch.from_arrays(
                        [
                            same(p.model, pa.string()), same(p.year, pa.int32()), same(os.path.relpath(p.path, self.root), pa.string()), same(p.header.names[band], pa.string()),
                            pa.array(x0 + (part[3] + c + 0.5) * dx), pa.array(y0 - (part[2] + r + 0.5) * dy), pa.array(v[r, c]),
                        ],
                        ["model", "year", "path", "band", "x", "y", "value"],
                    )


class RasterTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rastertable"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"].removeprefix("file://").removeprefix("file:"), self.options.get("pattern", PATTERN))


def register(spark) -> None:
    """Registers the format, and lets Spark push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterTable)
