"""Rasters as tables: a data source that reads and writes plain GeoTIFF files.

spark.read.format("plaintiff").load(path) gives (row, col, one double column per band); nodata and NaN are null. A
partition is a strip or tile of a file, so one raster is read by many tasks. Reads little- and big-endian classic and
BigTIFF files with integer or float samples, chunky or planar, uncompressed, Deflate or ZSTD, with
predictor 1 or 2. Writing makes one uncompressed, chunky file of 64-bit floats per partition, strip by strip.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, unescape

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

# Fixed values of the file format: sizes and codes of field types, and tag numbers.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, METADATA, NODATA = 33550, 33922, 42112, 42113

#: Raster rows to a strip that is written.
STRIP_ROWS = 16


@dataclass
class Header:
    order: str
    tags: dict[int, tuple] = field(default_factory=dict)

    def one(self, tag: int, default: int = 0) -> int:
        return self.tags.get(tag, (default,))[0]

    @property
    def bands(self) -> int:
        return self.one(BANDS, 1)

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f"}[self.one(FORMAT, 1)]
        return np.dtype(f"{self.order}{kind}{self.one(BITS, 8) // 8}")

    @property
    def nodata(self) -> float | None:
        raw = self.tags.get(NODATA)
        return float(raw[0].rstrip("\0 ")) if raw and raw[0].strip("\0 ") else None

    @property
    def names(self) -> list[str]:
        """Band descriptions where the file has them, else band1 and so on; repeats in any case get _2, _3."""
        import re

        from ..operators.predicates import unique_names

        found = dict(re.findall(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)</Item>', self.tags.get(METADATA, ("",))[0]))
        return unique_names([unescape(found.get(str(i), "")) or f"band{i + 1}" for i in range(self.bands)])

    def transform(self) -> tuple[float, float, float, float]:
        """x0, y0, pixel width and height."""
        s, t = self.tags.get(SCALE, (1.0, 1.0, 0.0)), self.tags.get(TIEPOINT, (0.0,) * 6)
        return t[3] - t[0] * s[0], t[4] + t[1] * s[1], s[0], s[1]

    def blocks(self) -> list[tuple[int, int, int, int, int, int, int]]:
        """(offset, bytes, row, col, height, width, band or -1) of each strip or tile."""
        w, h = self.one(WIDTH), self.one(HEIGHT)
        tiled = TILES in self.tags
        bw, bh = (self.one(TILE_W), self.one(TILE_H)) if tiled else (w, min(self.one(ROWS, h), h))
        across, down = -(-w // bw), -(-h // bh)
        out = []
        for i, (at, n) in enumerate(zip(self.tags[TILES if tiled else STRIPS], self.tags[TILE_BYTES if tiled else STRIP_BYTES])):
            band, k = divmod(i, across * down)
            r, c = divmod(k, across)
            out.append((at, n, r * bh, c * bw, bh if tiled else min(bh, h - r * bh), bw, band if self.one(PLANAR, 1) == 2 else -1))
        return out


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}[head[:2]]
        big = struct.unpack(f"{order}H", head[2:4])[0] == 43
        at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
        f.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        size, out = (20, Header(order)) if big else (12, Header(order))
        entries = f.read(n * size)
        for i in range(n):
            e = entries[i * size : (i + 1) * size]
            tag, kind = struct.unpack(f"{order}HH", e[:4])
            if kind not in TYPES:
                continue
            count = struct.unpack(order + ("Q" if big else "I"), e[4 : 12 if big else 8])[0]
            code = TYPES[kind]
            fmt = f"{order}{count}s" if code == "s" else f"{order}{count * len(code)}{code[0]}"
            value, room = e[12:] if big else e[8:], 8 if big else 4
            if struct.calcsize(fmt) > room:
                f.seek(struct.unpack(order + ("Q" if big else "I"), value)[0])
                value = f.read(struct.calcsize(fmt))
            got = struct.unpack(fmt, value[: struct.calcsize(fmt)])
            out.tags[tag] = (got[0].decode("utf-8", "replace"),) if code == "s" else got
    return out


def unpacked(raw: bytes, compression: int) -> bytes:
    if compression in (8, 32946):
        return zlib.decompress(raw)
    if compression == 50000:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(raw)
    if compression != 1:
        raise ValueError(f"compression {compression} isn't supported")
    return raw


def decoded(f, h: Header, part: tuple) -> np.ndarray:
    """A strip or tile as doubles by (row, col, band), cut to the raster; nodata is NaN."""
    at, n, row, col, bh, bw, band = part
    f.seek(at)
    depth = h.bands if band < 0 else 1
    a = np.frombuffer(unpacked(f.read(n), h.one(COMPRESSION, 1)), h.dtype)
    a = a.reshape(len(a) // (bw * depth), bw, depth)
    if h.one(PREDICTOR, 1) == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype)
    a = a[: min(len(a), h.one(HEIGHT) - row), : min(bw, h.one(WIDTH) - col)].astype(np.float64)
    if h.nodata is not None:
        a[a == h.nodata] = np.nan
    return a


@dataclass
class Block(InputPartition):
    path: str
    parts: list
    header: Header


class Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            h = read_header(path)
            at: dict[tuple[int, int], list] = {}
            for b in h.blocks():
                at.setdefault((b[2], b[3]), []).append(b)
            out += [Block(path, parts, h) for parts in at.values()]
        return out

    def read(self, partition: Block) -> Iterator:
        import pyarrow as pa

        h, rows, data = partition.header, None, []
        with open(partition.path, "rb") as f:
            for part in partition.parts:
                a = decoded(f, h, part)
                rows = rows or (part[2], part[3], a.shape[0], a.shape[1])
                data += [a[:, :, i].ravel() for i in range(a.shape[2])]
        r, c, bh, bw = rows
        cells = [np.repeat(np.arange(r, r + bh, dtype=np.int32), bw), np.tile(np.arange(c, c + bw, dtype=np.int32), bh)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cells), *(pa.array(x, from_pandas=True) for x in data)], ["row", "col", *h.names])


@dataclass
class Written(WriterCommitMessage):
    """A finished file that isn't published yet, and its name to be; both empty for a task without rows."""

    held: str
    name: str


class Spool:
    """Rows (row, col, bands..) in any order, kept in a file by strips of rows, so memory holds one buffer and one strip."""

    def __init__(self, path: str, bands: int, buffer: int = 65_536):
        self.f, self.bands, self.buffer = open(path, "w+b"), bands, buffer
        self.at: dict[int, list[tuple[int, int]]] = {}
        self.low, self.high = np.full(2, np.iinfo(np.int64).max), np.full(2, np.iinfo(np.int64).min)

    def fill(self, rows: Iterator) -> None:
        while part := list(itertools.islice(rows, self.buffer)):
            cells = np.array([r[:2] for r in part], dtype=np.int64)
            values = np.array([[np.nan if v is None else v for v in r[2:]] for r in part], dtype="<f8").reshape(len(part), self.bands)
            self.low, self.high = np.minimum(self.low, cells.min(0)), np.maximum(self.high, cells.max(0))
            strip = cells[:, 0] // STRIP_ROWS
            order = np.argsort(strip, kind="stable")
            for rows_of in np.split(order, np.flatnonzero(np.diff(strip[order])) + 1):
                self.at.setdefault(int(strip[rows_of[0]]), []).append((self.f.seek(0, os.SEEK_END), len(rows_of)))
                self.f.write(cells[rows_of].astype("<i8").tobytes() + values[rows_of].tobytes())

    def strips(self, nodata: float) -> Iterator[np.ndarray]:
        """From the first row on, at most STRIP_ROWS rows each, by (row, col, band); a cell given twice has its last values."""
        r0, c0, r1, width = *map(int, self.low), int(self.high[0]), int(self.high[1] - self.low[1]) + 1
        for first in range(r0, r1 + 1, STRIP_ROWS):
            last = min(first + STRIP_ROWS - 1, r1)
            a = np.full((last - first + 1, width, self.bands), nodata, dtype="<f8")
            for k in range(first // STRIP_ROWS, last // STRIP_ROWS + 1):
                for at, n in self.at.get(k, ()):
                    self.f.seek(at)
                    cells = np.frombuffer(self.f.read(n * 16), "<i8").reshape(n, 2)
                    values = np.frombuffer(self.f.read(n * 8 * self.bands), "<f8").reshape(n, self.bands)
                    own = (cells[:, 0] >= first) & (cells[:, 0] <= last)
                    a[cells[own, 0] - first, cells[own, 1] - c0] = np.where(np.isnan(values[own]), nodata, values[own])
            yield a


def encode(spool: Spool, out, names: list[str], x0: float, y0: float, size: float, nodata: float = -9999.0, big: bool | None = None) -> None:
    """Writes a spool's rows to the file `out`, strip by strip; with 64-bit offsets where the file may pass 4 GiB, or if big."""
    (r0, c0), (h, w), k = map(int, spool.low), map(int, spool.high - spool.low + 1), len(names)
    n = -(-h // STRIP_ROWS)
    big = big if big is not None else h * w * k * 8 + 64 * n + (1 << 20) >= 1 << 32
    out.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0) if big else b"II" + struct.pack("<HI", 42, 0))
    at, sizes = [], []
    for a in spool.strips(nodata):
        at.append(out.tell())
        sizes.append(out.write(a.tobytes()))
    meta = "<GDALMetadata>" + "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(name)}</Item>' for i, name in enumerate(names)) + "</GDALMetadata>\0"
    place = "Q" if big else "I"
    fields = [(WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [64] * k), (COMPRESSION, "H", [1]), (262, "H", [1]), (STRIPS, place, at), (BANDS, "H", [k]), (ROWS, "I", [STRIP_ROWS]), (STRIP_BYTES, place, sizes), (PLANAR, "H", [1]), (FORMAT, "H", [3] * k),
              (SCALE, "d", [size, size, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, x0 + c0 * size, y0 - r0 * size, 0.0]), (METADATA, "s", meta.encode()), (NODATA, "s", f"{nodata}\0".encode())]
    start, more, entries = out.tell(), b"", b""
    room, after = (8, start + 8 + 20 * len(fields) + 8) if big else (4, start + 2 + 12 * len(fields) + 4)
    for tag, code, v in fields:
        raw = v if code == "s" else struct.pack(f"<{len(v)}{code}", *v)
        kind = {"I": 4, "H": 3, "d": 12, "s": 2, "Q": 16}[code]
        if len(raw) <= room:
            value = raw.ljust(room, b"\0")
        else:
            value, more = struct.pack("<" + place, after + len(more)), more + raw
        entries += struct.pack("<HH" + place, tag, kind, len(v)) + value
    out.write(struct.pack("<Q" if big else "<H", len(fields)) + entries + b"\0" * room + more)
    out.seek(8 if big else 4)
    out.write(struct.pack("<" + place, start))


class Writer(DataSourceWriter):
    """Each task writes its file under a hidden name; files are published when all tasks are done, and taken away if one fails for good."""

    def __init__(self, path: str, schema: StructType, options: dict):
        self.path, self.names, self.run = path, [f.name for f in schema][2:], uuid.uuid4().hex
        self.x0, self.y0, self.size = (float(options.get(k, d)) for k, d in (("x0", 0), ("y0", 0), ("size", 1)))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        held = f"{self.path}/.{self.run}-{task.taskAttemptId()}"
        spool = Spool(f"{held}.spool", len(self.names))
        try:
            spool.fill(iter(rows))
            if not spool.at:
                return Written("", "")
            with open(held, "wb") as f:
                encode(spool, f, self.names, self.x0, self.y0, self.size)
        except BaseException:
            if os.path.exists(held):
                os.remove(held)
            raise
        finally:
            spool.f.close()
            os.remove(f"{held}.spool")
        return Written(held, f"{self.path}/part-{task.partitionId():05d}.tif")

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.held:
                os.replace(m.held, m.name)
        self._sweep()

    def abort(self, messages: list) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Takes away what this run's tasks, repeated ones too, have left under hidden names."""
        for x in os.listdir(self.path) if os.path.isdir(self.path) else ():
            if x.startswith(f".{self.run}-"):
                os.remove(os.path.join(self.path, x))


class PlainTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plaintiff"

    def paths(self) -> list[str]:
        p = self.options["path"].removeprefix("file://")
        return sorted(os.path.join(p, x) for x in os.listdir(p) if x.endswith((".tif", ".tiff"))) if os.path.isdir(p) else [p]

    def schema(self) -> StructType:
        names = read_header(self.paths()[0]).names
        return StructType([StructField("row", IntegerType()), StructField("col", IntegerType()), *(StructField(n, DoubleType()) for n in names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.paths())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"].removeprefix("file://"), schema, self.options)


def register(spark) -> None:
    spark.dataSource.register(PlainTiff)
