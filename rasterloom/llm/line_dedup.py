"""Line deduplication through a sharded minimal perfect hash.

Every distinct line is known by a 128-bit hash. The hashes of lines found in enough documents are dealt to shards of
about 65,536; each shard gets a minimal perfect hash (levels of bit arrays, ranked), which indexes an array of
fingerprints (the whole second half of the hash, so that a hit is exact) and an array of counts. Documents probe the
arrays; no line is joined with another.

The shards of the most frequent lines, up to a size bound, are broadcast. If there are more, probes for the rest are
routed to their shards, each of which is loaded once; what they find returns to the documents by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_keys, ship, stored, table

STRIP = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 65_536
#: Broadcast bound: so many lines, 12 bytes and some bits each (under 16 MB).
BROADCAST_KEYS = 1 << 20
LEVELS = 24
_M = np.uint64(0xFF51AFD7ED558CCD)


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()  # bytes.lower() changes A-Z only


def line_hashes(text: bytes, min_chars: int) -> np.ndarray:
    """(n, 2) int64: a hash of each line's key; zeros where the key has fewer than min_chars code points."""
    keys = [line_key(x) for x in text.split(b"\n")]
    raw = b"".join([xxhash.xxh3_128_digest(k) if _long_enough(k, min_chars) else b"\0" * 16 for k in keys])
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def _long_enough(key: bytes, n: int) -> bool:
    return n <= 0 or len(key) >= n and (n == 1 or len(key) >= 4 * n or len(key.decode("utf-8", "replace")) >= n)


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * _M
    x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Keys (distinct 64-bit numbers) to 0..n-1. At each level, keys that are alone in their slot stay there."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of bools
        self.ranks = [np.cumsum(x) - x for x in levels]
        self.starts = np.cumsum([0, *(int(x.sum()) for x in levels)])

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """Also the keys that no level took (none but in a very unlikely case); they come last, sorted."""
        levels, rest = [], keys
        while len(rest) and len(levels) < LEVELS:
            at = _slot(rest, len(levels), size := max(64, len(rest) * 5 // 4))
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels), np.sort(rest)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, for a key that wasn't built in, any index or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = _slot(keys[left], i, len(bits))
            hit = bits[at]
            out[left[hit]] = self.starts[i] + self.ranks[i][at[hit]]
            left = left[~hit]
        return out


class Shard:
    """One shard's perfect hash, fingerprints and counts, to and from bytes."""

    def __init__(self, hashed: PerfectHash, rest: np.ndarray, prints: np.ndarray, counts: np.ndarray, more: np.ndarray | None = None):
        """more: (h1, h2, n) of lines that share the first half of their hash with one that is indexed."""
        self.hashed, self.rest, self.prints, self.counts = hashed, rest, prints, counts
        self.more = np.zeros((0, 3), np.int64) if more is None else more

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> Shard:
        first = np.zeros(len(h1), bool)
        first[np.unique(h1, return_index=True)[1]] = True
        more = np.stack([h1, h2, n], axis=1)[~first].astype(np.int64)
        h1, h2, n = np.ascontiguousarray(h1[first]), h2[first], n[first]
        hashed, rest = PerfectHash.build(h1.view(np.uint64))
        out = cls(hashed, rest, np.zeros(len(h1), np.int64), np.zeros(len(h1), np.uint32), more)
        at = out.index(h1)
        out.prints[at], out.counts[at] = h2, np.minimum(n, 2**32 - 1)
        return out

    def index(self, h1: np.ndarray) -> np.ndarray:
        keys = h1.view(np.uint64)
        at = self.hashed.find(keys)
        if len(self.rest):
            lost = np.flatnonzero(at < 0)
            place = np.minimum(np.searchsorted(self.rest, keys[lost]), len(self.rest) - 1)
            same = self.rest[place] == keys[lost]
            at[lost[same]] = self.hashed.starts[-1] + place[same]
        return at

    def count(self, h: np.ndarray) -> np.ndarray:
        """In how many documents the lines with hashes h (n, 2) are; 0 if the shard doesn't have them."""
        at = self.index(np.ascontiguousarray(h[:, 0]))
        found = (at >= 0) & (len(self.prints) > 0)
        found[found] = self.prints[at[found]] == h[found, 1]
        out = np.zeros(len(h), np.int64)
        out[found] = self.counts[at[found]]
        for h1, h2, n in self.more:  # next to none: lines that agree in 64 of 128 bits
            out[(h[:, 0] == h1) & (h[:, 1] == h2)] = n
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.prints), len(self.rest), len(self.more), len(self.hashed.levels), *map(len, self.hashed.levels)], "<i8")
        return b"".join([len(head).to_bytes(4, "little"), head.tobytes(), self.more.astype("<i8").tobytes(), self.rest.tobytes(), self.prints.tobytes(), self.counts.tobytes(), *(np.packbits(x).tobytes() for x in self.hashed.levels)])

    @classmethod
    def unpack(cls, raw: bytes) -> Shard:
        head, at = np.frombuffer(raw, "<i8", int.from_bytes(raw[:4], "little"), 4), 4 + 8 * int.from_bytes(raw[:4], "little")
        n, rest, extra = map(int, head[:3])
        more = np.frombuffer(raw, "<i8", 3 * extra, at).reshape(-1, 3)
        at += more.nbytes
        parts = []
        for kind, k in (("<u8", rest), ("<i8", n), ("<u4", n)):
            parts.append(np.frombuffer(raw, kind, k, at))
            at += parts[-1].nbytes
        levels = []
        for size in map(int, head[4:]):
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at))[:size].astype(bool))
            at += (size + 7) // 8
        return cls(PerfectHash(levels), parts[0], parts[1], parts[2], more)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column("text"):
        yield (x.as_py() or "").encode()


def line_counts(docs: DataFrame, min_docs: int, min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): the hashes of keys that are in at least min_docs rows. Each row counts a key once."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [h for t in _texts(batch) if len(h := np.unique(line_hashes(t, min_chars), axis=0))]
            if got:
                h = np.concatenate(got)
                h = h[(h != 0).any(axis=1)]
                pairs, n = np.unique(h, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], ["h1", "h2", "n"])

    seen = docs.select("text").mapInArrow(hashes, "h1 long, h2 long, n long")
    return seen.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)


def build_index(counts: DataFrame, keys: int, per_shard: int = SHARD_KEYS) -> DataFrame:
    """(shard, shards, packed): the sharded index of counts(h1, h2, n), which has so many keys."""
    shards = max(1, -(-keys // per_shard))

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["h1", "h2"])
        packed = Shard.build(pdf.h1.to_numpy(np.int64), pdf.h2.to_numpy(np.int64), pdf.n.to_numpy()).pack()
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "shards": [shards], "packed": [packed]})

    return counts.withColumn("shard", F.pmod(F.col("h2"), F.lit(shards))).groupBy("shard").applyInPandas(build, "shard long, shards long, packed binary")


def load(rows) -> tuple[int, dict[int, Shard]]:
    rows = list(rows)
    return (rows[0]["shards"] if rows else 1), {r["shard"]: Shard.unpack(bytes(r["packed"])) for r in rows}


def probe(index: tuple[int, dict[int, Shard]], h: np.ndarray) -> np.ndarray:
    """The counts of hashes h; 0 where the index has none."""
    shards, held = index
    out, to = np.zeros(len(h), np.int64), np.mod(h[:, 1], shards)
    for s in np.unique(to):
        if s in held:
            out[at] = held[s].count(h[at := np.flatnonzero(to == s)])  # noqa: F821
    return out


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_keys: int = BROADCAST_KEYS, per_shard: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): the texts without the lines whose key is in at least min_docs rows.

    A null or empty text is one empty line. Keys of fewer than min_chars code points always stay. Each row is a
    document, also where doc_id repeats or is null. If all lines go, kept is empty. A line goes or stays by its own count,
    so there are no ties; a very long text is in memory one at a time. Other columns are ignored; an empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    counts = stored(line_counts(docs, min_docs, min_chars), "lines")
    total = counts.count()
    if total <= broadcast_keys:
        near, far = counts, None
    else:
        least = counts.orderBy(F.desc("n"), "h1", "h2").limit(broadcast_keys).agg(F.min("n")).first()[0]
        near, far = counts.where(F.col("n") > least), counts.where(F.col("n") <= least)
    held = spark.sparkContext.broadcast([r.asDict() for r in build_index(near, min(total, broadcast_keys), per_shard).collect()])
    found = None if far is None else _probe_far(docs, build_index(far, total, per_shard), held, min_chars)
    rows = docs.select("doc_id", "text") if found is None else _with_found(docs, found)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = load(held.value)
        for batch in batches:
            out = []
            more = batch.column("found") if "found" in batch.schema.names else None
            for i, text in enumerate(_texts(batch)):
                h = line_hashes(text, min_chars)
                gone = probe(index, h) > 0
                if more is not None and more[i].is_valid:
                    others = {(x["h1"], x["h2"]) for x in more[i].as_py()}
                    gone |= np.array([(a, b) in others for a, b in h.tolist()], bool) & (h != 0).any(axis=1)
                lines = text.split(b"\n")
                out.append((len(lines), int(gone.sum()), b"\n".join([x for x, g in zip(lines, gone) if not g]).decode()))
            n, d, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(drop, f"doc_id {kind}, n_lines long, n_dropped long, kept string")


def _probe_far(docs: DataFrame, index: DataFrame, held, min_chars: int) -> DataFrame:
    """(k1, k2, found): for each row key the hashes of its lines that the far shards hold. No line asks that is in the near ones, so no key asks more often than the rarest of those."""
    shards = index.select("shards").first()
    shards = shards[0] if shards else 1

    def ask(batches):
        near = load(held.value)
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            cols = [[], [], [], []]
            for i, text in enumerate(_texts(batch)):
                h = np.unique(line_hashes(text, min_chars), axis=0)
                h = h[(h != 0).any(axis=1)]
                h = h[probe(near, h) == 0]
                for c, v in zip(cols, (np.full(len(h), k1[i]), np.full(len(h), k2[i]), h[:, 0], h[:, 1])):
                    c.append(v)
            if cols[0]:
                a, b, c, d = map(np.concatenate, cols)
                yield pa.RecordBatch.from_arrays([pa.array(np.mod(d, shards)), *map(pa.array, (a, b, c, d))], ["shard", "k1", "k2", "h1", "h2"])

    asks = row_keys(docs, "text").mapInArrow(ask, "shard long, k1 long, k2 long, h1 long, h2 long")
    both = index.select("shard", F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), "packed").unionByName(asks.withColumn("packed", F.lit(None).cast("binary")))

    def answer(batches):
        shard, held_shard = None, None
        for batch in batches:
            s, packed = batch.column("shard").to_numpy(), batch.column("packed")
            new = [i for i in range(len(s)) if packed[i].is_valid]
            cuts = [0, *new, len(s)]
            for a, b in zip(cuts, cuts[1:]):
                if a in new:
                    shard, held_shard = int(s[a]), Shard.unpack(packed[a].as_py())
                    a += 1
                part = batch.slice(a, b - a)
                h = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2")], axis=1).astype(np.int64) if b > a else np.zeros((0, 2), np.int64)
                if len(h) and held_shard is not None:
                    hit = (part.column("shard").to_numpy() == shard) & (held_shard.count(h) > 0)
                    got = part.filter(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([got.column(c) for c in ("k1", "k2", "h1", "h2")], ["k1", "k2", "h1", "h2"])

    dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("packed").isNull())
    return dealt.mapInArrow(answer, "k1 long, k2 long, h1 long, h2 long").groupBy("k1", "k2").agg(F.collect_list(F.struct("h1", "h2")).alias("found"))


def _with_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    keyed = row_keys(docs, "doc_id", "text")
    return keyed.join(found, ["k1", "k2"], "left").select("doc_id", "text", "found")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """op3: whole texts of documents without the lines whose key is in at least 10 documents."""
    return drop_common_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY r
"""
