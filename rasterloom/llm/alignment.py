"""Alignment of two tokenizers over the same texts.

Both tokenizers read the whole text first. Where a token of each ends at one byte and both next tokens begin with a
space, the text is cut: the windows between such anchors are a word or a few, so few different ones are common, and what
a window's alignment looks like depends on its token ids only. Alignments are kept by the tuple of ids of both sides
and looked up; only windows not seen before are aligned. A window's alignment is the walk over both sides' ends: every
stretch of bytes between two ends that follow each other belongs to one token of each side, and is a link.

A pair of ids counts the documents that hold it linked. Counts of the most frequent 2^20 pairs go to all tasks (16 MB,
whatever the corpus holds); what a document holds of the others is looked up by a join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, ship, stored, table

#: The public vocabularies; a parameter of everything below.
A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs whose counts all tasks hold, and windows whose alignments a task holds.
NEAR_PAIRS, MEMO = 1 << 20, 300_000
#: Signs of text that are aligned together, beside one whole text.
CHUNK = 1 << 20
#: What is split like the byte-level vocabulary's own pre-tokenizer. Fixed value: the published pattern of that vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 signs for themselves, the next letters from 256 on for the others."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class ByteLevel:
    """The vocabulary of a byte-level BPE file; special tokens are never made."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)
        special, letters = {x["content"] for x in vocab["added_tokens"]}, byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab["model"]["vocab"].items() if t not in special}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t
        # Ids of such a file follow its merges, so the lowest id merges first: the same tokens as the file's own model, several times as fast.
        self.model = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(" " + x) for x in texts]


class Pieces:
    """The vocabulary of a sentence-piece file with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def tokenizers(a_file: str, b_file: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_file), Pieces(b_file)


@dataclass
class Side:
    """What the tokens of one vocabulary are made of, by id."""

    bytes: list[bytes]

    def __post_init__(self) -> None:
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.space = np.array([x[:1] == b" " for x in self.bytes], bool)
        # Decimal ids with what follows them: a token of the same side, of the other side, of the next group.
        self.text = np.array([[b"%d%s" % (i, end) for end in (b",", b"|", b";")] for i in range(len(self.bytes))], object)


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n times for each."""
    first = np.cumsum(n) - n
    return np.arange(n.sum()) + np.repeat(start - first, n)


@dataclass
class Aligned:
    """A text's alignment; pairs: its different links as A id * size of B + B id, and times: how often it has each."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: bytes = b""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def digest(self) -> str:
        """Of the groups in text form; empty without tokens."""
        return hashlib.sha256(self.groups).hexdigest() if self.n_a else ""


class Aligner:
    """Aligns texts; keeps the alignments of windows by their ids on both sides, up to a number of them."""

    def __init__(self, a: ByteLevel, b: Pieces, memo: int = MEMO) -> None:
        self.a, self.b, self.most = a, b, memo
        self.side_a, self.side_b = Side(a.bytes), Side(b.bytes)
        self.looked = self.aligned = 0
        self.clear()

    def clear(self) -> None:
        self.memo: dict[tuple[bytes, bytes], int] = {}
        self.groups: list[bytes] = []
        self.numbers, self.links, self.held = np.zeros((1024, 3), np.int64), np.zeros(4096, np.int64), 0

    def windows(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Alignments of windows whose tokens a, b stand one behind the other, n_a and n_b of them: groups in text form, groups and links of each, and the links."""
        ends_a, ends_b = np.cumsum(self.side_a.length[a]), np.cumsum(self.side_b.length[b])
        # Each stretch between two ends that follow each other is one link; where both sides end, a group ends.
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        links = a[at_a].astype(np.int64) * len(self.b.bytes) + b[at_b]
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        borders = ends_a[np.cumsum(n_a) - 1]
        n_links = np.diff(np.searchsorted(ends, borders, "right"), prepend=0)
        n_groups = np.diff(np.searchsorted(shared, borders, "right"), prepend=0)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        texts = np.concatenate([self.side_a.text[a, last_a * 1], self.side_b.text[b, last_b * 2]])[order].tolist()
        cuts = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        return [b"".join(texts[i:j]) for i, j in zip(cuts, cuts[1:])], n_groups, n_links, links

    def keep(self, groups: list[bytes], n_groups: np.ndarray, n_links: np.ndarray, links: np.ndarray) -> None:
        """Adds alignments to those held."""
        n, size = len(self.groups), self.held
        for name, need in (("numbers", n + len(groups)), ("links", size + len(links))):
            if (was := getattr(self, name)).shape[0] < need:
                new = np.zeros((2 * need, *was.shape[1:]), np.int64)
                new[: len(was)] = was
                setattr(self, name, new)
        self.links[size : size + len(links)] = links
        self.numbers[n : n + len(groups)] = np.stack([n_groups, n_links, size + np.cumsum(n_links) - n_links], axis=1)
        self.groups += groups
        self.held += len(links)

    def known(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window its number among the alignments held, and the windows that are to be aligned for that, in their order."""
        raw, code = [], []
        for ids, cut in ((a, cut_a), (b, cut_b)):
            flat, ends = ids.tobytes(), (4 * cut).astype(np.int32)
            code.append(np.asarray(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(ends), pa.py_buffer(flat)]).dictionary_encode().indices))
            raw.append((flat, ends.tolist()))
        (flat_a, ends_a), (flat_b, ends_b) = raw
        _, first, of = np.unique(code[0].astype(np.int64) << 32 | code[1], return_index=True, return_inverse=True)
        at, new, memo, n = [], [], self.memo, len(self.groups)
        for i in first.tolist():
            ids = flat_a[ends_a[i] : ends_a[i + 1]], flat_b[ends_b[i] : ends_b[i + 1]]
            if (k := memo.get(ids)) is None:
                k = memo[ids] = n + len(new)
                new.append(i)
            at.append(k)
        return np.array(at)[of], np.array(new, np.int64)

    def align(self, texts: list[str]) -> list[Aligned]:
        """One for each text, which must not be so many that their tokens don't fit in memory."""
        all_a, all_b, out = self.a.encode(texts), self.b.encode(texts), [Aligned() for _ in texts]
        by_a, by_b, good = self.a.bytes, self.b.bytes, []
        for i, (text, x, y) in enumerate(zip(texts, all_a, all_b)):
            want = b" " + text.encode()
            if text and b"".join(map(by_a.__getitem__, x)) == want and b"".join(map(by_b.__getitem__, y)) == want:
                good.append(i)
        if not good:
            return out
        a, b = (np.fromiter(chain.from_iterable([ids[i] for i in good]), np.uint32) for ids in (all_a, all_b))
        n_a, n_b = (np.array([len(ids[i]) for i in good]) for ids in (all_a, all_b))
        # Byte offsets at which tokens begin, over all texts. Anchors are the offsets of both sides whose tokens begin
        # with a space; every text begins with one.
        from_a, from_b = (np.cumsum(n) - n for n in (self.side_a.length[a], self.side_b.length[b]))
        at_a, at_b = np.nonzero(self.side_a.space[a])[0], np.nonzero(self.side_b.space[b])[0]
        place = np.minimum(np.searchsorted(from_b[at_b], from_a[at_a]), len(at_b) - 1)
        both = from_b[at_b][place] == from_a[at_a]
        cut_a, cut_b = np.append(at_a[both], len(a)), np.append(at_b[place[both]], len(b))
        if len(self.memo) > self.most:
            self.clear()
        which, new = self.known(a, b, cut_a, cut_b)
        self.looked += len(which)
        self.aligned += len(new)
        if len(new):
            w_a, w_b = np.diff(cut_a)[new], np.diff(cut_b)[new]
            self.keep(*self.windows(a[spans(cut_a[new], w_a)], b[spans(cut_b[new], w_b)], w_a, w_b))
        n_groups, n_links, first = self.numbers[which].T
        owner = np.searchsorted(np.cumsum(n_a), cut_a[:-1], "right")
        keyed, times = np.unique((np.repeat(owner, n_links) << 40) + self.links[spans(first, n_links)], return_counts=True)
        cuts = np.searchsorted(keyed, np.arange(len(good) + 1) << 40).tolist()
        last = np.searchsorted(owner, np.arange(len(good) + 1)).tolist()
        names = [self.groups[k] for k in which.tolist()]
        for j, i in enumerate(good):
            u, v, s, e = cuts[j], cuts[j + 1], last[j], last[j + 1]
            out[i] = Aligned(int(n_a[j]), int(n_b[j]), int(n_groups[s:e].sum()), b"".join(names[s:e])[:-1], keyed[u:v] & ((1 << 40) - 1), times[u:v])
        return out


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<u4").tobytes() for x in arrays], pa.binary())


def alignments(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), stored; pairs and times: a document's different linked pairs and how often it links each, 4 bytes for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Aligner(*tokenizers(a_file, b_file))
        for batch in batches:
            texts, at, got = [x or "" for x in batch.column("text").to_pylist()], 0, []
            room = np.cumsum([len(x) for x in texts]) // CHUNK
            for end in [*(np.nonzero(np.diff(room))[0] + 1).tolist(), len(texts)]:
                got += to.align(texts[at:end])
                at = end
            n = [pa.array([int(getattr(x, c)) for x in got], pa.int64()) for c in ("n_a", "n_b", "n_groups")]
            links = pa.array([int(x.times.sum()) for x in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *n, links, pa.array([x.digest for x in got], pa.string()), binary([x.pairs for x in got]), binary([x.times for x in got])],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")
    with batches_of(spark, 256):
        return stored(made.withColumn("row", F.monotonically_increasing_id()), "alignments", compression="zstd")


def keys_of(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<u4").astype(np.int64) if value.is_valid and len(value.as_buffer()) else np.zeros(0, np.int64)


def pair_counts(aligned: DataFrame, b_size: int, held: int = 1 << 22) -> DataFrame:
    """(pair, n, best), stored: the documents that hold each pair, and whether no other pair of its A id is in more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def added() -> pa.RecordBatch:
            pair, times = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(times.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for x in batch.column("pairs"):
                waiting.append(keys_of(x))
                n += len(waiting[-1])
                if n >= held:
                    yield added()
                    waiting, n = [], 0
        if waiting:
            yield added()

    n = stored(aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.floor(F.col("pair") / b_size)
    most = n.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for an id of the vocabulary at most
    return stored(n.join(F.broadcast(most), a == most["a"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def align_documents(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, near_pairs: int = NEAR_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs(doc_id, text).

    Without tokens, so all zero and with an empty digest: null and empty texts, and texts that a tokenizer doesn't give
    back byte by byte (the sign that stands for a space in pieces). Rows that repeat are documents of their own and
    count each. Ties: all pairs of an A id that are in as many documents as its most frequent are best. A very long text
    is tokenised whole. Other columns are ignored; an empty
    table gives an empty table. near_pairs: the pairs whose counts all tasks hold; it doesn't change the result.
    """
    spark = docs.sparkSession
    aligned = alignments(docs, a_file, b_file)
    counts = pair_counts(aligned, len(tokenizers(a_file, b_file)[1].bytes))
    near, least = counts, 0
    if counts.count() > near_pairs:
        # The smallest count that at most so many pairs reach.
        by_n = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect()
        have, least = 0, (1 << 16) + 1
        for r in by_n:
            have += r["k"]
            if have > near_pairs:
                break
            least = r["n"]
        near = counts.where(F.col("n") >= least)
    top = near.toArrow().sort_by("pair")
    held = spark.sparkContext.broadcast([np.asarray(top[c].to_numpy()) for c in ("pair", "n", "best")])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for batch in batches:
            sums, bests, far, far_times = [], [], [], []
            for p, t in zip(batch.column("pairs"), batch.column("times")):
                keys, times = keys_of(p), keys_of(t)
                at = np.searchsorted(pair, keys)
                hit = np.zeros(len(keys), bool) if len(pair) == 0 else pair[np.minimum(at, len(pair) - 1)] == keys
                sums.append(int((n[at[hit]] * times[hit]).sum()))
                bests.append(int(times[hit][best[at[hit]]].sum()))
                far.append(keys[~hit].tolist())
                far_times.append(times[~hit].tolist())
            new = [pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), pa.array(far, pa.list_(pa.int64())), pa.array(far_times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, "n_best", "count_sum", "far", "far_times"])

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    types = {f.name: f.dataType.simpleString() for f in aligned.schema}
    out = aligned.mapInArrow(look, ", ".join(f"{c} {types[c]}" for c in kept) + ", n_best long, count_sum long, far array<long>, far_times array<long>")
    if not least:
        return out.drop("row", "far", "far_times")
    out = stored(out, "looked", compression="zstd")
    asks = out.select("row", F.explode(F.arrays_zip("far", "far_times")).alias("x")).select("row", F.col("x.far").alias("pair"), F.col("x.far_times").alias("t"))
    # A pair beyond the near ones is in fewer documents than any of those, so no key of this join is hot.
    more = asks.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.col("t") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("_best"))
    whole = out.drop("far", "far_times").join(more, "row", "left")
    return whole.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).drop("row", "_sum", "_best")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """op13: both public vocabularies over whole documents, and how common their links are."""
    out = align_documents(table(spark, sf_dir, "documents"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
