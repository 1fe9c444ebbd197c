"""SimHash near-duplicates: pigeonhole blocks, joins on blocks, Hamming verification, connected components.

A fingerprint of 64 bits is cut into 5 blocks. Two fingerprints that differ in at most 2 bits share at least 3 blocks,
so they meet in one of the 10 joins on 3 blocks (38 bits or more, so that buckets stay small at any corpus size).
Equal fingerprints are one node. In a bucket of few fingerprints all pairs are verified. In a larger one no pairs are
made: each fingerprint names itself and every fingerprint one bit away within the bucket, and those that name the same
one are linked to the smallest of them. Any two within 2 bits have such a name in common, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, row_keys, salted_join, stored, table, without

BLOCKS, MAX_BITS, FEW = 5, 2, 64


def fingerprint(text: bytes, words: int = 3) -> int:
    """Signed. Zero if the text has no words."""
    parts = text.lower().split()  # A-Z only; splits at the six ASCII blanks
    if not parts:
        return 0
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k, one = min(words, len(parts)) - 1, xxhash.xxh64_intdigest
    h = np.array([one(flat[a:b], 42) for a, b in zip(starts.tolist(), ends[k:].tolist())], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        bits += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, k1, k2, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint((x.as_py() or "").encode(), words) for x in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), fp], ["doc_id", "k1", "k2", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return row_keys(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, fp long")


def masks(blocks: int = BLOCKS, bits: int = MAX_BITS) -> list[int]:
    """For each choice of blocks - bits blocks, their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(one, blocks - bits)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, few: int = FEW) -> DataFrame:
    """(u, v), u <> v: pairs of distinct(fp) within 2 bits, enough of them to connect all that are."""
    own = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks())])
    keyed = distinct.select("fp", F.inline(own))
    buckets = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = stored(keyed.join(buckets, ["choice", "key"]), "blocks")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    some = keyed.where(F.col("n") <= few)
    pairs = some.select("choice", "key", F.col("fp").alias("u")).join(some.select("choice", "key", F.col("fp").alias("v")), ["choice", "key"]).where("u < v").where(near).select("u", "v")
    names = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << b)) for b in range(64)])
    many = keyed.where(F.col("n") > few).select("choice", "key", "fp", F.explode(names).alias("flip"))
    inside = F.element_at(F.array(*[F.lit(signed(m)) for m in masks()]), F.col("choice") + 1)
    many = many.where(F.col("flip").bitwiseAND(inside) == 0).withColumn("name", F.col("fp").bitwiseXOR(F.col("flip")))
    least = many.groupBy("choice", "name").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("m")).where("m > 1")
    stars = many.select("choice", "name", F.col("fp").alias("v")).join(least, ["choice", "name"]).where("u <> v").where(near).select("u", "v")
    return pairs.unionByName(stars).distinct()


def near_groups(docs: DataFrame, words: int = 3, few: int = FEW) -> DataFrame:
    """(doc_id, k1, k2, fp, component_id) for each row of docs(doc_id, text).

    component_id: the smallest doc_id among the rows that links of at most 2 differing bits reach. A null text counts
    as empty; texts without words have fingerprint zero and are linked as others are. Null doc_ids are never smallest;
    component_id is null where all are null. Rows that repeat are linked like others. A very long text is hashed whole, in
    steps of bounded memory. A bit set in just half of the hashes (a tie) is 0. An empty table gives none; other
    columns are ignored.
    """
    prints = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = stored(components(links(distinct, few), "links"), "roots")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    wide = ids.where(F.col("size") * 1000 >= max(rooted.count(), 2000)).select("root")
    members = salted_join(rooted, ids.drop("size"), "root", wide, F.col("fp")).select("fp", "component_id")
    hot = distinct.where(F.col("n") * 1000 >= max(prints.count(), 2000)).select("fp")
    return salted_join(prints, members, "fp", hot, F.col("k1"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs without those of another document's group: the one with the smallest doc_id stays. Of rows that repeat doc_id one stays."""
    groups = stored(near_groups(docs), "groups")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Rows of one doc_id in one group: the one with the smallest key stands for them. Null ids without a group id are told apart by their fingerprint.
    kept = groups.where(stays).withColumn("of", F.when(F.col("doc_id").isNull(), F.col("fp")).otherwise(F.lit(0)))
    first = kept.groupBy("doc_id", "of").agg(F.min("k1").alias("_k"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_i"), F.col("of").alias("_of"), "_k")
    repeated = kept.join(first, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("of") == F.col("_of")))
    gone = groups.where(~stays).select("k1", "k2").unionByName(repeated.where("k1 <> _k").select("k1", "k2"))
    return without(docs, gone, repeated.where("k1 = _k").select("k1", "k2"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """op8: fingerprints of whole documents and the components of those within 2 bits."""
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
