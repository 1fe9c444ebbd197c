"""Jaccard join of documents on word n-grams by T-occurrence search with DivideSkip.

Two sets are linked if they share 4/5 of their union, so a partner shares T = ceil(4 n / 5) shingles of a set of n.
DivideSkip finds those that are in at least T of a set's inverted lists: the L longest lists are left out, the others
are merged by a heap, and what is in T - L of them is looked for in the long ones by binary search.

Equal sets are one class. Of every class the head, the smallest hashes that any partner must share some of, is held
against the heads of all others, then what is left against the whole sets; classes that share too few leave. The others
are searched in two steps. First groups of bounded size search among themselves: a set that reaches a component of its
group is linked to it and, once some of that component are listed, isn't listed, so thousands of near copies have short
lists. Sets in the middle of many others go to all parts of a large group in the next round. Then classes that share
enough shingles with other components search all lists of the corpus: the short lists of both sets meet by a join,
and the long ones are probed. Only sets of different components meet there whose sketches, parities of 1,024 classes of
shingles, differ in no more bits than linked sets do in shingles; so a group of near copies makes no pairs of its own,
a family of sets below 4/5 makes few, and no link between components is lost.

Shingles are compared by hashes of 64 bits.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches_of, components, fresh, maybe_member, member_filter, passing, row_keys, salted_join, small, stored, table
from .passages import FILTER, filter_place, key_filter, word_hashes

WORDS = 5
#: The weight of a long list in the choice of L; the published value.
MU = 0.0085
#: Sets and shingles that a group searches among itself, about; rounds of that.
GROUP, TOKENS, ROUNDS = 512, 1 << 20, 3
#: Leaders that a component has in a group before sets that are linked to it alone don't lead.
FEW = 8
#: Sets of a group that go to all its parts.
HUBS = 64
#: Longs of a sketch.
SKETCH = 16
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def overlap(n):
    """T: what a partner of any size shares with a set of n."""
    return (4 * n + 4) // 5


def overlap_of_larger(n):
    """What a partner of at least its size shares with a set of n."""
    return (8 * n + 8) // 9


def hits(n):
    """How many shingles two heads share at least, for the smaller one's n."""
    return 1 + n // 10


def head(n):
    """The length of a head. The k-th of T shared elements has at most n - T + k - 1 before it, so hits(n) of them are inside."""
    return n - overlap(n) + hits(n)


def enough(shared, n, m):
    """Whether sets of n and m that share so many are linked: 100 * intersection >= 80 * union."""
    return 9 * shared >= 4 * (n + m)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted different hashes of runs of `words` words; of all words if there are fewer; none without words."""
    w = word_hashes(text)[0]
    n = max(1, len(w) - words + 1) if len(w) else 0
    out = np.full(n, min(words, len(w)), np.uint64)
    for i in range(min(words, len(w))):
        out = (out ^ w[i : i + n]) * _ODD
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique((out ^ (out >> np.uint64(31))).view(np.int64))


def lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)), pa.array(flat))


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(row, doc_id, k1, k2, n, digest, head), stored, for each row of docs: the size, digest and head of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, heads = [], [], []
            for x in batch.column("text"):
                s = shingle_set((x.as_py() or "").encode(), words)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                heads.append(s[: head(len(s))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists(heads)], ["doc_id", "k1", "k2", "n", "digest", "head"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = row_keys(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, n long, digest binary, head array<long>")
    with batches_of(docs.sparkSession, 256):
        return stored(made.withColumn("row", F.monotonically_increasing_id()), "sets")


def sharing(sets: DataFrame, part: str, least: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(cls), stored: of sets(cls, n, label, part) those that share least(n) of the hashes in part with sets of other labels.

    A filter of 8 MiB rules most out before their hashes move; the others are counted by a join.
    """
    shared = stored(sets.select("label", F.explode(part).alias("key")).groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key"), "shared")
    bits = sets.sparkSession.sparkContext.broadcast(key_filter(shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(FILTER // 8, np.uint8)
        for bucket, raw in bits.value:
            maybe[bucket * 4096 : bucket * 4096 + 4096] = np.frombuffer(raw, np.uint8)
        for batch in batches:
            keys, sizes = batch.column(part), batch.column("n").to_numpy()
            flat = keys.flatten().to_numpy()
            at = filter_place(flat)
            hit = (maybe[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            of = np.repeat(np.arange(len(batch)), keys.value_lengths().to_numpy())
            need = least(sizes)
            hit &= (np.bincount(of[hit], minlength=len(batch)) >= need)[of]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("cls").to_numpy()[of[hit]]), pa.array(need[of[hit]]), pa.array(flat[hit])], ["cls", "need", "key"])

    asked = sets.select("cls", "n", part).mapInArrow(run, "cls long, need long, key long")
    found = asked.join(shared, "key", "left_semi").groupBy("cls").agg(F.count(F.lit(1)).alias("k"), F.first("need").alias("need"))
    return stored(found.where("k >= need").select("cls"), "alive")


def members_of(docs: DataFrame, heads: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(cls, n, tokens), stored: the whole sets of classes(cls), made from one row of docs each."""
    asked = stored(heads.select("cls", "k1", "k2").join(classes, "cls"), "asked")
    keyed = passing(row_keys(docs, "text"), F.col("k1"), member_filter(asked, F.col("k1")))
    # Rows that repeat doc_id and text share their keys; one is enough.
    texts = keyed.join(asked, ["k1", "k2"]).select("cls", "text").dropDuplicates(["cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set((x.as_py() or "").encode(), words) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([len(x) for x in made], pa.int64()), lists(made)], ["cls", "n", "tokens"])

    with batches_of(docs.sparkSession, 256):
        return stored(texts.mapInArrow(run, "cls long, n long, tokens array<long>"), "members")


def left_out(t: int, longest: int) -> int:
    """L of DivideSkip: how many of the longest lists are probed instead of merged."""
    return min(t - 1, int(t / (MU * log2(max(longest, 2)) + 1)))


class Leaders:
    """Inverted lists of the sets that lead a group, and the components they make. Sets must come in order of size."""

    def __init__(self) -> None:
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []
        self.root: list[int] = []
        self.leading: Counter[int] = Counter()

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def search(self, tokens: list[int]) -> list[int]:
        """Sets that the tokens are linked to, one of each component that has any."""
        n = len(tokens)
        t = overlap(n)  # of one that isn't larger
        found = sorted([x for k in tokens if (x := self.lists.get(k)) is not None], key=len)
        if len(found) < t:
            return []
        skip = left_out(t, len(found[-1]))
        short, long = found[: len(found) - skip], found[len(found) - skip :]
        out, tops = [], set()
        for i, same in groupby(heapq.merge(*short)):
            have = sum(1 for _ in same)
            if have < t - skip or (top := self.top(i)) in tops:
                continue
            for x in long:
                at = bisect_left(x, i)
                have += at < len(x) and x[at] == i
            if enough(have, n, self.sizes[i]):
                out.append(i)
                tops.add(top)
        return out

    def add(self, tokens: list[int], near: list[int]) -> bool:
        """Joins the components of the sets nearby. Lists the set if none or several are near, or few of its component are listed: one in the middle of sets that aren't alike leads them on."""
        if len(near) == 1 and self.leading[self.top(near[0])] >= FEW:
            return False
        i = len(self.sizes)
        self.sizes.append(len(tokens))
        self.root.append(i)
        for k in tokens:
            self.lists.setdefault(k, []).append(i)
        self.leading[i] = 1
        for j in near:
            j = self.top(j)
            self.root[j] = i
            self.leading[i] += self.leading.pop(j)
        return True


def hubs_of(links: list[DataFrame]) -> DataFrame:
    """(cls, degree): sets with several links."""
    own = reduce(DataFrame.unionByName, links).where("u <> v")
    return own.select(F.col("u").alias("cls")).unionByName(own.select(F.col("v").alias("cls"))).groupBy("cls").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > 2)


def local_links(members: DataFrame, seed: int, hubs: DataFrame | None = None) -> DataFrame:
    """(u, v, leads), stored: the links of each set of a group to the components of its leaders; (u, u) if there are none. leads: whether u is a leader. A group is what has the same smallest hash of its shingles, dealt into parts of bounded size; sets alone are leaders and have no row. The HUBS sets of a group with most links in hubs(cls, degree) are in all its parts."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("tokens").flatten().to_numpy().view(np.uint64)
            mixed = (flat ^ (flat >> np.uint64(31)) ^ np.uint64(seed)) * _ODD
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
            n = batch.column("tokens").value_lengths().to_numpy()
            least = np.minimum.reduceat(mixed, np.cumsum(n) - n) if len(n) else mixed
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), pa.array(least.view(np.int64))], ["cls", "n", "route"])

    routed = stored(members.mapInArrow(route, "cls long, n long, route long"), "routes")
    sizes = routed.groupBy("route").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("t")).where("k > 1")
    parts = F.greatest(F.ceil(F.col("k") / GROUP), F.ceil(F.col("t") / TOKENS))
    dealt = routed.join(small(stored(sizes.select("route", parts.alias("parts")), "parts")), "route")
    dealt = dealt.select("cls", "route", "parts", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part"))
    if hubs is not None:
        known = stored(dealt.where("parts > 1").join(small(hubs), "cls"), "hubs")
        known = known.withColumn("_n", F.row_number().over(W.partitionBy("route").orderBy(F.desc("degree"), "cls"))).where(F.col("_n") <= HUBS)
        other = known.select("cls", "route", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("to")).where("part <> to")
        dealt = dealt.drop("parts").unionByName(other.select("cls", "route", F.col("to").alias("part")))
    dealt = stored(dealt.select("cls", "route", "part"), "dealt")
    groups = members.join(dealt, "cls").repartition("route", "part").sortWithinPartitions("route", "part", "n", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders, names = None, Leaders(), []
        for batch in batches:
            u, v, leads = [], [], []
            tokens = batch.column("tokens")
            for i, (key, cls) in enumerate(zip(zip(batch.column("route").to_pylist(), batch.column("part").to_pylist()), batch.column("cls").to_pylist())):
                if key != now:
                    now, leaders, names = key, Leaders(), []
                own = tokens[i].values.to_pylist()
                near = leaders.search(own)
                if lead := leaders.add(own, near):
                    names.append(cls)
                for at in near or [-1]:
                    u.append(cls)
                    v.append(names[at])
                    leads.append(lead)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(leads, pa.bool_())], ["u", "v", "leads"])

    with batches_of(members.sparkSession, 256):
        return stored(groups.mapInArrow(run, "u long, v long, leads boolean"), "links")


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, label), stored: the component of each class."""
    roots = components(links, "edges")
    return stored(members.select("cls").join(roots, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("label")), "labels")


def sketches(members: DataFrame) -> DataFrame:
    """(cls, s0, s1, ...), stored: for each of 64 * SKETCH classes of hashes whether a set has an odd number of them. Two sets that differ in d shingles differ in at most d bits."""
    names = [f"s{i}" for i in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("tokens").value_lengths().to_numpy()
            at = batch.column("tokens").flatten().to_numpy().view(np.uint64) % np.uint64(64 * SKETCH)
            odd = np.bincount(np.repeat(np.arange(len(n)), n) * 64 * SKETCH + at.astype(np.int64), minlength=len(n) * 64 * SKETCH) & 1
            bits = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), *(pa.array(np.ascontiguousarray(x)) for x in bits.T)], ["cls", *names])

    with batches_of(members.sparkSession, 256):
        return stored(members.select("cls", "tokens").mapInArrow(run, ", ".join(f"{c} long" for c in ("cls", *names))), "sketches")


def candidates(members: DataFrame) -> DataFrame:
    """(q, y, c, q_label, y_label) of members(cls, n, tokens, label): pairs of different labels, y not smaller, that share one of the short lists of both and may be linked by their sketches; c: how many they share.

    A row of a join costs more than a probe, so L is T - 1: all lists but the n - T + 1 shortest of a set are left to
    verified(). Linked sets share T = 4/9 of both sizes; of what they share, the one with the shortest list has T - 1
    behind it in both. Of a list, the sets of its commonest label are never joined with each other.
    """
    rows = members.select("cls", "n", "label", F.explode("tokens").alias("key"))
    of = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("df"), F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    rows = rows.join(of.where("labels > 1").drop("labels"), "key")
    own = W.partitionBy("cls")
    # Lists of one label only are the shortest, as no pair is in them.
    rows = rows.withColumn("_all", F.count(F.lit(1)).over(own)).withColumn("at", F.col("n") - F.col("_all") + F.row_number().over(own.orderBy("df", "key")))
    # A partner of at least the size of q, at most 5/4 of it; of one size, the one with the larger number.
    larger, any_size = F.floor((F.col("n") * 8 + 8) / 9), F.floor((F.col("n") * 4 + 4) / 5)
    rows = stored(rows.where((F.col("_all") >= any_size) & (F.col("at") <= F.col("n") - any_size + 1)).select("key", "main", "cls", "n", "label", "at", (F.col("_all") >= larger).alias("asks")), "lists")
    rows = rows.join(small(sketches(members), 20_000), "cls")
    bits = [f"s{i}" for i in range(SKETCH)]
    side = lambda a: [F.col("cls").alias(a), *[F.col(c).alias(f"{a}_{c}") for c in ("n", "label", "at", *bits)]]
    asks = rows.where(F.col("asks") & (F.col("at") <= F.col("n") - larger + 1)).select("key", "main", *side("q"))
    held = rows.select("key", "main", *side("y"))
    size = (F.col("y_n") * 4 <= F.col("q_n") * 5) & ((F.col("y_n") > F.col("q_n")) | ((F.col("y_n") == F.col("q_n")) & (F.col("y") > F.col("q"))))
    t = F.floor((4 * (F.col("q_n") + F.col("y_n")) + 8) / 9)
    near = (F.col("q_at") <= F.col("q_n") - t + 1) & (F.col("y_at") <= F.col("y_n") - t + 1)
    alike = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"q_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in bits]) <= F.col("q_n") + F.col("y_n") - 2 * t
    other = held.where("y_label <> main").drop("main")
    main = held.where("y_label = main").drop("main")
    met = asks.drop("main").join(other, "key").unionByName(asks.where("q_label <> main").drop("main").join(main, "key"))
    met = met.where(size & (F.col("q_label") != F.col("y_label")) & near & alike)
    return met.groupBy("q", "y").agg(F.count(F.lit(1)).alias("c"), F.first("q_label").alias("q_label"), F.first("y_label").alias("y_label"))


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(u, v): the pairs that are linked; the lists that weren't merged are probed by binary search in the sets of both."""
    side = lambda a: members.select(F.col("cls").alias(a), F.col("tokens").alias(f"{a}_tokens"))
    both = pairs.select("q", "y").join(side("q"), "q").join(side("y"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("q_tokens"), batch.column("y_tokens")):
                a, b = x.values.to_numpy(), y.values.to_numpy()
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                good.append(enough(int((b[at] == a).sum()), len(a), len(b)))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("y")], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    with batches_of(members.sparkSession, 256):
        return stored(both.mapInArrow(run, "u long, v long"), "links")


def similar_sets(docs: DataFrame, words: int = WORDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text).

    n_shingles: different runs of `words` words; a text with fewer has one, of all its words; one without words, or null,
    has none and is linked with nothing. component_id: the smallest doc_id that links of at least 4/5 of the union
    reach, the row's own included; null doc_ids are never smallest, and it is null where all are. A pair at exactly 4/5
    (a tie) is linked. Rows that repeat are linked like others; equal sets are one class and are searched for once.
    A very long text is hashed whole. Other columns are ignored; an empty table gives an empty table. rounds: of
    searches inside groups; it doesn't change the result.
    """
    sets = sets_of(docs, words)
    classes = stored(sets.where("n > 0").groupBy("digest").agg(F.min("row").alias("cls"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "classes")
    # Heads of all rows but those that repeat a set: what may be among those is looked up, the others don't move.
    repeats = stored(sets.where("n > 0").select("row").join(classes.select(F.col("cls").alias("row")), "row", "left_anti"), "repeats")
    first = sets.where("n > 0").select(F.col("row").alias("cls"), "k1", "k2", "n", "head")
    flag = fresh(first, "maybe")
    marked = maybe_member(first, F.col("cls"), member_filter(repeats.withColumnRenamed("row", "cls"), F.col("cls")), flag)
    heads = marked.where(~F.col(flag)).unionByName(marked.where(flag).join(repeats, F.col("cls") == F.col("row"), "left_anti")).drop(flag)

    own = F.col("cls").alias("label")
    alive = sharing(heads.select("cls", "n", "head", own), "head", lambda n: hits(overlap(n)))
    members = members_of(docs, heads, alive, words)
    members = stored(members.join(small(sharing(members.select("*", own), "tokens", overlap)), "cls", "left_semi"), "members")
    links, left = [], members
    for i in range(rounds):
        links.append(local_links(left, 0x5DEECE66D * (i + 1), hubs_of(links) if links else None))
        # A set in several parts stays if it leads in one.
        follows = links[-1].groupBy("u").agg(F.max("leads").alias("leads")).where("NOT leads").select(F.col("u").alias("cls"))
        left = left.join(small(follows), "cls", "left_anti")
    edges = reduce(DataFrame.unionByName, links).where("u <> v").select("u", "v")
    labels = labelled(members, edges)
    late = members.join(small(labels), "cls")
    late = stored(late.join(small(sharing(late, "tokens", overlap)), "cls", "left_semi"), "late")
    pairs = stored(candidates(late), "candidates")
    if not pairs.isEmpty():
        # The likeliest pair of two components first; then all that are of two components still.
        best = pairs.groupBy("q_label", "y_label").agg(F.max_by(F.struct("q", "y"), F.struct("c", "q", "y")).alias("b")).select("b.q", "b.y")
        sure = verified(best, late)
        now = labels if sure.isEmpty() else labelled(members, edges.unionByName(sure))
        rest = pairs.join(now.select(F.col("cls").alias("q"), F.col("label").alias("a")), "q").join(now.select(F.col("cls").alias("y"), F.col("label").alias("b")), "y").where("a <> b")
        rest = rest.join(best, ["q", "y"], "left_anti")
        more = verified(rest, late)
        labels = now if more.isEmpty() else labelled(members, edges.unionByName(sure).unionByName(more))

    named = stored(classes.join(labels, "cls", "left").select("digest", "least", "rows", F.coalesce("label", "cls").alias("label")), "named")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k"))
    n = named.count()
    wide = ids.where(F.col("k") * 1000 >= max(n, 2000)).select("label")
    whole = salted_join(named, ids.drop("k"), "label", wide, F.col("digest"))
    hot = named.where(F.col("rows") * 1000 >= max(sets.count(), 2000)).select("digest")
    some = salted_join(sets.where("n > 0").select("doc_id", "n", "digest", "row"), whole.select("digest", "component_id"), "digest", hot, F.col("row"))
    out = some.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_ngram_join(spark, sf_dir: str) -> DataFrame:
    """op11: components of whole documents that share 4/5 of their five-word shingles."""
    return similar_sets(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM d),
c AS (SELECT min(r) AS c, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT c, n, unnest(s) AS t FROM c),
p AS (SELECT a.c AS a, b.c AS b FROM t a JOIN t b ON a.t = b.t AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT c, c AS o FROM c UNION SELECT reach.c, e.b FROM reach JOIN e ON reach.o = e.a),
least AS (SELECT s, min(doc_id) AS m FROM s GROUP BY s),
comp AS (SELECT reach.c, min(m) AS component_id FROM reach JOIN c o ON reach.o = o.c JOIN least ON least.s = o.s GROUP BY reach.c)
SELECT doc_id, len(s.s) AS n_shingles, CASE WHEN len(s.s) = 0 THEN doc_id ELSE component_id END AS component_id FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN comp USING (c)
"""
