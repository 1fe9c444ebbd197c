"""Merkle manifest of a dataset: a content-addressed graph of digests, and proofs by descent from its root.

Rows become leaves; the leaves of a part (a language) ascend by identifier, and every eight consecutive nodes become
one, level by level, until a part has one node, its subroot. Subroots become the root likewise. What is stored are
records digest -> children, one for each digest, so equal subtrees are stored once.

A request for a leaf descends from the root: the digits of its rank, to the base of eight, choose a child at each
record, and the children that are not chosen are its proof. Requests that have had the same digits so far travel as one
row, so a level has no more rows than nodes, and the top ones few. At the leaf the segments are reversed: a proof goes
from the leaf to the root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, salted_join, small, stored, table

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """'-' if null, else the length in bytes, ':' and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(rows: DataFrame, group: str, order: list[str], trees: DataFrame | None = None) -> DataFrame:
    """rows with rank (from 0) in their group and the group's size; trees(group, tree), if any, adds tree.

    Rows are dealt and sorted by ranges and counted by range and group, so no group comes to one task. rows is read
    twice and must be stored. Rows that the order can't tell apart are ordered by their place in the input.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt, "ordered").withColumn("_part", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = dealt.groupBy("_part", F.col(group).alias("_g")).agg(F.min("_i").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", "_g", (before - F.col("_lo")).alias("_by"), F.sum("_n").over(W.partitionBy("_g")).alias("size"))
    if trees is not None:
        parts = parts.join(trees.withColumnRenamed(group, "_of"), F.col("_g").eqNullSafe(F.col("_of"))).drop("_of")
    parts = small(stored(parts, "parts").withColumnRenamed("_part", "_p"))
    met = dealt.join(parts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.withColumn("rank", F.col("_i") + F.col("_by")).drop("_at", "_part", "_p", "_i", "_g", "_by")


def grow(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """Levels of (tree, rank, size, digest, children) from leaves(tree, rank, size, digest) up to the last tree's one node; size: the nodes that the tree has at the level."""
    levels = [leaves.select("tree", "rank", "size", "digest", F.lit(None).cast("array<string>").alias("children"))]
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        up = levels[-1].where("size > 1").groupBy("tree", F.floor(F.col("rank") / arity).alias("rank")).agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("r"), "digest"))).alias("c"), F.max("size").alias("was"))
        up = up.withColumn("children", F.col("c.digest"))
        up = up.select("tree", "rank", F.ceil(F.col("was") / arity).alias("size"), F.sha2(F.array_join("children", ""), 256).alias("digest"), "children")
        levels.append(stored(up, f"level-{len(levels)}"))
        most = -(-most // arity)
    return levels


def subroots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest, height) of each tree's last node."""
    return reduce(DataFrame.unionByName, (x.where("size = 1").select("tree", "digest", F.lit(i).alias("height")) for i, x in enumerate(levels)))


def records(level: DataFrame) -> DataFrame:
    """The content-addressed store: (digest, children, n) once for each digest; n: the nodes that have it."""
    return level.groupBy("digest").agg(F.first("children").alias("children"), F.count(F.lit(1)).alias("n"))


def descend(levels: list[DataFrame], starts: DataFrame, requests: DataFrame, arity: int = ARITY) -> DataFrame:
    """requests(tree, rank, ...) with digest, path and what else starts(tree, digest, height, path, ...) holds, for each that exists.

    path: (left, right) for each record on the way down, the digests before and after the chosen child, each run together.
    """
    more = [c for c in starts.columns if c not in ("tree", "digest", "height", "path")]
    asked = [c for c in requests.columns if c not in ("tree", "rank")]
    wanted = [requests]
    for _ in levels[2:]:
        near = wanted[-1].select("tree", F.floor(F.col("rank") / arity).alias("rank")).distinct()
        wanted.append(stored(near, "wanted") if len(wanted) == 1 else near)
    enter = lambda height: starts.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("rank"), "digest", "path", *more)
    now = None
    for height in range(len(levels) - 1, 0, -1):
        now = enter(height) if now is None else now.unionByName(enter(height))
        store = stored(records(levels[height]), f"records-{height}")
        repeated = store.where("n > 1")
        if repeated.isEmpty():
            at = now.join(store.drop("n"), "digest")
        else:  # equal subtrees: one record for many nodes
            hot = repeated.where(F.col("n") * 1000 >= max(levels[height].count(), 2000)).select("digest")
            at = salted_join(now, store.drop("n"), "digest", hot, F.xxhash64("tree", "rank"))
        at = at.select(F.col("tree").alias("_t"), F.col("rank").alias("_up"), "children", "path", *more)
        ask = wanted[height - 1]
        met = ask.join(at, (ask["tree"] == at["_t"]) & (F.floor(ask["rank"] / arity) == at["_up"]))
        digit = (F.col("rank") - F.col("_up") * arity).cast("int")
        step = F.struct(F.array_join(F.slice("children", F.lit(1), digit), "").alias("left"), F.array_join(F.slice("children", digit + 2, F.lit(arity)), "").alias("right"))
        now = met.select("tree", "rank", *(asked if height == 1 else []), F.element_at("children", digit + 1).alias("digest"), F.concat("path", F.array(step)).alias("path"), *more)
    alone = requests.join(starts.where("height = 0").drop("height"), "tree").where("rank = 0").select("tree", "rank", *asked, "digest", "path", *more)
    return alone if now is None else now.unionByName(alone)


def manifest_proofs(docs: DataFrame, seen: Column, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) for each row of docs(doc_id, source, lang, n_chars, text).

    seen: the text as a reader finds it; folded_root is the root that follows from the leaf of that text and the
    original siblings, and verified is whether that is the root. proof: the siblings from the leaf's to the root's
    level, each level from left to right, run together; empty where there are none (a table of one row: its leaf is
    subroot and root). A null in any field is '-', which no text can be; null languages are a part of their own, the
    first; null doc_ids come first in theirs. Rows of one doc_id are ordered by their leaf, so rows that repeat are
    leaves beside each other with proofs of their own. A very long text is digested whole. Other columns are ignored;
    an empty table gives an empty table.
    """
    fields = [field(F.col(c)) for c in FIELDS]
    one = docs.select("doc_id", "lang", digest(*fields).alias("leaf"), digest(*fields[:-1], field(seen)).alias("seen"))
    leaves = stored(one, "leaves")
    langs = stored(leaves.select("lang").distinct().withColumn("all", F.lit(0)), "parts")
    trees = stored(ranked(langs, "all", ["lang"]).select("lang", F.col("rank").alias("tree"), F.col("size").alias("trees")), "trees")
    placed = ranked(leaves, "lang", ["doc_id", "leaf"], trees.select("lang", "tree"))
    placed = stored(placed.select("tree", "rank", "size", F.col("leaf").alias("digest"), "doc_id", "seen"), "placed")
    levels = grow(placed, arity)
    roots = stored(subroots(levels), "subroots")
    top = roots.join(trees, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("trees").alias("size"), "digest", F.col("height").alias("of"))
    above = grow(stored(top, "top"), arity)
    first = subroots(above).withColumn("path", F.array().cast("array<struct<left:string,right:string>>")).withColumn("root", F.col("digest"))
    starts = descend(above, stored(first, "root"), top.select("tree", "rank", "of"), arity)
    starts = stored(starts.select(F.col("rank").alias("tree"), "digest", F.col("of").alias("height"), "path", "root", F.col("digest").alias("subroot")), "starts")
    found = descend(levels, starts, placed.select("tree", "rank", "doc_id", "seen"), arity)
    way = found.withColumn("path", F.reverse("path"))
    fold = F.aggregate("path", F.col("seen"), lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    out = way.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_manifest(spark, sf_dir: str) -> DataFrame:
    """op12: proofs of all documents; where 3 divides the CRC-32 of doc_id, the text is found in lower case."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    out = manifest_proofs(table(spark, sf_dir, "documents"), F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR)))::VARCHAR || ':' || CAST({0} AS VARCHAR), '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in FIELDS[:-1])
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({_HEAD} || {_FIELD.format('text')}) AS leaf, sha256({_HEAD} || {_FIELD.format(_LOWER)}) AS low,
    -- CRC-32 bit by bit: bytes as they are, -1 for a shift
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS crc
  FROM documents),
base AS (SELECT row_number() OVER () AS r, doc_id, lang, leaf, CASE WHEN crc % 3 = 0 THEN low ELSE leaf END AS seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d),
nodes AS (
  SELECT 0 AS level, lang, rank, leaf AS digest FROM base
  UNION ALL
  SELECT any_value(level) + 1, lang, rank // 8, sha256(string_agg(digest, '' ORDER BY rank)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM nodes) WHERE c > 1 GROUP BY lang, rank // 8),
sub AS (SELECT lang, max(level) AS height, arg_max(digest, level) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM nodes GROUP BY lang),
top AS (
  SELECT 0 AS level, place AS rank, subroot AS digest FROM sub
  UNION ALL
  SELECT any_value(level) + 1, rank // 8, sha256(string_agg(digest, '' ORDER BY rank)) FROM (SELECT *, count(*) OVER () AS c FROM top) WHERE c > 1 GROUP BY rank // 8),
way AS (
  SELECT r, level, rank // CAST(8 ** level AS BIGINT) AS pos, lang, false AS over FROM base JOIN sub USING (lang), range(30) t(level) WHERE level < height
  UNION ALL SELECT r, level, rank // CAST(8 ** level AS BIGINT), NULL, false FROM base CROSS JOIN (SELECT * FROM sub WHERE lang IS NULL) s, range(30) t(level) WHERE base.lang IS NULL AND level < height
  UNION ALL SELECT r, level + height, place // CAST(8 ** level AS BIGINT), base.lang, true FROM base JOIN sub ON base.lang IS NOT DISTINCT FROM sub.lang, range(30) t(level) WHERE level < (SELECT max(level) FROM top)),
seg AS (
  SELECT r, w.level, coalesce(string_agg(n.digest, '' ORDER BY n.rank) FILTER (WHERE n.rank < pos), '') AS l, coalesce(string_agg(n.digest, '' ORDER BY n.rank) FILTER (WHERE n.rank > pos), '') AS g
  FROM way w JOIN nodes n ON NOT over AND n.lang IS NOT DISTINCT FROM w.lang AND n.level = w.level AND n.rank // 8 = pos // 8 GROUP BY ALL
  UNION ALL
  SELECT r, w.level, coalesce(string_agg(n.digest, '' ORDER BY n.rank) FILTER (WHERE n.rank < pos), ''), coalesce(string_agg(n.digest, '' ORDER BY n.rank) FILTER (WHERE n.rank > pos), '')
  FROM way w JOIN sub ON w.lang IS NOT DISTINCT FROM sub.lang JOIN top n ON over AND n.level = w.level - height AND n.rank // 8 = pos // 8 GROUP BY ALL),
path AS (SELECT r, list({{l: l, g: g}} ORDER BY level) AS p FROM seg GROUP BY r),
fold AS (
  SELECT r, 1 AS i, seen AS h FROM base
  UNION ALL
  SELECT r, i + 1, sha256(p[i].l || h || p[i].g) FROM fold JOIN path USING (r) WHERE i <= len(p))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(p, lambda x: x.l || x.g), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM base JOIN sub ON base.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN path USING (r) JOIN (SELECT r, arg_max(h, i) AS folded_root FROM fold GROUP BY r) USING (r), (SELECT arg_max(digest, level) AS root FROM top)
"""
