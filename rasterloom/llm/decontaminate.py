"""Benchmark decontamination through a positional inverted index, in DataFrame operations only.

The index holds a posting (term, row, position) for each training token that is a test term, sorted by term within
each file, and one row for each document with its length. A test item's window of ten words is looked up from its two
rarest terms: their posting lists, each shifted by the term's offset, are intersected on (item, document, start); only
where both lists meet are the lists of the other terms read. Words of one item that match on one diagonal (document
position less item position) in runs of ten or more are its exact matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, member_filter, passing, row_keys, small, stored, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Stands behind a document's last word; no word holds this sign.
END = "\x01end"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_terms(items: DataFrame) -> DataFrame:
    """(iid, item_id, p, n, term) for each word of items(item_id, text); items that repeat both are one."""
    rows = items.select("item_id", "text").distinct().select("item_id", F.xxhash64("item_id", "text").alias("iid"), words(F.col("text")).alias("w"))
    return rows.select("iid", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("p", "term"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (tid, k1, k2, pos) of docs(doc_id, text) for terms(term, tid); tid 0 has the row's doc_id and, as pos, its number of words."""
    ends = terms.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(0).cast("long").alias("tid"))
    rows = row_keys(docs, "doc_id", F.array_append(words(F.col("text")), F.lit(END)).alias("w"))
    tokens = rows.select("doc_id", "k1", "k2", F.posexplode("w").alias("pos", "term"))
    postings = tokens.join(small(terms.select("term", "tid").unionByName(ends)), "term")
    postings = postings.select("tid", "k1", "k2", "pos", F.when(F.col("tid") == 0, F.col("doc_id")).alias("doc_id"))
    return stored(postings.sortWithinPartitions("tid"), "postings")


def diagonals(index: DataFrame, items: DataFrame, window: int, slop: int = 0) -> DataFrame:
    """(iid, k1, k2, diag): where the two rarest terms of some window of the item stand in their places (give or take slop)."""
    frequency = stored(index.where("tid > 0").groupBy("tid").agg(F.count(F.lit(1)).alias("freq")), "frequency")
    known = items.join(small(frequency), "tid", "left")
    last = F.greatest(F.col("n") - window, F.lit(0))
    spans = known.withColumn("w", F.explode(F.sequence(F.greatest(F.col("p") - (window - 1), F.lit(0)), F.least("p", last))))
    each = W.partitionBy("iid", "w")
    # A window with a term that the corpus lacks can't occur.
    spans = spans.withColumn("lacking", F.max(F.col("freq").isNull()).over(each)).where(~F.col("lacking"))
    rarest = spans.withColumn("rank", F.row_number().over(each.orderBy("freq", "p"))).where("rank <= 2").select("iid", "p", "tid", "n").distinct()
    rarest = stored(rarest, "rarest")
    lists = index.join(small(rarest), "tid").select("iid", "n", "k1", "k2", (F.col("pos") - F.col("p")).alias("diag"), "p")
    if slop:
        lists = lists.withColumn("diag", F.explode(F.sequence(F.col("diag") - slop, F.col("diag") + slop)))
    met = lists.groupBy("iid", "n", "k1", "k2", "diag").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    return met.where((F.col("a") < F.col("b")) | (F.least("n", F.lit(window)) < 2)).select("iid", "k1", "k2", "diag")


def matches(index: DataFrame, items: DataFrame, found: DataFrame, slop: int = 0) -> DataFrame:
    """(iid, item_id, n, k1, k2, diag, p, pos): the item's words that stand on the diagonal, or within slop of it."""
    found = stored(found, "diagonals")
    ask = found.join(small(items.select("iid", "item_id", "n", "p", "tid")), "iid").withColumn("pos", F.col("diag") + F.col("p"))
    if slop:
        ask = ask.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
    key = F.xxhash64("k1", "k2")
    lists = passing(index.select("tid", "k1", "k2", "pos"), key, member_filter(found.select("k1", "k2").distinct(), key))
    return ask.where("pos >= 0").join(lists, ["tid", "k1", "k2", "pos"]).select("iid", "item_id", "n", "k1", "k2", "diag", "p", "pos").distinct()


def with_ids(terms: DataFrame) -> DataFrame:
    """Numbers distinct terms by hash: 63 bits, above 0."""
    return terms.withColumn("tid", F.xxhash64("term").bitwiseAND(F.lit((1 << 63) - 1)) + F.lit(0)).withColumn("tid", F.greatest("tid", F.lit(1).cast("long")))


def exact_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The index, and (item_id, k1, k2, pos): document words inside an occurrence of a window of items(item_id, text)."""
    items = stored(with_ids(item_terms(items)), "items")
    index = build_index(docs, items.select("term", "tid").distinct())
    hits = matches(index, items, diagonals(index, items, window))
    line = W.partitionBy("iid", "k1", "k2", "diag")
    hits = hits.withColumn("run", F.col("p") - F.row_number().over(line.orderBy("p")))
    hits = hits.withColumn("length", F.count(F.lit(1)).over(W.partitionBy("iid", "k1", "k2", "diag", "run")))
    return index, hits.where(F.col("length") >= F.least("n", F.lit(window))).select("item_id", "k1", "k2", "pos")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 3, window: int = WINDOW) -> DataFrame:
    """(item_id, k1, k2, diag, n_found): items all of whose words stand within slop positions of their places on a diagonal."""
    items = stored(with_ids(item_terms(items)), "items")
    index = build_index(docs, items.select("term", "tid").distinct())
    near = matches(index, items, diagonals(index, items, window, slop), slop)
    found = near.groupBy("iid", "item_id", "n", "k1", "k2", "diag").agg(F.countDistinct("p").alias("n_found"))
    return found.where("n_found = n").select("item_id", "k1", "k2", "diag", "n_found")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, k1, k2, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs(doc_id, text).

    Null and empty texts have no words. Items without words match nothing; items with fewer than `window` words are
    one window. Rows that repeat doc_id and text have the same result. An item with a null item_id hits words, but
    isn't counted or listed. Terms of equal frequency go by their place in the item. Very long texts are indexed whole.
    Other columns are ignored; an empty table gives none.
    """
    index, hits = exact_matches(docs, items, window)
    by_doc = hits.groupBy("k1", "k2").agg(F.countDistinct("pos").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    rows = index.where("tid = 0").select("doc_id", "k1", "k2", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(by_doc, ["k1", "k2"], "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "ids": F.coalesce("ids", F.array().cast("array<string>"))})
    return out.select("doc_id", "k1", "k2", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """op1: which words of every document are inside a window of a benchmark item."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT item_id, unnest([{'n': least(len(w), 10), 'g': array_to_string(w[s:s + least(len(w), 10) - 1], ' ')} for s in range(1, greatest(len(w) - 10, 0) + 2)], recursive := true) FROM b WHERE len(w) > 0),
z AS (SELECT DISTINCT n FROM v),
g AS (SELECT r, z.n, unnest(range(1, len(w) - z.n + 2)) AS s, w FROM d, z WHERE len(w) >= z.n),
h AS (SELECT g.r, g.s, g.n, v.item_id FROM (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM g) g JOIN v ON g.g = v.g AND g.n = v.n),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM h) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN i USING (r)
"""
