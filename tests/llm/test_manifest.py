"""The Merkle manifest against a plain version of it, and its graph."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import manifest
from rasterloom.llm.common import ascii_lower


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def build(nodes, proofs, arity):
    """The last node over nodes (digest, leaves); adds to each leaf's proof."""
    while len(nodes) > 1:
        up = []
        for i in range(0, len(nodes), arity):
            run = nodes[i : i + arity]
            for j, (_, leaves) in enumerate(run):
                for x in leaves:
                    proofs[x].append(([d for d, _ in run[:j]], [d for d, _ in run[j + 1 :]]))
            up.append((h(*(d for d, _ in run)), [x for _, leaves in run for x in leaves]))
        nodes = up
    return nodes[0]


def brute(rows, seen, arity=8):
    leaf = lambda r, text: h(*(field(r[c]) for c in manifest.FIELDS[:-1]), field(text))
    parts, proofs, subs = defaultdict(list), defaultdict(list), []
    for i, r in enumerate(rows):
        parts[r["lang"]].append(i)
    for lang in sorted(parts, key=lambda x: (x is not None, (x or "").encode())):
        order = sorted(parts[lang], key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, leaf(rows[i], rows[i]["text"])))
        subs.append(build([(leaf(rows[i], rows[i]["text"]), [i]) for i in order], proofs, arity))
    root = build(list(subs), proofs, arity)[0]
    out = []
    for sub, leaves in subs:
        for i in leaves:
            x = leaf(rows[i], seen(rows[i]))
            for left, right in proofs[i]:
                x = h(*left, x, *right)
            out.append((rows[i]["doc_id"], leaf(rows[i], rows[i]["text"]), sub, root, "".join(d for a, b in proofs[i] for d in a + b), x, x == root))
    return Counter(out)


def shout(r):
    return None if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])


def found(docs, arity=8):
    return Counter(tuple(r) for r in manifest.manifest_proofs(docs, ascii_lower(F.col("text")), arity).collect())


@pytest.mark.parametrize("arity", [2, 8])
def test_proofs_of_odd_rows(odd, none, arity):
    rows = odd.collect()
    got = found(odd, arity)
    assert got == brute(rows, shout, arity)
    assert {x[-1] for x in got} == {True, False}
    assert found(none) == Counter()


def test_proofs_of_many_languages_and_of_rows_that_repeat(spark):
    """Seventy languages, two of them one row; a third of the rows are one row; a row alone."""
    rows = [(i, f"s{i % 3}", f"l{i % 68:02}" if i % 5 else "é", i, f"Text {i}") for i in range(300)] + [(7, None, "en", 1, "Again")] * 150 + [(None, None, None, None, None)] * 3 + [(1, None, "Z", None, "A")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert found(docs) == brute(docs.collect(), shout)
    one = docs.where("lang = 'Z'")
    assert found(one) == brute(one.collect(), shout)


def test_equal_subtrees_are_stored_once_and_requests_are_few(spark):
    leaves = spark.range(1000).select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("rank"), F.lit(1000).cast("long").alias("size"), F.lit("ab").alias("digest"))
    levels = manifest.grow(leaves)
    assert [x.count() for x in levels] == [1000, 125, 16, 2, 1]
    assert [manifest.records(x).count() for x in levels[1:]] == [1, 2, 2, 1]
    root = manifest.subroots(levels).withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    asked = spark.createDataFrame([(0, 999), (0, 0), (0, 5000), (3, 1)], "tree long, rank long")
    got = manifest.descend(levels, root, asked).collect()
    assert sorted(r["rank"] for r in got) == [0, 999]
    assert all(len(r["path"]) == 4 and r["digest"] == "ab" for r in got)
