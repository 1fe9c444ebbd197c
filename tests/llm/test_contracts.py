"""The queries on the given tables, against SQL or brute force; and the operators on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from rasterloom.llm import decontaminate, exact_dedup, html_text, line_dedup, mixing, passages, quality, queries, secrets, simhash, url_filter

from ..compare import rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHOUT = {v: k for k, v in UPPER.items()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


# Exact dedup


def test_exact_groups_of_odd_rows(odd, none):
    got = exact_dedup.exact_groups(odd, "largest").collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[(r["text"] or "").translate(UPPER)].append(r["doc_id"])
    want = Counter((i, max((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_groups_when_digests_collide(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string")
    weak = lambda c: F.unhex(F.lpad(F.hex(F.length(c)), 4, "0"))
    got = exact_dedup.exact_groups(docs, digest=weak).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in got} == {(i, i % 7) for i in range(40)}


def test_index_of_levels_equals_index_of_all(spark):
    """Runs of small memtables, and a level merged with later runs."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i if i % 11 else None, bytes([i * i % 23])) for i in range(400)], "doc_id long, digest binary").repartition(3)
    runs = exact_dedup.flush(rows, 32)
    for r in runs.groupBy("run").agg(F.collect_list("digest").alias("d")).collect():
        assert sorted(set(r["d"])) == sorted(r["d"])
    assert runs.select("run").distinct().count() > 3
    old, new = rows.where("doc_id < 200"), rows.where("doc_id >= 200 OR doc_id IS NULL")
    want = {}
    for r in rows.collect():
        want.setdefault(bytes(r["digest"]), []).append(r["doc_id"])
    want = {d: (min((i for i in ids if i is not None), default=None), max((i for i in ids if i is not None), default=None), len(ids)) for d, ids in want.items()}
    for level in (exact_dedup.compact(runs), exact_dedup.compact(exact_dedup.compact(exact_dedup.flush(old, 32)), exact_dedup.flush(new, 1000))):
        assert {bytes(r["digest"]): (r["least"], r["most"], r["n"]) for r in level.collect()} == want


def test_drop_copies(odd, none):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    texts = [(r["text"] or "").translate(UPPER) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(r["text"] or "").translate(UPPER) for r in odd.collect()})
    assert exact_dedup.drop_copies(none).count() == 0


# Line dedup


def brute_lines(texts, least):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    n = Counter(k for t in texts for k in {strip(x) for x in (t or "").split("\n")} if k)
    return [([x for x in (t or "").split("\n") if not (strip(x) and n[strip(x)] >= least)], len((t or "").split("\n"))) for t in texts]


@pytest.mark.parametrize("near", [1 << 20, 5, 0])
def test_lines_with_few_and_many_broadcast(spark, near):
    common = [f"Common line {i}" for i in range(30)]
    texts = ["\n".join([f"own {i}", common[i % 30].upper() + " ", common[(i * 7) % 30], "", f"own too {i}"]) for i in range(60)] + [None, "", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["kept"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_common_lines(docs, min_docs=4, broadcast_keys=max(near, 1), per_shard=4).collect()}
    for i, (kept, n) in enumerate(brute_lines(texts, 4)):
        assert got[i] == ("\n".join(kept), n, n - len(kept))


@pytest.mark.parametrize("near", [1 << 20, 1])
def test_lines_of_odd_rows(odd, none, near):
    docs = odd.collect()
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.drop_common_lines(odd, min_docs=2, broadcast_keys=near, per_shard=2).collect())
    assert got == Counter((r["doc_id"], n, n - len(kept), "\n".join(kept)) for r, (kept, n) in zip(docs, brute_lines([r["text"] for r in docs], 2)))
    assert line_dedup.drop_common_lines(none).count() == 0


def test_perfect_hash_is_perfect():
    rng = np.random.default_rng(3)
    h = rng.integers(-(2**63), 2**63 - 1, (5000, 2))
    shard = line_dedup.Shard.unpack(line_dedup.Shard.build(h[:, 0], h[:, 1], np.arange(5000) + 10).pack())
    assert sorted(shard.index(np.ascontiguousarray(h[:, 0])).tolist()) == list(range(5000))
    assert (shard.count(h) == np.arange(5000) + 10).all()
    assert (shard.count(rng.integers(-(2**63), 2**63 - 1, (5000, 2))) == 0).all()


def test_lines_that_share_half_a_hash_are_all_indexed():
    h = np.array([(1, 1), (1, 2), (1, 3), (2, 1), (3, 5)], np.int64)
    shard = line_dedup.Shard.unpack(line_dedup.Shard.build(np.ascontiguousarray(h[:, 0]), h[:, 1], np.arange(5) + 10).pack())
    assert shard.count(h).tolist() == [10, 11, 12, 13, 14]
    assert shard.count(np.array([(1, 4), (3, 1), (9, 9)], np.int64)).tolist() == [0, 0, 0]


# Decontamination


def brute_hits(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[s : s + n])].add(i)
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if g := grams.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    ids |= g
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_of_odd_rows(spark, odd, none, prose):
    a, b = prose(80, 2), prose(30_000, 1).split()
    items = [(1, a[:120]), (2, " ".join(b[29_980:]) + " end"), (3, "one word"), (4, None), (5, ""), (6, "word"), (7, "same same same same same same same same same same same same"), (1, a[:120]), (8, "É")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(odd, bench).drop("k1", "k2").collect()
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter(map(tuple, got)) == Counter(brute_hits(docs, items))
    assert decontaminate.contamination(none, bench).count() == 0
    assert not decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha beta x y z w v gamma delta"), (3, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma delta")], "item_id long, text string")
    got = decontaminate.proximity_matches(docs, items, slop=1)
    assert got.select("k1").distinct().count() == 1 and got.first()["n_found"] == 4


# Mixing


def test_mix_meets_targets(spark, sf):
    m = mixing.op5_mixing(spark, sf).toPandas()
    assert ((m.taken >= 0) & (m.taken <= 2 * m["size"])).all()
    again = mixing.op5_mixing(spark, sf).toPandas()
    assert rows(m) == rows(again)
    m = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    s = m.groupby("source").agg({"taken": "sum", "target": "first"})
    assert (abs(s.taken - s.target) <= 1).all()
    assert abs(s.taken.sum() - 1.5 * m["size"].sum()) <= 2 * len(s)


def test_mix_of_odd_rows(odd, none):
    m = mixing.mix(odd).toPandas()
    assert len(m) == odd.count() and m[m["size"] == 0].taken.sum() == 0
    assert mixing.mix(none).count() == 0
    for _, g in m.groupby(m.source.fillna("null!")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1 and g.target.iloc[0] <= 2 * g.source_size.iloc[0] + 1e-6


def test_heavier_documents_come_first(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w " * 10, "a" if i % 2 else "b") for i in range(400)], "doc_id long, text string, source string")
    taken = {}
    for scale in (1.0, 1e-5):
        m = mixing.mix(docs, weight=F.when(F.col("doc_id") < 200, 9.0 * scale).otherwise(scale), share=0.5, weights=(1, 1)).toPandas()
        first = m[m.doc_id < 200].taken.sum()
        assert first > 1.5 * m[m.doc_id >= 200].taken.sum()
        taken[scale] = dict(zip(m.doc_id, m.taken))
    assert taken[1.0] == taken[1e-5]


# SimHash


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, prints, bits=2):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(items):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(items))]


def test_simhash_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [brute_simhash(r["text"]) for r in docs]
    want = {(r["doc_id"], f"{p:016x}", c) for r, p, c in zip(docs, prints, brute_components([r["doc_id"] for r in docs], prints))}
    assert {tuple(r) for r in simhash.op8_simhash(spark, sf).collect()} == want


def test_simhash_of_odd_rows(odd, none):
    docs = odd.collect()
    prints = [brute_simhash(r["text"]) for r in docs]
    want = Counter((r["doc_id"], c) for r, c in zip(docs, brute_components([r["doc_id"] for r in docs], prints)))
    assert Counter((r["doc_id"], r["component_id"]) for r in simhash.near_groups(odd).collect()) == want
    assert simhash.near_groups(none).count() == 0
    assert simhash.drop_near_copies(odd).columns == odd.columns


@pytest.mark.parametrize("few", [64, 1])
def test_links_connect_all_within_two_bits(spark, few):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12).tolist()
    prints = {b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(12)} | set(base)
    prints = sorted(simhash.signed(p & (2**64 - 1)) for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = [(r["u"], r["v"]) for r in simhash.links(df, few).collect()]
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 2 for u, v in links)
    from rasterloom.llm.common import components

    root = {r["node"]: r["root"] for r in components(simhash.links(df, few)).collect()}
    want = brute_components(prints, [p & (2**64 - 1) for p in prints])
    assert [root.get(p, p) for p in prints] == want


def test_components_of_one_task_take_one_round(spark, monkeypatch):
    """What a task holds is joined in it; other tasks' trees meet in rounds."""
    from rasterloom.llm import common

    tables, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, what: tables.append(what) or stored(df, what))
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(500)] + [(1000 + r.randrange(300), 1000 + r.randrange(300)) for _ in range(250)]
    want = dict(zip(range(1300), brute_roots(edges, 1300)))
    for limit, most in ((common.FOREST, 1), (7, 20)):
        tables.clear()
        monkeypatch.setattr(common, "FOREST", limit)
        got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "u long, v long").coalesce(1)).collect()}
        assert got == {n: want[n] for e in edges for n in e if e[0] != e[1]} and len(tables) <= most


def brute_roots(edges, n):
    root = list(range(n))
    while any(root[u] != root[v] for u, v in edges):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    return root


def test_components_of_a_long_chain(spark):
    from rasterloom.llm.common import components

    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r["root"] for r in components(df).collect()} == {0}


# Quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op9_quality(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(got) == docs and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()
    both = got[got.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean() > 0.97
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.8


def brute_features(text):
    """The same features from characters, words and lines one by one; texts are ASCII or UTF-8 bytes."""
    raw = text.encode()
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", raw) if w]
    lines = raw.split(b"\n")
    n, letters = max(len(raw), 1), max(sum(65 <= c <= 90 or 97 <= c <= 122 for c in raw), 1)
    return [
        np.log(1 + len(raw)), np.log(1 + len(words)), sum(65 <= c <= 90 for c in raw) / letters, sum(48 <= c <= 57 for c in raw) / n, count(b"#$%&*") / n, count(b"|") / n, count(b"!") / n, count(b".,") / n,
        count(b" \t\n") / n, sum(c > 127 for c in raw) / n, (n - len(words)) / len(words) if words else 0.0, len(set(words)) / len(words) if words else 1.0,
        np.log(1 + len(lines)), len(set(lines)) / len(lines), sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
    ]


def test_quality_by_brute_force(spark, sf):
    """Features one by one, the sample's model, and its tables added up entry by entry."""
    got = {r["doc_id"]: r for r in quality.op9_quality(spark, sf).collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    x = {i: brute_features(t) for i, t in docs.items()}
    known = [r["doc_id"] for r in spark.createDataFrame([(i,) for i in labels if i in docs], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id, 3) AS h").orderBy("h").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    model = quality.fit(np.array([x[i] for i in known]), np.array([float(labels[i]) for i in known]))
    for i, r in got.items():
        total = model.intercept
        for v, edges, values in zip(x[i], model.edges, model.tables):
            total += values[sum(e <= v for e in edges)]
        for a, b, ea, eb, values in model.pairs:
            total += values[sum(e <= x[i][a] for e in ea), sum(e <= x[i][b] for e in eb)]
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-6
        assert r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality_without_labels_and_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(odd, labels).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(15)] + [(2, 0)], "doc_id long, quality int")
    assert quality.score_documents(odd, some).count() == odd.count()
    assert quality.score_documents(none, some).count() == 0


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


# Secrets


def brute_spans(text):
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.A | re.I):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = secrets.op7_secrets(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(filter(None, r["spans"].split(",")))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(want.count(k) for k in ("assign:", "access:", "hex:"))


def test_secrets_hard_cases(spark):
    texts = ["é password = 'hunter2x' API-KEY", "Secret=token:abcdefgh", "TOKEN:abc", "api_key=" + "A" * 7, "AKIA" + "B" * 15, "x AKIA" + "B" * 16, "deadbeef" * 3, "deadbeef" * 2, "toKen=abcdefgh", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: secrets_of(r) for r in secrets.secrets(docs).collect()}
    assert got == {i: brute_spans(t or "") for i, t in enumerate(texts)}


def test_secrets_of_several_kinds_in_one_text(spark, tmp_path):
    text = "é AKIA" + "Q" * 16 + " and " + "0a" * 12 + ", token: " + "z" * 9 + " " + "1b" * 13 + " secret='" + "9f" * 20 + "'"
    spark.createDataFrame([(1, text), (2, text * 2), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in secrets.op7_secrets(spark, str(tmp_path)).collect():
        want = brute_spans({1: text, 2: text * 2, 3: ""}[r["doc_id"]])
        assert r["spans"] == want and (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(want.count(k) for k in ("assign:", "access:", "hex:"))


def secrets_of(r):
    return ",".join(f"{secrets.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in sorted(r["base"], key=lambda s: (s["start"], s["kind"])))


ENCODINGS = {"digits": "0123456789", "hex": "0123456789ABCDEF", "lower": "abcdefghijklmnopqrstuvwxyz", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
PLAIN = "internationalization configuration management documentation responsibility communication environment development understanding representative investigation implementation recommendation professional organization relationship government information application performance university opportunity particularly production community technology television important different question children business sentence menschenrechte geschwindigkeit verantwortung entreprise gouvernement informacion desarrollo".split()


def written(r, n, kind):
    """Writing of n signs without blanks."""
    out, sep = "", {"slug": "-", "path": "/", "dated": "-"}.get(kind, "")
    while len(out) < n:
        w = r.choice(PLAIN)
        out += (sep if out else "") + (w.capitalize() if kind == "camel" else w)
    return out[: n - 5] + f"-20{r.randrange(100):02d}" if kind == "dated" else out[:n]


#: Shares of planted random tokens found at a false discovery rate of 0.01 among as many written ones, at least.
POWER = {20: {"digits": 0.6, "hex": 0.35, "lower": 0.35, "base32": 0.55, "base36": 0.6, "letters": 0.5, "base62": 0.5, "base64": 0.5}, 32: {"lower": 0.75, "letters": 0.9}, 40: {"lower": 0.85}}


@pytest.mark.parametrize("n", [20, 32, 40])
def test_power_and_false_rate_of_the_battery(spark, n):
    """By encoding and length, as measured: 20 signs about half (lower case, hex) to three quarters, 32 signs 0.86 to 0.99, 40 signs 0.93 to 1; no written token is found."""
    r = random.Random(n)
    planted = [(kind, "".join(r.choice(a) for _ in range(n))) for kind, a in ENCODINGS.items() for _ in range(150)]
    planted += [(kind, written(r, n, kind)) for kind in ("word", "camel", "slug", "path", "dated", "word2", "camel2", "slug2") for _ in range(150)]
    docs = spark.createDataFrame([(i, f"see {t} there") for i, (_, t) in enumerate(planted)], "doc_id long, text string")
    found = {r["doc_id"]: r["added"] for r in secrets.secrets(docs).collect()}
    hits = defaultdict(list)
    for i, (kind, t) in enumerate(planted):
        hits[kind].append(bool(found[i]))
        assert not found[i] or [(s["start"], s["end"]) for s in found[i]] == [(4, 4 + n)]
    for kind in set(ENCODINGS) - ({"digits"} if n >= 24 else set()):  # such digits are base spans
        assert np.mean(hits[kind]) >= POWER[n].get(kind, 0.9), kind
    assert sum(sum(h) for kind, h in hits.items() if kind not in ENCODINGS) <= 0.01 * sum(map(sum, hits.values()))


def test_battery_rejects_order():
    for t in ("abcdefghijklmnopqrstuvwxyz", "0123456789" * 3, "a" * 40, "ab" * 20, "AAAAAAAAAAAAAAAAAAAABBBBBBBBBBBBBBBBBBBB"):
        random_, far = secrets.battery(t)
        assert random_ < secrets.RANDOM_LEVEL or far > 0.05
    assert secrets.battery("é" * 20) == (0.0, 1.0) and secrets.battery("short") == (0.0, 1.0)


def test_noncentral_chi_squared_by_simulation():
    rng = np.random.default_rng(1)
    for k, effect in ((4, 0.0), (2, 9.0), (4, 20.0), (8, 36.0)):
        x = np.sum((rng.standard_normal((200_000, k)) + np.sqrt(effect / k)) ** 2, axis=1)
        for q in (0.05, 0.3, 0.7):
            assert abs(secrets.chi2_cdf(float(np.quantile(x, q)), k, effect) - q) < 0.02


def brute_threshold(steps, fdr):
    """Benjamini-Hochberg over the p-values themselves."""
    p = sorted(10 ** (-s / secrets.STEPS) for s in steps)
    best = max((i for i, x in enumerate(p, 1) if x <= fdr * i / len(p)), default=0)
    return {s for s in steps if s >= 0 and best and 10 ** (-s / secrets.STEPS) <= p[best - 1]}


def test_secrets_of_a_length_are_held_against_tokens_of_that_length(spark):
    """Long written tokens don't raise the threshold of short keys."""
    r = random.Random(3)
    tokens = {5: [4 * r.randrange(0, 60) for _ in range(30)] + [-1] * 3, 6: [0] * 2000 + [100, 124], 7: [280]}
    rows = spark.createDataFrame([(i, [{"start": 0, "end": 1, "size": size, "step": s}]) for size, steps in tokens.items() for i, s in enumerate(steps)], "doc_id long, found array<struct<start:long,end:long,size:int,step:int>>")
    got = secrets.thresholds(rows)
    for size, steps in tokens.items():
        assert {s for s in steps if s >= got.get(size, 1 << 30)} == brute_threshold(steps, secrets.FDR)


def test_secrets_of_odd_rows(spark, odd, none):
    got = secrets.secrets(odd).collect()
    assert Counter((r["doc_id"], secrets_of(r)) for r in got) == Counter((r["doc_id"], brute_spans(r["text"] or "")) for r in odd.collect())
    assert not any(r["added"] for r in got)  # what is long there is one sign or none
    assert secrets.secrets(none).count() == 0
    twice = spark.createDataFrame([(1, None, 2), (1, "x " + "Zk3vQ9xT2mB7nR5cW8yJ4hL6pD1sG0fE" * 2, 2), (1, "x " + "Zk3vQ9xT2mB7nR5cW8yJ4hL6pD1sG0fE" * 2, 2)], "doc_id long, text string, found int")
    assert sorted(len(r["added"]) for r in secrets.secrets(twice).collect()) in ([0, 0, 0], [0, 1, 1])


# Urls


def brute_rule(host, path):
    fits = [(len(rule), verdict, rule) for verdict, rule in url_filter.RULES for of, start in [rule.split("/", 1)] if (host == of or host.endswith("." + of)) and path.startswith("/" + start)]
    return max(fits)[1:][::-1] if fits else (None, None)


def brute_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(UPPER), m[2]) if m else ("", "")
    return host, path, *brute_rule(host, path)


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.fit(url_filter.labelled(spark))


def test_url_rules_and_verdicts(spark, url_model):
    cases = ["http://a.NET/x", "https://example.net/en/1", "https://www.example.net/en/", "http://example.net/enx", "http://x.example.com/de/1?q", "http://foo.org/fr/2#t", "http://internet/x", "http://a.net", "no scheme", None, None, "", "ftp://myexample.net/en/", "://", "a://b://c.net/", "http://ÉX.org/fr/É", "http://h.com/" + "x/" * 20_000, "http://a.net/x"]
    pages = spark.createDataFrame([(i if i != 3 else None, u, "x", 1.0) for i, u in enumerate(cases)], "page_id long, url string, host string, probability double")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in url_filter.judge(pages, url_model).collect())
    assert got == Counter((i if i != 3 else None, *brute_url(u)[:3]) for i, u in enumerate(cases))
    for r in url_filter.judge(pages, url_model).collect():
        assert r["verdict"] == (brute_rule(r["host"], r["path"])[1] or ("block" if r["probability"] >= 0.5 else "allow"))
    assert url_filter.judge(pages.limit(0), url_model).count() == 0


def test_url_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = url_filter.op6_url_filter(spark, sf).collect()
    want = {r["page_id"]: brute_url(r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(want)
    for r in got:
        host, path, rule, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["probability"] >= 0.5 else "allow"))
    # The words of the given hosts are in the table beside other words only.
    hosts = {r["host"] for r in url_filter.labelled(spark).select("host").collect()}
    names = {h for h in (w[0] for w in want.values()) if re.search("spam|pills|casino|bets|ads-|adult", h)}
    assert names and not names & hosts
    judged = [(r["host"] in names, r["verdict"] == "block") for r in got if r["rule"] is None]
    assert sum(a == b for a, b in judged) > 0.97 * len(judged)


def test_url_words_in_the_path_are_judged(spark, url_model):
    block = ["http://news.example.org/casino/free-money", "http://www.example.com/a/viagra-pills.html", "https://pages.example.edu/2021/poker-jackpot/", "http://example.org/x/cheap-pills?id=3", "http://health.com/en/warez"]
    allow = ["http://news.example.org/science/history", "http://www.example.com/a/garden-recipes.html", "https://pages.example.edu/2021/museum-art/", "http://example.org/x/weather?id=3", "http://health.com/en/research"]
    pages = spark.createDataFrame(list(enumerate(block + allow)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, url_model, ()).collect()}
    assert [got[i] for i in range(10)] == ["block"] * 5 + ["allow"] * 5


def test_url_model_on_hosts_and_paths_it_has_not_seen(spark):
    """Trained without every fifth topic word's forms of one filler, and judged on those."""
    rows = url_filter.labelled(spark).toPandas()
    key = rows.host + rows.path
    out = key.str.contains("|".join(f"{f}-|-{f}" for f in url_filter.FILLERS[::5]))
    model = url_filter.fit(spark.createDataFrame(rows[~out]))
    test = rows[out].reset_index(drop=True)
    pages = spark.createDataFrame([(i, f"http://{r.host}{r.path}") for i, r in test.iterrows()], "page_id long, url string")
    got = url_filter.judge(pages, model, ()).toPandas().set_index("page_id")
    assert len(test) > 100 and ((got.verdict == "block") == (test.label == 1)).mean() > 0.9


# Html


def article(html):
    return [t for kind, t in html_text.parse(html) if kind == html_text.ARTICLE]


def test_html_of_an_article():
    page = """<html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body class="page-with-sidebar"><nav><ul><li>Home</li></ul></nav><header><h1>Site</h1></header>
    <div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First  <b>bold</b>&nbsp;text<br>line<p>Second &lt;x&gt; &#8364;<div class="ad-slot">Buy</div><form>Name</form><aside>Side</aside><section id="comments"><p>Nice!</p></section><ul><li>One</li><li>Two</li></ul></article>
    <footer>&copy; me</footer></body></html>"""
    assert article(page) == ["Title & more", "First bold text line", "Second <x> €", "One", "Two"]
    assert html_text.parse("") == [] and html_text.parse("<p>a") == [(html_text.OPEN, "a")]


@pytest.mark.parametrize(("html", "want"), [
    ('<article><div id="search-results"><p>Body</p></div><p class="author-note">Note</p><p>x</article>', [(1, "Body"), (1, "Note"), (0, "x")]),
    ("<article><p>one</p><aside><p>x<p>two</article><p>three</p>", [(0, "one"), (2, "x"), (2, "two"), (2, "three")]),
    ("<article><div><aside>x</div><p>y</p></article>", [(2, "x"), (0, "y")]),
    ("<article><p class=ad>x<p>y<ul><li class=ad>p<li>q</ul></article>", [(2, "x"), (0, "y"), (2, "p"), (0, "q")]),
    ("<div><article><p>a</div><p>b</article></div>", [(0, "a"), (0, "b")]),
    ("<main><math><mi>k</mi></math> <label>L</label> <svg><text>no</text></svg>z</main>", [(0, "k L z")]),
    ("<p>a<br>b<br/>c<i>d</i> e\n\tf", [(1, "a b cd e f")]),
    ("<article><p>a</p><article class='comment'><p>hi</p></article><article class='related-teaser'><p>t</p></article></article>", [(0, "a"), (2, "hi"), (2, "t")]),
    ("<main><article class='post with-sidebar'><p>a</p></article><article id='reply-4'><p>hi</p></article></main>", [(0, "a"), (2, "hi")]),
    ("</p></div>a<script>b</script><style>c</style><!-- d -->&amp;&#x41;&nbsp;", [(1, "a&A")]),
])
def test_html_blocks(html, want):
    assert html_text.parse(html) == want


@pytest.mark.parametrize("html", ["<b>" * 50_000 + "<p>" * 50_000 + "x", "<div>" * 100_000 + "</i>" * 100_000 + "x", "<ul><li>" * 50_000 + "</p>" * 50_000 + "x", "<article>" * 50_000 + "</div>" * 50_000 + "x"])
def test_nested_html_is_parsed_in_linear_time(html):
    start = time.perf_counter()
    assert [t for _, t in html_text.parse(html)] == ["x"]
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize("slice_pages", [1, 2, 2_000])
def test_articles_at_several_addresses_keep_their_text(spark, prose, slice_pages):
    """Equal pages are one page: their text is unique, and what other pages share still goes."""
    menu = "<div>Start page Contact us Imprint and more links</div>"
    text = [prose(40, i) for i in range(5)]
    rows = [(i, f"http://h.example/{i}", f"{menu}<p>{text[min(i, 4)]}</p>") for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), slice_pages=slice_pages).collect()}
    assert got == {i: text[min(i, 4)] for i in range(40)}


def test_many_spans_in_one_text():
    text = " ".join(f"{'ab' * 14}{i:04x} {'Qz7' * 9}{i}" for i in range(20_000))
    base = secrets.base_spans(text)
    start = time.perf_counter()
    found = secrets.candidates(text, base)
    assert len(base) == 20_000 and len(found) == 20_000 and time.perf_counter() - start < 20
    assert not {a for a, *_ in found} & {a for _, a, _ in base}


def test_suffix_array_by_sorting():
    rng = np.random.default_rng(4)
    for n, k in ((1, 2), (50, 2), (200, 3), (64, 1)):
        x = rng.integers(0, k, n)
        order, shared = html_text.suffix_array(x)
        want = sorted(range(n), key=lambda i: x[i:].tolist())
        assert order.tolist() == want
        for i in range(1, n):
            a, b = x[want[i - 1] :], x[want[i] :]
            m = min(len(a), len(b))
            same = np.flatnonzero(a[:m] != b[:m])
            assert shared[i] == (same[0] if len(same) else m)


def test_repeated_boilerplate_goes_from_open_pages(spark):
    menu = "<div>Start page Contact us Imprint and more links</div>"
    bodies = [f"<p>Unique text number {i} about {w} and nothing else</p>" for i, w in enumerate(("owls", "bees", "ants", "bats"))]
    pages = [(i, f"http://h.example/{i}", f"<html><body>{menu}{b}</body></html>") for i, b in enumerate(bodies)] + [(9, None, None), (10, "http://h.example/9", "<article><p>Start page Contact us Imprint and more links</p></article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert [got[i] for i in range(4)] == [b[3:-4] for b in bodies]
    assert got[9] == "" and got[10] == "Start page Contact us Imprint and more links"
    assert html_text.extract(df.limit(0)).count() == 0


def test_runs_are_those_of_the_pages():
    rng = np.random.default_rng(8)
    pages = [[f"w{i}" for i in rng.integers(0, 4, n)] for n in (30, 0, 3, 50, 5, 4, 30)]
    hashes, n_pages, places = html_text.runs(pages, 3)
    want = Counter(g for p in pages for g in {tuple(p[i : i + 3]) for i in range(len(p) - 2)})
    assert dict(zip(hashes.tolist(), n_pages.tolist())) == {html_text.run_hash(list(g)): n for g, n in want.items()}
    for p, (at, run) in zip(pages, places):
        assert at.tolist() == list(range(max(0, len(p) - 2)))
        assert hashes[run].tolist() == [html_text.run_hash(p[i : i + 3]) for i in range(len(p) - 2)]
    assert len(html_text.runs([])[0]) == 0


@pytest.mark.parametrize("slice_pages", [1, 3, 7, 2000])
def test_html_runs_are_counted_over_the_whole_host(spark, prose, slice_pages):
    notice = "This notice is on ten of the pages only"
    rows = [(i, f"http://h.example/{i}", f"<body><p>{notice if i % 6 == 0 else prose(9, 300 + i)}</p><p>{prose(30, i)}</p></body>") for i in range(60)]
    rows += [(100 + i, f"http://small.example/{i}", f"<body><p>{notice}</p><p>{prose(8, 500 + i)}</p></body>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df, slice_pages=slice_pages).collect()}
    for i, _, html in rows:
        first, second = re.findall("<p>(.*?)</p>", html)
        assert got[i] == (second if first == notice and i < 100 else f"{first}\n{second}")


def brute_article(html):
    """For pages as the given ones are: text blocks between article tags."""
    import html as entities

    body = re.sub(r"(?s)<!--.*?-->|<(script|style|nav|footer|aside|form)\b.*?</\1>|<div class=\"ad\">.*?</div>", "", re.search(r"(?s)<article>(.*)</article>", html)[1])
    blocks = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", body)
    return "\n".join(t for b in blocks if (t := re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br/?>", " ", b)))).strip()))


def test_html_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in html_text.op2_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        assert got[r["page_id"]]["text"] == brute_article(r["html"]) and got[r["page_id"]]["url"] == r["url"]
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_html_of_open_pages_by_brute_force(spark, sf):
    """The given pages with nothing but blocks: runs of five tokens that three pages of a host have go."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    pages["html"] = pages.html.str.replace(r"<(/?)(?:article|nav|footer)>", r"<\1div>", regex=True).str.replace(' class="ad"', "")
    pages["html"] = [h.replace("<body>", "<body><div>Read this small notice <b>before</b> you go on</div>" * (i % 2)) for i, h in enumerate(pages.html)]
    pages["url"] = [f"http://{'abc'[i % 3]}.example/{i}" for i in range(len(pages))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages), slice_pages=20).collect()}
    streams = {r.page_id: [b.split(" ") for _, b in html_text.parse(r.html)] for r in pages.itertuples()}
    for host in range(3):
        ids = pages.page_id[host::3].tolist()
        flat = {i: [w for b in streams[i] for w in b] for i in ids}
        # Pages of one content count once.
        n = Counter(g for f in {tuple(map(tuple, streams[i])): flat[i] for i in ids}.values() for g in {tuple(f[k : k + 5]) for k in range(len(f) - 4)})
        for i in ids:
            gone = [any(n.get(tuple(flat[i][k : k + 5]), 0) >= 3 for k in range(max(0, j - 4), j + 1) if k + 5 <= len(flat[i])) for j in range(len(flat[i]))]
            at, kept = 0, []
            for b in streams[i]:
                own, at = gone[at : at + len(b)], at + len(b)
                if all(own):
                    continue
                for m in list(re.finditer("1+", "".join("01"[g] for g in own))):
                    if m.end() - m.start() < 5:
                        own[m.start() : m.end()] = [False] * (m.end() - m.start())
                kept.append(" ".join(w for w, g in zip(b, own) if not g))
            assert got[i] == "\n".join(kept)
    assert not any("Read this small notice" in t for t in got.values()) and sum(map(bool, got.values())) == len(pages)


def test_html_of_odd_rows(spark, prose):
    long = "<article>" + "".join(f"<p>{prose(2000, i)}</p>" for i in range(50)) + "</article>"
    rows = [(1, None, None, "a", 1), (1, None, None, "a", 1), (None, "http://h.example/1", "<p>only this here text</p>", "b", 2), (2, "http://h.example/2", long, None, 3), (3, "no scheme", "", "c", None), (4, "http://h.example/3", "<p>" + "x" * 100_000, "d", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, slice long")
    got = Counter((r["page_id"], r["url"], r["text"]) for r in html_text.extract(df).collect())
    want = [(1, None, ""), (1, None, ""), (None, "http://h.example/1", "only this here text"), (2, "http://h.example/2", "\n".join(prose(2000, i) for i in range(50))), (3, "no scheme", ""), (4, "http://h.example/3", "x" * 100_000)]
    assert got == Counter(want)
    assert html_text.extract(df.limit(0)).columns == ["page_id", "url", "text"] and html_text.extract(df.limit(0)).count() == 0


# Passages


def test_every_frame_is_in_one_joined_window():
    rng = np.random.default_rng(6)
    for h in (rng.integers(0, 50, 90).astype(np.uint64), np.zeros(70, np.uint64), rng.integers(0, 2**63, 90).astype(np.uint64), np.arange(3, dtype=np.uint64)):
        width, of = 8, np.repeat([0, 1, 2], -(-len(h) // 3))[: len(h)]
        key, a, c, b = passages.joined_windows(h, of, width)
        found = Counter()
        for s in range(len(h) - width + 1):
            inside = [(int(k), int(m)) for k, i, m, j in zip(key, a, c, b) if i <= s and s + width - 1 <= j]
            assert len(inside) == (of[s] == of[s + width - 1])
            found.update((tuple(h[s : s + width].tolist()), k, m - s) for k, m in inside)
        # Equal frames have equal keys and minima.
        assert len({f for f, _, _ in found}) == len(found)


def test_windows_of_texts_are_those_of_each_alone(prose):
    texts = [prose(n, n).encode() for n in (300, 3, 49, 50, 1000)] + [b"", b" \n ", prose(60, 1).encode() * 9]
    text, *rest = passages.windows_of(texts, 46)
    for i, t in enumerate(texts):
        alone = passages.windows_of([t], 46)
        assert all((x[text == i] == y).all() for x, y in zip(rest, alone[1:]))
        assert len(alone[0]) == len(set(alone[1].tolist())) and (len(alone[0]) > 0) == (len(t.split()) >= 50)
        w = t.split()
        for a, b, word, start, stop in zip(*(x[text == i].tolist() for x in (rest[1], rest[3], rest[4], rest[5], rest[6]))):
            assert t[start:stop].split() == w[max(0, a - 56) : b + 61] and word == max(0, a - 56)
    old, passages.PIECE = passages.PIECE, 64
    assert all((x == y).all() for x, y in zip(passages.windows_of(texts, 46), (text, *rest)))
    passages.PIECE = old


def test_shared_passages_are_found(spark, prose):
    common, other = prose(70, 50), prose(60, 51)
    edited = common.split()
    edited[33] = "changed"
    texts = [prose(200, 60) + " " + common + " " + prose(100, 61), prose(40, 62) + "\n" + common.translate(SHOUT) + " " + prose(10, 63), prose(90, 64) + " " + " ".join(edited[:60]), prose(300, 65), prose(300, 65), None, "", prose(10, 66) + " " + other, other + " " + prose(500, 67), prose(400, 68), prose(20, 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in passages.near_passages(docs).collect()}
    assert len(got) == len(texts)
    assert {got[i]["class_id"] for i in (0, 1)} == {0} and {got[i]["class_id"] for i in (7, 8)} == {7}
    assert got[3]["class_id"] == got[4]["class_id"] == 3 and got[3]["n_copies"] == 2
    assert got[9]["class_id"] == 9 and got[10]["class_id"] == 10
    a, b = map(int, got[0]["passages"].split(":"))
    assert abs(a - 200) <= 1 and abs(b - 270) <= 1


def brute_passages(texts, words=50):
    """For each text the smallest place of its class: equal texts, and those of which one has a stretch of as many shingles as `words` words make, eight ninths of them in the other."""
    split = [t.translate(UPPER).split() for t in (re.sub(r"[\x09-\x0D]", " ", t) for t in texts)]
    split = [[w for w in t if w] for t in split]
    runs = [[tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in split]
    sets, holders = [set(r) for r in runs], defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = Counter((i, j) for h in holders.values() for n, j in enumerate(h) for i in h[:n])
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def near(x, y):
        same = np.concatenate([[0], np.cumsum([g in y for g in x])])
        return len(x) >= words - 4 and (9 * (same[words - 4 :] - same[: 4 - words]) >= 8 * (words - 4)).any()

    first = {}
    for i, t in enumerate(texts):
        parent[i] = first.setdefault(t, i)
    for (i, j), n in common.items():
        if n >= 40 and min(len(runs[i]), len(runs[j])) >= words - 4 and find(i) != find(j) and (near(runs[i], sets[j]) or near(runs[j], sets[i])):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_passages_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)
    want = dict(zip(docs.doc_id, docs.doc_id.to_numpy()[brute_passages(docs.text.fillna("").tolist())]))
    got = {r["doc_id"]: r for r in passages.op4_passages(spark, sf).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    size = Counter(want.values())
    assert all((r["n_links"] > 0 or r["n_copies"] > 1) == (size[r["class_id"]] > 1) for r in got.values())


@pytest.mark.parametrize(("n_stock", "whole"), [(25, 4096), (25, 4), (44, 4096), (44, 4)])
def test_passages_around_a_stock_phrase(spark, prose, n_stock, whole):
    """Pairs share a passage whose minima mostly fall into a phrase that all texts have, in few tasks and in many."""
    stock = prose(n_stock, 900)
    texts = []
    for i in range(40):
        passage = prose(3 if i % 2 else 25, 1000 + i) + " " + stock + " " + prose(25 if i % 2 else 3, 1100 + i)
        texts += [f"{prose(60, 1200 + 4 * i + j)} {passage} {prose(60, 1400 + 4 * i + j)}" for j in range(2)]
    got = {r["doc_id"]: r["class_id"] for r in passages.near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), whole=whole).collect()}
    assert got == dict(enumerate(brute_passages(texts))) and all(got[i] == i - i % 2 for i in got)


def test_functions_agree_on_all_passages_at_the_threshold():
    """Passages of 50 words with one word changed, added or missing, in other text: no pair may be lost."""
    r = random.Random(1)
    word = lambda: f"{r.getrandbits(24):06x}"
    for i in range(600):
        passage = [word() for _ in range(50)]
        edited, at = list(passage), r.randrange(50)
        edited[at : at + (i % 3 > 0)] = ["edited"] * (i % 3 < 2)
        texts = [" ".join([word() for _ in range(r.randrange(60))] + p + [word() for _ in range(r.randrange(60))]) for p in (passage, edited + ["more"])]
        x, y = (passages.shingles(t.encode()) for t in texts)
        text, key, *_ = passages.windows_of([t.encode() for t in texts], 46)
        assert set(key[text == 0].tolist()) & set(key[text == 1].tolist())
        assert passages.matched(x, y, 46)[0] or passages.matched(y, x, 46)[0] or i % 3 < 2


def test_passages_of_odd_rows(odd, none):
    rows = odd.collect()
    classes = brute_passages([r["text"] or "" for r in rows])
    least = {}
    for r, c in zip(rows, classes):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    got = Counter((r["doc_id"], r["class_id"], r["n_copies"]) for r in passages.near_passages(odd).collect())
    copies = Counter(r["text"] or "" for r in rows)
    assert got == Counter((r["doc_id"], least.get(c), copies[r["text"] or ""]) for r, c in zip(rows, classes))
    assert passages.near_passages(none).count() == 0
