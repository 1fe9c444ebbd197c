"""Alignment of two tokenizers against a plain version of it that compares all byte ranges."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rasterloom.llm import alignment
from rasterloom.sources import tables


@pytest.fixture(scope="module")
def plain():
    """plain(texts): (tokens with byte ranges of A, of B) by the vocabulary files' own libraries."""
    a, b = Tokenizer.from_file(alignment.A_FILE), sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()

    def ranges(ids, raw):
        out, at = [], 0
        for i, x in zip(ids, raw):
            out.append((i, at, at + len(x)))
            at += len(x)
        return out, b"".join(raw)

    def one(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        x, raw_a = ranges(ids, [bytes(letters[c] for c in a.id_to_token(i)) for i in ids])
        ids = b.encode(text)
        y, raw_b = ranges(ids, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids])
        return (x, y) if raw_a == raw_b == b" " + text.encode() else ([], [])

    return one


def brute(plain, rows):
    """Rows of op13 for (doc_id, text)."""
    found, docs = [], defaultdict(set)
    for n, (i, text) in enumerate(rows):
        x, y = plain(text)
        links, k = [], 0
        for p, s, e in x:
            while k and y[k - 1][2] > s:
                k -= 1
            while k < len(y) and y[k][1] < e:
                if y[k][2] > s:
                    links.append((p, y[k][0]))
                k += 1
        ends = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups = ";".join("|".join(",".join(str(q) for q, _, e in side if s < e <= t) for side in (x, y)) for s, t in zip([0, *ends], ends)) if len(x) < 3000 else None
        for p in set(links):
            docs[p].add(n)
        found.append((i, x, y, ends, links, groups))
    best = Counter()
    for (p, _), d in docs.items():
        best[p] = max(best[p], len(d))
    out = Counter()
    for i, x, y, ends, links, groups in found:
        digest = "" if not x else None if groups is None else hashlib.sha256(groups.encode()).hexdigest()
        out[(i, len(x), len(y), len(ends), len(links), sum(len(docs[q]) == best[q[0]] for q in links), sum(len(docs[q]) for q in links), digest)] += 1
    return out


def got(docs, **more):
    return Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in alignment.align_documents(docs, **more).collect())


def without_long(rows, long):
    """The digest of groups isn't compared for texts that the plain version is too slow for."""
    out = Counter()
    for r, n in rows.items():
        out[(*r[:-1], None if r[1] >= long else r[-1])] += n
    return out


@pytest.mark.parametrize("near", [alignment.NEAR_PAIRS, 40, 0])
def test_alignment_of_odd_rows(spark, odd, none, plain, near):
    texts = ["▁ piece sign", "<|endoftext|> <s> </s> <unk> <0x0A>", "  two  spaces  ", "tab\tand\r\nlines\n\n\nend ", "日本語のテキスト 漢字 かな", "🙂🙂 é  x　y​", "a" * 5000, " " * 3000, "don't we'll I'd 12345 3.14159", "\x00\x01"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = odd.select("doc_id", "text", "k1", "digest").unionByName(more, allowMissingColumns=True).repartition(3)
    want = brute(plain, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert without_long(got(docs, near_pairs=near), 3000) == without_long(want, 3000)
    assert got(none) == Counter()


def test_query_on_given_documents(spark, sf, plain):
    rows = [(r["doc_id"], r["text"]) for r in tables.read(spark, sf, "documents").collect()]
    mine = Counter(tuple(r) for r in alignment.op13_alignment(spark, sf).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert without_long(mine, 3000) == without_long(brute(plain, rows), 3000)


def test_windows_are_kept_by_ids_and_change_nothing(plain):
    """Any order of texts, with any room for alignments, gives each the same; common windows are aligned once."""
    r = random.Random(5)
    words = ["the", "of", "Straße", "naïve", "don't", "x=1;", "日本", "qzxv", "\n", "a\tb", ""]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(80)]
    tools = alignment.tokenizers(alignment.A_FILE, alignment.B_FILE)
    wide, narrow = alignment.Aligner(*tools), alignment.Aligner(*tools, memo=3)
    whole = wide.align(texts)
    for text, x in zip(texts, whole):
        (y,) = narrow.align([text])
        assert (x.n_a, x.n_b, x.n_groups, x.groups) == (y.n_a, y.n_b, y.n_groups, y.groups)
        assert np.array_equal(x.pairs, y.pairs) and np.array_equal(x.times, y.times)
        assert (x.n_a, x.n_b) == tuple(map(len, plain(text)))
    assert wide.aligned * 3 < wide.looked


def test_same_tokens_as_the_files_own_model():
    """The byte-level vocabulary is read by another library than the one whose format it has."""
    own = Tokenizer.from_file(alignment.A_FILE)
    own.encode_special_tokens = True
    a = alignment.ByteLevel(alignment.A_FILE)
    r = random.Random(8)
    texts = ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(0x80, 0x2FF), r.randrange(0x300, 0xD7FF), r.randrange(0xE000, 0x1FFFF), 32, 10))) for _ in range(r.randrange(0, 80))) for _ in range(3000)]
    assert a.encode(texts) == [e.ids for e in own.encode_batch([" " + x for x in texts], add_special_tokens=False)]
