"""Secret scans: patterns, and a battery of randomness tests on other long tokens.

Every token of 20 or more signs that no pattern covers is a candidate. The smallest alphabet with all its signs is its
encoding. Three tests look at it: chi-squared uniformity over the alphabet (vowels, common and rare consonants of
either case, digits and marks as bins), runs (how often vowels and other signs follow one another), and lag-1 serial
correlation of the signs' places in the alphabet.

A secret is what is random, so the hypothesis that discoveries must reject is the other one: that a token is as far from
random as writing is. For that each test has an effect size (fixed below): the chi-squared statistic of writing is
non-central with n times the effect, vowels change at a rate, and ordered signs correlate. The p-values of the first
two are combined by Fisher's method, and the larger of that and the third is the battery's. Tokens that a test rejects
as random at 0.001 are no candidates for discovery. In each length class (20 to 31 signs, 32 to 63, and so on by
doubling) of the whole corpus Benjamini-Hochberg holds the share of false discoveries among the battery's p-values; the
non-central statistic and the number of changes grow with the length, so short tokens need to look more random than
long ones. Histograms of p-values, a few thousand numbers, are all that is gathered.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KEYWORDS = ("passw", "secret", "token", "api")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: The smallest alphabet that has all signs of a token is its encoding: decimal, hexadecimal, letters, base 32, 36, 52, 62, 64.
ALPHABETS = (DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER, UPPER + LOWER, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_", UPPER + LOWER + DIGITS + "+/-_")
PLACES = [{c: i for i, c in enumerate(a)} for a in ALPHABETS]
VOWELS, COMMON = frozenset("aeiouAEIOU"), frozenset("dhlnrstDHLNRST")
#: How far writing is from random: the squared effect of the chi-squared test by encoding (letters alone; with digits or marks; digits alone), the rate at which vowels change, the correlation of ordered signs.
EFFECT_LETTERS, EFFECT_MIXED, EFFECT_DIGITS, CHANGES, ORDERED = 0.45, 0.9, 1.0, 0.55, 0.8
RANDOM_LEVEL, FDR, STEPS = 0.001, 0.01, 40


def _bin(sign: str) -> int:
    """Vowels, common and rare consonants by case; digits in two halves; marks."""
    if sign.isdigit():
        return 6 + (sign > "4")
    return 8 if not sign.isalpha() else 3 * sign.isupper() + (0 if sign in VOWELS else 1 if sign in COMMON else 2)


BINS = [{c: _bin(c) for c in a} for a in ALPHABETS]
#: For each alphabet, the chance of each bin.
CHANCES = [{b: sum(x == b for x in of.values()) / len(of) for b in set(of.values())} for of in BINS]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns."""
    out = []
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    if any(k in low for k in KEYWORDS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text)]
    out += [(2, *m.span()) for m in HEX.finditer(text)]
    return out


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi2_cdf(x: float, k: float, effect: float = 0.0) -> float:
    """The chance of a chi-squared value up to x with k degrees of freedom, non-central by effect: Sankaran's approximation, which is Wilson and Hilferty's where effect is 0."""
    if x <= 0:
        return 0.0
    m = k + effect
    h = 1 - 2 * m * (k + 3 * effect) / (3 * (k + 2 * effect) ** 2)
    p = (k + 2 * effect) / m**2
    q = (h - 1) * (1 - 3 * h)
    return _normal(((x / m) ** h - 1 - h * p * (h - 1 - 0.5 * (2 - h) * q * p)) / (h * math.sqrt(2 * p) * (1 + 0.5 * q * p)))


def _binomial(x: int, n: int, p: float) -> float:
    """The chance of up to x of n."""
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(x + 1)))


def encoding(token: str) -> int | None:
    return next((i for i, p in enumerate(PLACES) if all(c in p for c in token)), None)


def battery(token: str) -> tuple[float, float]:
    """(random, written): the smallest p-value by which a test rejects that the token is random, and the battery's p-value against being written; (0, 1) if no alphabet has the token."""
    signs = token.rstrip("=")
    of, n = encoding(signs), len(signs)
    if of is None or n < 8:
        return 0.0, 1.0
    x, a = [PLACES[of][c] for c in signs], len(PLACES[of])
    # Uniformity.
    seen = Counter(BINS[of][c] for c in signs)
    chi = sum((seen[b] - n * p) ** 2 / (n * p) for b, p in CHANCES[of].items())
    k = len(CHANCES[of]) - 1
    effect = EFFECT_DIGITS if a == 10 else EFFECT_LETTERS if ALPHABETS[of].isalpha() and a == 26 else EFFECT_MIXED
    uniform, far = 1 - chi2_cdf(chi, k), chi2_cdf(chi, k, n * effect)
    # Runs: of vowels and others, or without letters of the halves of the alphabet.
    high = [c in VOWELS for c in signs] if a > 16 else [2 * i >= a for i in x]
    rate = sum(c in VOWELS for c in ALPHABETS[of]) / a if a > 16 else 0.5
    changes = sum(p != q for p, q in zip(high, high[1:]))
    mean, spread = 2 * rate * (1 - rate) * (n - 1), math.sqrt(2 * rate * (1 - rate) * (1 - 2 * rate * (1 - rate)) * (n - 1))
    by_runs = math.erfc(abs(changes - mean) / spread / math.sqrt(2))
    lively = _binomial(changes, n - 1, CHANGES) if a > 16 else None
    # Serial correlation.
    m = sum(x) / n
    var = sum((i - m) ** 2 for i in x)
    r = sum((p - m) * (q - m) for p, q in zip(x, x[1:])) / var if var else 1.0
    serial, ordered = math.erfc(abs(r) * math.sqrt(n) / math.sqrt(2)), _normal((math.atanh(min(abs(r), 1 - 1e-9)) - math.atanh(ORDERED)) * math.sqrt(n - 3))
    half = -sum(math.log(max(p, 1e-300)) for p in (far, lively if lively is not None else 1.0))
    both = math.exp(-half) * (1 + half) if lively is not None else far
    return min(uniform, by_runs, serial), max(both, ordered)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, step): step is -STEPS log10 of the battery's p-value, -1 if a test says not random."""
    out = []
    # The base spans by start, and how far those up to each reach.
    starts = sorted(a for _, a, _ in base)
    reach = list(accumulate((b for _, _, b in sorted(base, key=lambda s: s[1])), max))
    for m in TOKEN.finditer(text):
        before = bisect_left(starts, m.end())
        if not (before and reach[before - 1] > m.start()):
            random, written = battery(m[0])
            out.append((*m.span(), len(m[0]).bit_length(), -1 if random < RANDOM_LEVEL else int(-STEPS * math.log10(max(written, 1e-300)))))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found): base spans and candidates of each row of docs(doc_id, text)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    more = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("size", pa.int32()), ("step", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                spans = base_spans(text)
                base.append([{"start": a, "kind": k, "end": b} for k, a, b in sorted(spans, key=lambda s: (s[1], s[0]))])
                found.append([dict(zip(("start", "end", "size", "step"), c)) for c in candidates(text, spans)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(found, more)], ["doc_id", "base", "found"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,size:int,step:int>>")


def thresholds(rows: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """By length class, the least step whose tokens are discoveries."""
    tested = rows.select(F.inline("found")).groupBy("size", "step").count().collect()  # a few classes, one for each doubling of the length, of 12001 steps
    out = {}
    for size in {r["size"] for r in tested}:
        steps = sorted(((r["step"], r["count"]) for r in tested if r["size"] == size), reverse=True)
        m, so_far = sum(n for _, n in steps), 0
        for step, n in steps:
            so_far += n
            if step >= 0 and 10 ** (-step / STEPS) <= fdr * so_far / m:
                out[size] = step
    return out


def secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, base, added) for each row of docs(doc_id, text): arrays of (start, kind, end) in code points, in order.

    A null text counts as empty; very long texts are scanned whole. Rows that repeat are scanned alike, and each counts
    in the control; tokens of one p-value are found or left together. Other columns are ignored; an empty table gives
    none. added holds the tokens that the tests find; they don't overlap base spans.
    """
    rows = stored(scan(docs), "spans")
    least = thresholds(rows, fdr)
    by_size = F.create_map(*[F.lit(x) for kv in (least or {0: 1 << 30}).items() for x in kv])
    hit = F.filter("found", lambda c: c["step"] >= F.coalesce(F.try_element_at(by_size, c["size"]), F.lit(1 << 30)))
    added = F.transform(hit, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return rows.select("doc_id", "base", added.alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """op7: secrets in every whole text of documents."""
    out = secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{KINDS[i]}") for i in range(3)]
    return out.select("doc_id", *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
