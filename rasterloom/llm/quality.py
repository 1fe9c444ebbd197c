"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree at a time to one binned feature, so all trees of a feature add up to a lookup
table over its bins; the strongest pairs of features get tables over coarse grids in the same way. A score is the
logistic function of a sum of table entries. Features come from the text alone, in one pass over the documents; the
model is fitted on the driver from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_keys, stored, table

FEATURES = ("log_bytes", "log_words", "upper", "digits", "marks", "pipes", "bangs", "stops", "blanks", "high", "word_bytes", "distinct", "log_lines", "distinct_lines", "ends")
#: At most so many labelled rows, those of smallest hash, train the model.
MAX_TRAIN = 20_000
BINS, GRID, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, RIDGE = 48, 8, 160, 6, 60, 0.12, 2.0
THRESHOLD = 0.3


def features(text: bytes) -> list[float]:
    """Of an empty text: zeros, and shares of 1 for what is distinct."""
    n = max(len(text), 1)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    letters = max(int(c[65:91].sum() + c[97:123].sum()), 1)
    marks = sum(int(c[x]) for x in b"#$%&*")
    ends = sum(x[-1:] in (b".", b"!", b"?") for x in lines)
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), c[65:91].sum() / letters, c[48:58].sum() / n, marks / n, c[124] / n, c[33] / n, (c[46] + c[44]) / n,
        (c[32] + c[9] + c[10]) / n, c[128:].sum() / n, (n - len(words)) / max(len(words), 1) if words else 0.0, len(set(words)) / len(words) if words else 1.0,
        float(np.log1p(len(lines))), len(set(lines)) / len(lines), ends / len(lines),
    ]


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, a, b, values in self.pairs:
            total += values[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def _cuts(x: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The values by bin of a tree over ordered bins with gradient sums g and weights h."""
    parts = [(0, len(g))]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        gain = cg[:-1] ** 2 / (ch[:-1] + RIDGE) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + RIDGE) - cg[-1] ** 2 / (ch[-1] + RIDGE)
        return float(gain.max()), a + int(gain.argmax()) + 1

    while len(parts) < leaves:
        gain, cut, part = max((*best(*p), p) for p in parts)
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values by cell of the best tree that cuts each of two features once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 1e-9, np.zeros_like(g)
    rows, cols = g.shape
    if rows < 2 or cols < 2:
        return out

    def corners(c: np.ndarray) -> list[np.ndarray]:
        nw, n, w, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [nw, n - nw, w - nw, all_ - n - w + nw]

    gain = sum(a**2 / (b + RIDGE) for a, b in zip(corners(cg), corners(ch)))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[i, j] > best:
        for r in (slice(0, i + 1), slice(i + 1, rows)):
            for s in (slice(0, j + 1), slice(j + 1, cols)):
                out[r, s] = g[r, s].sum() / (h[r, s].sum() + RIDGE)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Without rows every score is 0.5; with labels of one kind it is that kind's smoothed share."""
    if not len(y):
        return Model()
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))))
    if share * (len(y) + 1) in (0.5, len(y) + 0.5):
        return model
    model.edges = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, values in zip(bins, model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(values)), np.bincount(b, h, len(values)))
            values += step
            total += step[b]
    grids = [_cuts(x[:, j], GRID) for j in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(grids)]
    g, h = slopes()

    def sums(i: int, j: int, of: np.ndarray) -> np.ndarray:
        shape = len(grids[i]) + 1, len(grids[j]) + 1
        return np.bincount(cells[i] * shape[1] + cells[j], of, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((-float((sums(i, j, g) ** 2 / (sums(i, j, h) + RIDGE)).sum()), i, j) for i in range(len(grids)) for j in range(i)))
    chosen = [(i, j, np.zeros((len(grids[i]) + 1, len(grids[j]) + 1))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, values in chosen:
            g, h = slopes()
            step = RATE * _quadrants(sums(i, j, g), sums(i, j, h))
            values += step
            total += step[cells[i], cells[j]]
    model.pairs = [(i, j, grids[i], grids[j], v) for i, j, v in chosen]
    return model


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, features array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = pa.array([features((x.as_py() or "").encode()) for x in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), f], ["doc_id", "k1", "k2", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return row_keys(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, features array<double>")


def held_out(doc_id):
    """A fifth of the documents by CRC-32 of the identifier as text; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(rows: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Model:
    """Fits the model to labelled rows(doc_id, features) that aren't held out, at most max_rows of them, those of smallest hash. Of repeated labels the larger half decides; null labels don't count."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id")))
    got = rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", F.col("features")).select("features", "label").limit(max_rows).toPandas()
    x = np.array(got.features.tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got.label.to_numpy(np.float64))


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, k1, k2, held_out, score, predicted) for each row of docs(doc_id, text).

    Null and empty texts are scored by the features of an empty text. Rows that repeat get the same score. Without
    usable labels every score is 0.5. A score of just the threshold is predicted 1. Very long texts are measured whole, one
    at a time. Other columns are ignored; an empty table gives none.
    """
    rows = stored(feature_table(docs), "features")
    model = docs.sparkSession.sparkContext.broadcast(train(rows, labels, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(model.value.score(x))], ["doc_id", "k1", "k2", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, score double")
    return scored.select("doc_id", "k1", "k2", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """op9: a quality score for every document."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
