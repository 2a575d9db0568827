"""Operator 3: a quality classifier as a generalised additive model with pairwise interactions.

Shallow trees, boosted one feature after the other in cycles, add up to one
lookup table per feature; a second run of cycles does the same for the most
telling pairs of features. A text is scored by adding table cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import bodies, in_arrow

SAMPLE = 20_000  # labelled rows that the fit sees at most; everything is scored
BINS = 32
PAIR_BINS = 8
CYCLES = 150
PAIR_CYCLES = 60
PAIRS = 10
RATE = 0.08
LEAVES = 4
SHRINK = 5.0  # added to the second derivatives of a leaf
THRESHOLD = 0.3

NAMES = ("bytes", "words", "word_bytes", "upper", "digits", "stops", "bangs", "symbols", "space", "newlines", "distinct_words",
         "repeated_words", "distinct_lines", "line_bytes", "beyond_ascii", "controls", "capital_words")

# The class of each byte: 0 lower, 1 upper, 2 digit, 3 stop, 4 bang, 5 other symbol, 6 space, 7 newline, 8 beyond ASCII, 9 control.
_CLASS = np.array([
    8 if b >= 128 else 7 if b == 10 else 6 if b in (9, 13, 32) else 9 if b < 32 or b == 127 else 2 if chr(b).isdigit()
    else 1 if chr(b).isupper() else 0 if chr(b).islower() else 3 if chr(b) in ".,;:" else 4 if chr(b) in "!?" else 5
    for b in range(256)])


def features(body: bytes) -> list[float]:
    """The inputs of a score, from the whole text alone; an empty text has zeros."""
    n = len(body)
    share = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(body, np.uint8), minlength=256), minlength=10) / max(n, 1)
    words, lines = body.split(), body.split(b"\n")
    count = max(len(words), 1)
    return [
        math.log1p(n), math.log1p(len(words)), n / count, share[1], share[2], share[3], share[4], share[5], share[6], share[7],
        len(set(words)) / count, sum(map(eq, words, words[1:])) / count, len(set(lines)) / len(lines), math.log1p(n / len(lines)),
        share[8], share[9], sum(map(bytes.isupper, words)) / count]


@dataclass
class Model:
    """Bin edges and lookup tables, in log-odds."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values of a tree over ordered bins that always splits the leaf with the largest gain."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + SHRINK)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                best = max(best, (float(gain.max()), int(at[gain.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + SHRINK)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts each of two features once."""
    zero = ((1, 0), (1, 0))
    cg, ch = np.pad(g, zero).cumsum(0).cumsum(1), np.pad(h, zero).cumsum(0).cumsum(1)

    def parts(c):
        low = c[1:-1, 1:-1]
        right, down = c[1:-1, -1:] - low, c[-1:, 1:-1] - low
        return np.stack([low, right, down, c[-1, -1] - low - right - down])

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    pg, ph = parts(cg), parts(ch) + SHRINK
    gain = (pg**2 / ph).sum(0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    values = -pg[:, i, j] / ph[:, i, j]
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = values
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits the tables; without both classes among the labels the score is a smoothed share."""
    model = Model(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(y) == 0 or y.min() == y.max():
        return model
    k = x.shape[1]
    model.edges = [_edges(x[:, i], BINS) for i in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(CYCLES):
        for i in range(k):
            g, h = slopes()
            n = len(model.tables[i])
            step = RATE * _tree(np.bincount(at[i], g, n), np.bincount(at[i], h, n), LEAVES)
            model.tables[i] += step
            total += step[at[i]]

    model.pair_edges = [_edges(x[:, i], PAIR_BINS) for i in range(k)]
    near = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.pair_edges)]
    size = [len(e) + 1 for e in model.pair_edges]

    def grid(i, j):
        g, h = slopes()
        cell = near[i] * size[j] + near[j]
        return cell, _quadrants(*(np.bincount(cell, v, size[i] * size[j]).reshape(size[i], size[j]) for v in (g, h)))

    ranked = sorted(((grid(i, j)[1][0], i, j) for i in range(k) for j in range(i)), reverse=True)[:PAIRS]
    tables = {(i, j): np.zeros((size[i], size[j])) for gain, i, j in ranked if gain > 0}
    for _ in range(PAIR_CYCLES):
        for (i, j), own in tables.items():
            cell, (_, step) = grid(i, j)
            own += RATE * step
            total += RATE * step.ravel()[cell]
    model.pairs = [(i, j, own) for (i, j), own in tables.items()]
    return model


def held_out(id_col: str = "doc_id"):
    """True for the rows that no model learns from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _vectors(bodies_: list[bytes]) -> np.ndarray:
    return np.array([features(b) for b in bodies_], np.float64).reshape(-1, len(NAMES))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents, those of the smallest id hashes, none held out.

    Labels without id or value are left out, several of one document are
    averaged, a repeated doc_id counts once.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter(
        ~held_out()).dropna().groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            x = _vectors(batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    known = bodies(docs).join(F.broadcast(chosen), "doc_id")
    rows = in_arrow(known.select("doc_id", "y", "body"), run, "doc_id long, y int, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit(np.array([r["x"] for r in rows], np.float64).reshape(-1, len(NAMES)), np.array([r["y"] for r in rows], np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null texts count as empty; empty texts are scored like any other. Repeated
    rows get equal scores; a null doc_id is kept and not held out. Without
    labels of both kinds the score is their smoothed share (0.5 without any).
    Other columns are not read; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches):
        for batch in batches:
            score = model.value.score(_vectors(batch.column("body").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    held = bodies(docs).withColumn("held_out", held_out())
    return in_arrow(held, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score at least ``threshold``.

    A null text is scored as an empty one, repeated rows share their score, an
    empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(model.value.score(_vectors(texts)) >= threshold))

    return in_arrow(docs, run, docs.schema)
