"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics are computed on whole texts as bytes; trees are grown level by level
on binned statistics of a bounded labelled sample and stored flat, as complete
binary trees in arrays, so that a batch of documents walks all trees with numpy
indexing alone.

Null and empty texts have all statistics 0 and are scored like any other;
repeated rows each get a row; of several texts under one labelled id the one
with the least hash is learned, so reruns agree; a text of any length is
measured whole; without labels the score is the constant 1
(nothing is rejected); other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import labelled_sample, one_each
from ..storage import ship
from .words import byte_rows

MODULUS, HELD_OUT = 4, 2
#: Documents that the fit may use; the bound of the driver's work.
FIT_DOCS = 20_000
THRESHOLD = 0.7


def _mask(chars: bytes) -> np.ndarray:
    found = np.zeros(256)
    found[list(chars)] = 1
    return found


_CLASSES = np.stack([
    _mask(bytes(range(0x61, 0x7B))), _mask(bytes(range(0x41, 0x5B))), _mask(b"0123456789"), _mask(b" \t\n\r\x0b\x0c"),
    _mask(b".,;:?'\"()-"), _mask(b"!"), _mask(b"|"), _mask(b"#$%&*@^~<>{}[]\\/=+_`"), _mask(bytes(range(0x80, 0x100))), _mask(b"\n"),
], axis=1)
STATISTICS = [
    "lower", "upper", "digit", "space", "stop", "bang", "bar", "symbol", "beyond_ascii", "newline",
    "log_bytes", "log_words", "word_length", "distinct_words", "distinct_pairs", "adjacent_repeats", "distinct_lines", "line_words",
]


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of one whole text."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    shares = (np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ _CLASSES) / n
    words = text.split()
    m = max(1, len(words))
    lines = [line for line in text.split(b"\n") if line]
    pairs = max(1, len(words) - 1)
    return [
        *shares.tolist(), float(np.log1p(n)), float(np.log1p(len(words))), n / m, len(set(words)) / m,
        len(set(zip(words, words[1:]))) / pairs, sum(map(operator.eq, words, words[1:])) / pairs,
        len(set(lines)) / max(1, len(lines)), m / max(1, len(lines)),
    ]


@dataclass
class Forest:
    """Complete binary trees of one depth: ``feature`` and ``split`` by tree and inner node, ``value`` by tree and leaf."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of ``x``: all trees of all rows go down one level at a time."""
        z = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if trees:
            feature, split = self.feature.ravel(), self.split.ravel()
            first = np.arange(trees) * inner
            node = np.zeros((len(x), trees), dtype=np.int64)
            rows = np.arange(len(x))[:, None]
            while node[0, 0] < inner:
                at = first + node
                node = 2 * node + 1 + (x[rows, feature[at]] > split[at])
            z = z + self.value.ravel()[np.arange(trees) * self.value.shape[1] + node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: float = 1.0, ridge: float = 2.0) -> Forest:
    """Newton boosting of logistic loss on histograms of at most ``bins`` bins a statistic."""
    inner = (1 << depth) - 1
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), 30.0 if not len(y) or y.max() > 0 else -30.0)
    m = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(m) * bins
    prior = y.mean()
    z, base = np.full(len(y), np.log(prior / (1 - prior))), float(np.log(prior / (1 - prior)))
    feature, split, value = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * (m * bins) + flat).ravel()
            hg = np.bincount(cell, weights=np.repeat(g, m), minlength=width * m * bins).reshape(width, m, bins).cumsum(2)
            hh = np.bincount(cell, weights=np.repeat(h, m), minlength=width * m * bins).reshape(width, m, bins).cumsum(2)
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + ridge) + (tg - hg) ** 2 / (th - hh + ridge) - tg**2 / (th + ridge)
            gain[(hh < least) | (th - hh < least)] = -np.inf
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -np.inf
            best = gain.reshape(width, -1).argmax(1)
            top = gain.reshape(width, -1)[np.arange(width), best]
            f, b = best // bins, best % bins
            at = np.full(width, bins)
            for k in range(width):
                if top[k] > 1e-9:
                    feature[t, first + k], split[t, first + k], at[k] = f[k], edges[f[k]][b[k]], b[k]
            here = node - first
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[t, node]] > at[here])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + ridge)
        z = z + value[t][leaf]
    return Forest(feature, split, value, base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", fit_docs: int = FIT_DOCS) -> Forest:
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, MODULUS, HELD_OUT, fit_docs, id_col, text)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(raw) for raw in byte_rows(batch.column("t"))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("h"), batch.column("y"), x], names=["id", "h", "y", "x"])

    rows = one_each(sample.mapInArrow(measured, "id string, h long, y int, x array<double>"), "y", "x").toArrow().sort_by("id")
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
    return fit(x, (np.array(rows.column("y").to_pylist(), dtype=float) > 0).astype(float))


def score_texts(docs: DataFrame, model: Forest, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_col, score)`` of every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([statistics(raw) for raw in byte_rows(batch.column("t"))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.score(x))], names=["id", "score"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
