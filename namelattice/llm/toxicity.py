"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its distinct words and their leading 3 to 6 bytes (a
plain stem, so that inflected insults share a term), each hashed into a fixed
number of buckets.  The score is the logistic of bias, linear weights and all
pairwise interactions of the terms, the latter through low-rank factors, so a
pair can matter where neither term does.  Terms that too few fitted documents
hold keep zero weights.

Texts are cut, hashed and scored many at a time: Arrow finds the distinct words
of a step, numpy hashes them byte by byte, all words at once.

Null and empty texts have no terms and score the bias; repeated rows each get
a row; of several texts under one labelled id the one with the least hash is
learned, so reruns agree; a text of any length is one document, and a step of
its own if it is longer than a step; without labels the score is the constant
prior 0 (nothing is toxic); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .caches import keep_only
from .labelled import labelled_sample, one_each
from .tokens import steps
from ..storage import ship
from .words import separated

BITS = 20
MODULUS, HELD_OUT = 5, 0
#: Documents that the fit may use; the bound of the driver's work.
FIT_DOCS = 16_000
THRESHOLD = 0.5
#: Bytes of stems, bytes of text in a step, and bytes of words that are hashed byte by byte.
STEMS, STEP, SHORT = (3, 4, 5, 6), 4 << 20, 48

_U = np.uint64
_PRIME, _SALT = _U(0x100000001B3), _U(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> _U(31))) * _SALT) >> _U(64 - BITS)).astype(np.int32)


def word_terms(words: pa.Array) -> np.ndarray:
    """Buckets of words and their stems, a row a word; -1 where a word is too short for a stem, or empty."""
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(offsets)
    out = np.full((len(words), 1 + len(STEMS)), -1, dtype=np.int32)
    h = np.full(len(words), 0xCBF29CE484222325, dtype=_U)
    # Words in the order of their length, so that those still running are the last ones.
    order = np.argsort(size, kind="stable")
    first = np.searchsorted(size[order], np.arange(SHORT + 1), side="right")
    for at in range(int(min(size.max(initial=0), SHORT))):
        run = order[first[at] :]
        h[run] = (h[run] ^ data[offsets[run] + at]) * _PRIME
        if at + 1 in STEMS:
            longer = order[first[at + 1] :]
            out[longer, 1 + STEMS.index(at + 1)] = _bucket(h[longer] + _U(int(_SALT) * (at + 1) % 2**64))
    for i in order[first[SHORT] :]:
        h[i] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes())
    named = size > 0
    out[named, 0] = _bucket(h[named])
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """The values of ``x``, ascending, each once; sorting beats the hash table of ``np.unique`` many times over."""
    x = np.sort(x)
    return x[np.flatnonzero(np.diff(x, prepend=x[0] - 1))] if len(x) else x


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each whole text, ascending, one text behind the other, and where each text's end."""
    lists = pc.ascii_split_whitespace(separated(texts))
    words = lists.flatten().dictionary_encode()
    n = np.diff(lists.offsets.to_numpy())
    if not len(words):
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    known = max(1, len(words.dictionary))
    pairs = _distinct(np.repeat(np.arange(len(texts), dtype=np.int64), n) * known + words.indices.to_numpy())
    doc, found = pairs // known, word_terms(words.dictionary)[pairs % known]
    held = found >= 0
    keys = _distinct((doc[:, None] << BITS | np.where(held, found, 0))[held])
    return (keys & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(keys, np.arange(1, len(texts) + 1) << BITS)


def term_ids(text: bytes) -> np.ndarray:
    """The distinct buckets of one text, ascending."""
    return terms(pa.array([text], pa.binary()).cast(pa.string()))[0]


@dataclass
class FactorizationMachine:
    """``row`` maps buckets to rows of ``weights`` and ``factors``; -1 for terms without weight."""

    row: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of the texts whose terms are ``flat[ends[i - 1]:ends[i]]``."""
        n = len(ends)
        rows = self.row[flat]
        doc = np.repeat(np.arange(n), np.diff(ends, prepend=0))[rows >= 0]
        rows = rows[rows >= 0]
        v = self.factors[rows]
        total = np.stack([np.bincount(doc, weights=v[:, j], minlength=n) for j in range(v.shape[1])], axis=1)
        square = np.bincount(doc, weights=np.einsum("ij,ij->i", v, v, dtype=float), minlength=n)
        # Pairs count by their mean over the text's terms, or long texts would drown in them.
        pairs = 0.5 * ((total**2).sum(1) - square) / np.maximum(np.bincount(doc, minlength=n), 1)
        z = self.bias + np.bincount(doc, weights=self.weights[rows], minlength=n) + pairs
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def score(self, ids: np.ndarray) -> float:
        return float(self.scores(ids, np.array([len(ids)]))[0])


def fit(flat: np.ndarray, ends: np.ndarray, y: np.ndarray, rank: int = 4, epochs: int = 4, batch: int = 128, min_docs: int = 8, rate: float = 0.5, l1: float = 3e-4, l2: float = 1e-5, start: float = 1e-4, least_steps: int = 500, seed: int = 7) -> FactorizationMachine:
    """Stochastic gradient descent with AdaGrad steps; ``l1`` pulls linear weights and ``l2`` factors to zero.

    Document i has the terms ``flat[ends[i - 1]:ends[i]]``.  Small samples are
    gone through more often than ``epochs``, up to ``least_steps`` batches.
    """
    size = 1 << BITS
    if not len(y) or not y.any():
        return FactorizationMachine(np.full(size, -1, np.int32), -30.0, np.zeros(0, np.float32), np.zeros((0, rank), np.float32))
    counts = np.zeros(size, dtype=np.int32)
    for at in range(0, len(flat), 1 << 20):  # in parts, as counting makes a wider copy
        counts += np.bincount(flat[at : at + (1 << 20)], minlength=size).astype(np.int32)
    row = np.full(size, -1, dtype=np.int32)
    kept = np.flatnonzero(counts >= min_docs)
    row[kept] = np.arange(len(kept))
    flat = row[flat]
    known = flat >= 0
    ends = np.concatenate([[0], np.cumsum(known)])[ends].astype(np.int64)
    flat = flat[known]
    del known
    begins = np.concatenate([[0], ends[:-1]])
    used = np.flatnonzero(ends > begins)
    rng = np.random.default_rng(seed)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias, w = float(np.log(prior / (1 - prior))), np.zeros(len(kept), dtype=np.float32)
    v = rng.normal(0, 1e-2, (len(kept), rank)).astype(np.float32)
    gw, gv = np.full(len(kept), start, dtype=np.float32), np.full((len(kept), rank), 0.01 * start, dtype=np.float32)
    for _ in range(max(epochs, -(-least_steps * batch // max(1, len(used))))):
        order = rng.permutation(used)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = ends[pick] - begins[pick]
            ids, owner = np.concatenate([flat[begins[i] : ends[i]] for i in pick]), np.repeat(np.arange(len(pick)), sizes)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vi = v[ids]
            total = np.add.reduceat(vi, first)
            share = (1.0 / sizes).astype(np.float32)
            z = bias + np.add.reduceat(w[ids], first) + 0.5 * share * ((total**2).sum(1) - np.add.reduceat((vi**2).sum(1), first))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]).astype(np.float32)
            by_id = np.argsort(ids, kind="stable")
            ids = ids[by_id]
            starts = np.flatnonzero(np.diff(ids, prepend=-1))
            uniq = ids[starts]
            dw = np.add.reduceat(g[owner[by_id]], starts) / len(pick)
            dv = np.add.reduceat(((g * share)[owner, None] * (total[owner] - vi))[by_id], starts) / len(pick) + l2 * v[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            step = rate / np.sqrt(gw[uniq])
            moved = w[uniq] - step * dw
            w[uniq] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            v[uniq] -= 0.2 * rate / np.sqrt(gv[uniq]) * dv
            bias -= 0.2 * rate * float(g.mean())
    return FactorizationMachine(row, bias, w, v)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", fit_docs: int = FIT_DOCS) -> FactorizationMachine:
    """Fit on a bounded sample; the driver holds its term numbers once, as one array."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, MODULUS, HELD_OUT, fit_docs, id_col, text)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("toxicity")
        for batch in batches:
            for start, stop in steps(batch.column("t"), STEP):
                rows = batch.slice(start, stop - start)
                flat, ends = terms(rows.column("t"))
                ids = pa.array([flat[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("id").cast(pa.string()), rows.column("h"), rows.column("y"), ids], names=["id", "h", "y", "ids"])

    table = one_each(sample.mapInArrow(hashed, "id string, h long, y int, ids binary"), "y", "ids").toArrow().sort_by("id").combine_chunks()
    y = (np.array(table.column("y").to_pylist(), dtype=float) > 0).astype(float)
    if not len(y):
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int64), y)
    column = table.column("ids").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    flat = np.frombuffer(column.buffers()[2], dtype=np.int32)[offsets[0] : offsets[-1]]
    return fit(flat, offsets[1:] - offsets[0], y)


def _scored(texts: pa.Array, model: FactorizationMachine) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(model.scores(*terms(texts.slice(start, stop - start))) for start, stop in steps(texts, STEP))])


def score_texts(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_col, score)`` of every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("toxicity")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_scored(batch.column("t"), shared.value))], names=["id", "score"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: FactorizationMachine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores below ``threshold``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("toxicity")
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch.column(text), shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
