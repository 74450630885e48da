"""Language of whole texts: known words first, shorter and shorter character n-grams for the rest.

A text is its runs of letters and marks, lower-cased.  A word that the word
table holds adds its log frequency in each language.  Any other word is put
between spaces, and at each of its characters the longest known n-gram that
begins there counts, ``LONGEST`` characters at most; the word adds their mean.
The sums, as softmax, are the score.

Frequencies are counted by Spark on at most about ``fit_docs`` labelled documents
of each language, drawn by the hash of their ids, so that a rare language is
learned whole; at most ``MOST_LANGUAGES`` languages, the most frequent, are learned.
Each table holds the most frequent entries, ``cells`` numbers at most.  Words and
n-grams are 64-bit hashes of their characters.

Null texts and texts without a letter are ``und`` with score 0, and so is any
text where nothing was learned.  A text of letters never seen takes the most
frequent language, all being equal.  Rows with a null id or null language aren't learned;
repeated rows each count and each get a row; texts of any length are read whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .labelled import id_remainder
from .tokens import steps
from ..storage import ship, stored

MODULUS, HELD_OUT = 4, 2
#: Documents of a language that the fit may use, about; languages; numbers in a table; characters of the longest n-gram.
FIT_DOCS, MOST_LANGUAGES, CELLS, LONGEST = 5_000, 200, 400_000, 5
UNKNOWN = "und"
#: Added to each count.
SMOOTHING = 0.5
_SPACE = 0x20
_POWERS = np.multiply.accumulate(np.full(1 << 10, 0x9E3779B97F4A7C15, dtype=np.uint64))


def words_in(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased runs of letters and marks of all texts, and the text of each."""
    bare = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " ")
    lists = pc.ascii_split_whitespace(bare)
    words, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full).dictionary_encode(), of[full.to_numpy(zero_copy_only=False)]


@dataclass
class Spelled:
    """Distinct words between spaces as code points, one behind the other."""

    codes: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(words: pa.Array) -> "Spelled":
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        codes = np.frombuffer("".join(f" {w} " for w in words.to_pylist()).encode("utf-32-le"), dtype="<u4")
        return Spelled(codes, sizes)

    @property
    def word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def whole(self) -> np.ndarray:
        """The hash of each word; characters that are 1,024 apart share a factor."""
        starts = np.cumsum(self.sizes) - self.sizes
        depth = (np.arange(len(self.codes)) - np.repeat(starts, self.sizes)) % len(_POWERS)
        terms = (self.codes.astype(np.uint64) + np.uint64(1)) * _POWERS[depth]
        return np.add.reduceat(terms, starts) if len(starts) else np.zeros(0, np.uint64)

    def grams(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places ``at`` where an n-gram of the word begins, and their hashes; a space alone is none."""
        ends = np.repeat(np.cumsum(self.sizes), self.sizes)
        at = at[at + n <= ends[at]]
        if n == 1:
            at = at[self.codes[at] != _SPACE]
        h = np.full(len(at), n, dtype=np.uint64)
        for i in range(n):
            h += (self.codes[at + i].astype(np.uint64) + np.uint64(1)) * _POWERS[i]
        return at, h


@dataclass
class Model:
    """Languages, the most frequent first; by level (0 is words, n is n-grams) the sorted hashes and the log frequency of each by language."""

    languages: list[str]
    hashes: list[np.ndarray]
    scores: list[np.ndarray]

    def _found(self, level: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is known, and where."""
        known = self.hashes[level]
        if not len(known):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return known[at] == hashes, at

    def of_words(self, words: pa.Array) -> np.ndarray:
        """What each distinct word adds, by language."""
        out = np.zeros((len(words), len(self.languages)))
        spelled = Spelled.of(words)
        hit, at = self._found(0, spelled.whole())
        out[hit] = self.scores[0][at[hit]]
        rest = Spelled.of(words.filter(pa.array(~hit)))
        sums, n = np.zeros((len(rest.sizes), len(self.languages))), np.zeros(len(rest.sizes))
        word, open_ = rest.word, np.arange(len(rest.codes))
        for level in range(len(self.hashes) - 1, 0, -1):
            places, hashes = rest.grams(level, open_)
            known, at = self._found(level, hashes)
            here = word[places[known]]
            for i in range(len(self.languages)):
                sums[:, i] += np.bincount(here, weights=self.scores[level][at[known], i], minlength=len(sums))
            n += np.bincount(here, minlength=len(n))
            open_ = np.setdiff1d(open_, places[known], assume_unique=True)
        out[~hit] = sums / np.maximum(n, 1)[:, None]
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and score of each text, -1 and 0 without a letter."""
        words, of = words_in(texts)
        spoken = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts))
        each, z = self.of_words(words.dictionary.cast(pa.string())), np.zeros((len(texts), len(self.languages)))
        codes = words.indices.to_numpy()
        for i in range(z.shape[1]):
            z[:, i] = np.bincount(of, weights=each[codes, i], minlength=len(z)) if len(of) else 0
        best = z.argmax(1)
        score = 1 / np.exp(z - z[np.arange(len(z)), best][:, None]).sum(1)
        return np.where(spoken, best, -1), np.where(spoken, score, 0.0)


def _labelled(docs: DataFrame, id_col: str, text: str, lang: str, fit_docs: int) -> tuple[list[str], DataFrame]:
    """Languages, the most frequent first, and ``(l, t)``: the number of the language and the text of the documents to learn."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where("t IS NOT NULL AND lang IS NOT NULL AND i IS NOT NULL").where(id_remainder(F.col("i"), MODULUS) != HELD_OUT)
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), "lang").limit(MOST_LANGUAGES).collect()
    shares = docs.sparkSession.createDataFrame([(r.lang, at, fit_docs / r.docs) for at, r in enumerate(counted)], "lang string, l int, share double")
    drawn = (F.xxhash64(F.col("i").cast("string")) / F.lit(2.0**64) + 0.5) < F.col("share")
    return [r.lang for r in counted], rows.join(F.broadcast(shares), "lang").where(drawn).select("l", "t")


def _counts(sample: DataFrame) -> DataFrame:
    """``(n, g, l, c)``: how often documents of language l hold a word (n = 0) or n-gram of hash g."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in steps(batch.column("t"), 4 << 20):
                rows = batch.slice(start, stop - start)
                words, of = words_in(rows.column("t"))
                spelled, codes = Spelled.of(words.dictionary.cast(pa.string())), words.indices.to_numpy()
                of_row = rows.column("l").to_numpy()[of]
                for l in np.unique(of_row).tolist():
                    times = np.bincount(codes[of_row == l], minlength=len(spelled.sizes))
                    for n in range(LONGEST + 1):
                        if n:
                            places, hashes = spelled.grams(n, np.arange(len(spelled.codes)))
                            weights = times[spelled.word[places]]
                        else:
                            hashes, weights = spelled.whole(), times
                        found, inverse = np.unique(hashes[weights > 0], return_inverse=True)
                        c = np.bincount(inverse, weights=weights[weights > 0], minlength=len(found)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(found), n, np.int32)), pa.array(found.view(np.int64)), pa.array(np.full(len(found), l, np.int32)), pa.array(c)], names=["n", "g", "l", "c"]
                        )

    return sample.mapInArrow(count, "n int, g long, l int, c long").groupBy("n", "g", "l").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", fit_docs: int = FIT_DOCS, cells: int = CELLS) -> Model:
    ship(docs.sparkSession)
    languages, sample = _labelled(docs, id_col, text, lang, fit_docs)
    if not languages:
        return Model([], [np.zeros(0, np.uint64)] * (LONGEST + 1), [np.zeros((0, 0))] * (LONGEST + 1))
    entries = cells // len(languages)
    counts = stored(_counts(sample), "grams")
    level = F.floor(F.log2("total") * 8).alias("level")
    totals = counts.groupBy("n", "g").agg(F.sum("c").alias("total"), F.collect_list(F.struct("l", "c")).alias("each")).withColumn("level", level)
    # The least level of frequency whose entries, with all above, still fit the table.
    least, held = {}, {}
    for r in totals.groupBy("n", "level").count().orderBy("n", F.desc("level")).collect():
        held[r.n] = held.get(r.n, 0) + r["count"]
        if held[r.n] <= entries:
            least[r.n] = r.level
    kept = F.lit(False)
    for n, floor in least.items():
        kept = kept | ((F.col("n") == n) & (F.col("level") >= floor))
    table = totals.where(kept).select("n", "g", F.explode("each").alias("e")).select("n", "g", "e.l", "e.c").toArrow()
    sums = {(r.n, r.l): r.total for r in counts.groupBy("n", "l").agg(F.sum("c").alias("total")).collect()}
    all_n, all_g, all_l, all_c = (np.asarray(table.column(c)) for c in ("n", "g", "l", "c"))
    hashes, scores = [], []
    for n in range(LONGEST + 1):
        own = all_n == n
        found, inverse = np.unique(all_g[own].view(np.uint64), return_inverse=True)
        matrix = np.full((len(found), len(languages)), SMOOTHING)
        matrix[inverse, all_l[own]] += all_c[own]
        of_language = np.array([sums.get((n, l), 0) + SMOOTHING * max(1, len(found)) for l in range(len(languages))])
        hashes.append(found)
        scores.append(np.log(matrix / of_language).astype(np.float32))
    return Model(languages, hashes, scores)


def predict_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)`` of every whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("i"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*shared.value.languages, UNKNOWN])
        for batch in batches:
            for start, stop in steps(batch.column("t")):
                rows = batch.slice(start, stop - start)
                best, score = shared.value.predict(rows.column("t"))
                yield pa.RecordBatch.from_arrays([rows.column("i"), names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(score)], names=["i", "lang_pred", "score"])

    kind = dict(narrow.dtypes)["i"]
    return narrow.mapInArrow(run, f"i {kind}, lang_pred string, score double").withColumnRenamed("i", id_col)
