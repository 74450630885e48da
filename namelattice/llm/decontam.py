"""Benchmark decontamination with a distributed positional inverted index.

The index holds the postings of every word of every text.  It is partitioned by
documents: a segment, one row, has the words of a run of documents, sorted, each
word's ascending positions on one axis, and each document's place on that axis.
No posting list ever crosses a shuffle, and a frequent word is spread over all
segments.  An index is written once and serves any test set.

A search cuts the test items into windows and goes from the rarest word of each
window (by occurrences in the whole corpus, ties by the word itself) to its most
frequent one.  Where the rarest word stands, the other words are looked for in
their own lists: anywhere within ``within`` words for a proximity match, at the
window's own offsets for an exact one.  All windows of a segment take each step
together, a bounded number of places at a time.  Words are compared whole, so
matches are exact.

The test set comes to the driver in blocks of a bounded number of words; longer
items are cut into overlapping pieces, so no block exceeds its bound.

Null and empty texts hold no words; a null item id counts as the empty string
in lists of items; repeated items and repeated documents each keep their rows;
an item that holds a word which no text has matches nowhere by that word's
windows; empty tables give results without matches; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bounded import broadcast_if_small
from ..storage import fresh_path, ship, stored
from .caches import keep_only
from .words import separated, words_of

#: Words of a window, and words around the rarest one in which a proximity match has all others.
WINDOW, WITHIN = 10, 20
#: Words of the test set that the driver and each worker hold at once.
BLOCK_WORDS = 200_000
#: Words in a segment before it is closed; bounds a row of the index to a few MB, or one document.
SEGMENT_WORDS = 400_000
#: Segments in a file of the index: writers and readers of Parquet hold a file's rows together until 100 of them, whatever their size.
FILE_SEGMENTS = 8
#: Bytes of a longer text whose words are listed together.
PIECE = 4 << 20
#: Places that are compared in one step of a search.
STEP = 500_000
_INDEX_SCHEMA = "terms array<binary>, ends array<int>, steps array<int>, row array<long>, doc_id array<long>, h array<long>, places array<long>, n_words array<long>"
_MATCH_SCHEMA = "row long, doc_id long, h long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>, near_items array<string>"


# --- the index -----------------------------------------------------------------------------------------------------


def _pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` bytes, cut at spaces, so that a long text is listed a piece at a time."""
    start = 0
    while len(raw) - start > size:
        cut = raw.find(b" ", start + size)
        if cut < 0:
            break
        yield raw[start:cut]
        start = cut
    yield raw[start:] if start else raw


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of separated texts one behind the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    words, ends = lists.flatten(), lists.offsets.to_numpy()
    full = pc.not_equal(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), np.diff(before[ends - ends[0]])


def _worded(texts: pa.Array, size: int) -> Iterator[tuple[int, list[pa.Array], np.ndarray]]:
    """``(first row, words, words of each row)`` of runs of rows of at most ``size`` bytes together, or of one longer row."""
    texts = separated(texts)
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    start = 0
    while start < len(texts):
        held = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + size, side="right")))
        if stop - start > 1 or ends[start] - held <= PIECE:
            words, sizes = _split(texts.slice(start, stop - start))
            yield start, [words.dictionary_encode()], sizes
        else:
            found = [_split(pa.array([piece], pa.binary()).cast(pa.string())) for piece in _pieces(texts[start].as_buffer().to_pybytes())]
            yield start, [words.dictionary_encode() for words, _ in found], np.array([sum(int(n[0]) for _, n in found)])
        start = stop


def _ordered(codes: np.ndarray, size: int) -> np.ndarray:
    """The stable order of codes below ``size``, by 16 bits at a time."""
    order = np.argsort(codes.astype(np.uint16), kind="stable")
    if size > 1 << 16:
        order = order[np.argsort((codes >> 16).astype(np.uint16)[order], kind="stable")]
    return order


class _Segment:
    """A run of documents, growing until it is written as one row."""

    def __init__(self) -> None:
        self.words: list[pa.DictionaryArray] = []
        self.sizes: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, rows: list[tuple], words: list[pa.DictionaryArray], sizes: np.ndarray) -> None:
        self.words += words
        self.sizes.append(sizes)
        self.rows += rows
        self.held += int(sizes.sum()) + len(sizes)

    def batch(self) -> pa.RecordBatch:
        # Documents lie on one axis with a free place between them, so that no phrase runs across.
        sizes = np.concatenate(self.sizes).astype(np.int64)
        places = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        parts = pa.chunked_array(self.words).unify_dictionaries().chunks
        terms = parts[0].dictionary.cast(pa.binary())
        order = pc.sort_indices(terms).to_numpy()
        rank = np.empty(len(terms), dtype=np.int32)
        rank[order] = np.arange(len(terms))
        flat = rank[np.concatenate([part.indices.to_numpy() for part in parts])]
        at = (np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes))[_ordered(flat, len(terms))]
        ends = np.cumsum(np.bincount(flat, minlength=len(terms)))
        # Positions are stored as steps from one to the next, which are small for frequent words.
        columns = [terms.take(pa.array(order)), pa.array(ends, pa.int32()), pa.array(np.diff(at, prepend=0), pa.int32())]
        columns += [pa.array(x, pa.int64()) for x in zip(*self.rows)] + [pa.array(places), pa.array(sizes)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values) for values in columns]
        return pa.RecordBatch.from_arrays(lists, names=["terms", "ends", "steps", "row", "doc_id", "h", "places", "n_words"])


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Write the postings of all words of ``docs`` to ``path``, a row a segment, and return the frame that reads them."""
    ship(docs.sparkSession)
    body = F.col(text).cast("string")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("t"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("decontam")
        segment = _Segment()
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in ("row", "doc_id", "h"))))
            # A byte and its separator are a word at the least, so a run of rows stays below half a segment.
            for start, words, sizes in _worded(batch.column("t"), segment_words):
                segment.add(rows[start : start + len(sizes)], words, sizes)
                if segment.held >= segment_words:
                    yield segment.batch()
                    segment = _Segment()
        if segment.rows:
            yield segment.batch()

    options = {"compression": "zstd", "parquet.block.size": str(32 << 20), "maxRecordsPerFile": str(FILE_SEGMENTS)}
    numbered.mapInArrow(build, _INDEX_SCHEMA).write.options(**options).parquet(path)
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX_SCHEMA).parquet(path)


def _codes(terms: pa.Array, asked_for: pa.Array) -> np.ndarray:
    """The places of ``terms`` in ``asked_for``, -1 for those that aren't there."""
    return pc.fill_null(pc.index_in(terms, value_set=asked_for), -1).to_numpy().astype(np.int64)


def _asked_for(lookup: dict[bytes, int]) -> pa.Array:
    """The words of ``lookup``, whose numbers are their places."""
    return pa.array(list(lookup), pa.binary())


class Postings:
    """The lists of those words of one segment that a search asks for, by their places in ``asked_for``."""

    def __init__(self, part: dict[str, pa.Array], asked_for: pa.Array):
        self.places, self.sizes = part["places"].to_numpy(), part["n_words"].to_numpy()
        self.total = int(self.places[-1] + self.sizes[-1]) + 2
        ends = part["ends"].to_numpy().astype(np.int64)
        code = _codes(part["terms"], asked_for)
        asked = np.flatnonzero(code >= 0)
        asked = asked[np.argsort(code[asked])]
        flat = np.cumsum(part["steps"].to_numpy().astype(np.int64))
        count = np.diff(ends, prepend=0)[asked]
        start = (ends - np.diff(ends, prepend=0))[asked]
        #: All lists one behind the other in the order of numbers, as number * total + position: ascending throughout.
        self.keys = np.repeat(code[asked], count) * self.total + flat[np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)]
        self.first = np.zeros(len(asked_for) + 1, dtype=np.int64)
        self.first[code[asked] + 1] = count
        self.first = np.cumsum(self.first)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.places, at, side="right") - 1

    def inside(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a word's list has a position from ``low`` to ``high``."""
        if not len(self.keys):
            return np.zeros(len(code), dtype=bool)
        at = np.searchsorted(self.keys, code * self.total + low)
        return self.keys[np.minimum(at, len(self.keys) - 1)] <= np.where(at < len(self.keys), code * self.total + high, -1)


def _segments(batches: Iterator[pa.RecordBatch], lookup: dict[bytes, int]) -> Iterator[tuple[dict[str, pa.Array], Postings]]:
    asked_for = _asked_for(lookup)
    for batch in batches:
        for i in range(batch.num_rows):
            part = {k: batch.column(k)[i].values for k in batch.schema.names}
            yield part, Postings(part, asked_for)


def term_counts(index: DataFrame, lookup: dict[bytes, int]) -> np.ndarray:
    """Occurrences of the words of ``lookup`` in the whole corpus, by their numbers."""
    shared = index.sparkSession.sparkContext.broadcast(lookup)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_for = _asked_for(shared.value)
        found = np.zeros(len(asked_for), dtype=np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column("terms"), batch.column("ends")):
                code = _codes(terms.values, asked_for)
                found[code[code >= 0]] += np.diff(ends.values.to_numpy(), prepend=0)[code >= 0]
        hit = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(found[hit])], names=["term", "n"])

    counts = np.zeros(len(lookup), dtype=np.int64)
    rows = index.select("terms", "ends").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for row in rows.toLocalIterator():
        counts[row.term] = row.n
    return counts


# --- the search ----------------------------------------------------------------------------------------------------


def item_blocks(items: DataFrame, id_col: str, text: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test set on the driver, at most ``block_words`` words at a time: (id as string, words).

    A longer item comes in pieces that overlap by a window less one word, so
    that the windows of the pieces are those of the item.
    """
    block_words = max(block_words, 2 * window)
    block, held = [], 0
    for row in items.select(F.col(id_col).cast("string").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        words = words_of((row.t or "").encode())
        for at in range(0, max(1, len(words) - window + 1), block_words - window + 1):
            piece = words[at : at + block_words]
            if not piece:
                continue
            if block and held + len(piece) > block_words:
                yield block
                block, held = [], 0
            block.append((row.i or "", piece))
            held += len(piece)
    if block:
        yield block


def vocabulary(block: list[tuple[str, list[bytes]]]) -> dict[bytes, int]:
    """Numbers of a block's words, in their order."""
    return {word: i for i, word in enumerate(sorted({word for _, words in block for word in words}))}


@dataclass
class Phrases:
    """Distinct windows of a block as arrays, by their rarest word.

    Row i of ``codes`` has the words of a window from the rarest on and row i of
    ``offsets`` their places in it; ``lengths`` words count, ``-1`` fills up.
    ``owners[first_owner[i]:first_owner[i + 1]]`` are the items, by place in ``items``.
    """

    items: list[str]
    codes: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    first_owner: np.ndarray
    owners: np.ndarray


def phrases(block: list[tuple[str, list[bytes]]], lookup: dict[bytes, int], counts: np.ndarray, window: int = WINDOW) -> Phrases:
    names = sorted({item for item, _ in block})
    place = {item: i for i, item in enumerate(names)}
    rows, owners = [], []
    for item, words in block:
        codes = np.fromiter(map(lookup.__getitem__, words), dtype=np.int32, count=len(words))
        if len(codes) < window:
            codes = np.concatenate([codes, np.full(window - len(codes), -1, dtype=np.int32)])
        found = np.lib.stride_tricks.sliding_window_view(codes, window)
        rows.append(found)
        owners.append(np.full(len(found), place[item], dtype=np.int32))
    codes, owner = np.concatenate(rows), np.concatenate(owners)
    # A word that the corpus lacks: the window can't occur.
    possible = ((codes < 0) | (np.append(counts, 1)[codes] > 0)).all(axis=1)
    codes, owner = codes[possible], owner[possible]
    distinct, which = np.unique(codes, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.reshape(-1), owner], axis=1), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    # Numbers follow the order of words, so equal counts are settled by the word.
    rarity = np.where(distinct < 0, np.iinfo(np.int64).max, np.append(counts, 0)[distinct])
    order = np.lexsort((distinct, rarity), axis=1)
    return Phrases(names, np.take_along_axis(distinct, order, 1), order.astype(np.int16), (distinct >= 0).sum(axis=1), first, pairs[:, 1])


def _starts(wanted: Phrases, lists: Postings, within: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(window, place of its rarest word, exact)`` of all proximity and exact matches in a segment, a bounded number of places at a time."""
    anchor = wanted.codes[:, 0]
    room = lists.first[anchor + 1] - lists.first[anchor]
    present = np.flatnonzero(room)
    room = room[present]
    cuts = np.searchsorted(np.cumsum(room), np.arange(STEP, room.sum() + STEP, STEP), side="left") + 1 if len(present) else []
    at = 0
    for stop in np.unique(np.minimum(cuts, len(present))).tolist() if len(present) else []:
        n = room[at:stop]
        which = np.repeat(present[at:stop], n)
        where = np.arange(n.sum()) + np.repeat(lists.first[anchor[present[at:stop]]] - (np.cumsum(n) - n), n)
        at = stop
        spot = lists.keys[where] - anchor[which].astype(np.int64) * lists.total
        doc = lists.document(spot)
        low, high = lists.places[doc], lists.places[doc] + lists.sizes[doc] - 1
        begin = spot - wanted.offsets[which, 0]
        exact = (begin >= low) & (begin + wanted.lengths[which] - 1 <= high)
        near = np.ones(len(which), dtype=bool)
        low, high = np.maximum(low, spot - within), np.minimum(high, spot + within)
        for step in range(1, wanted.codes.shape[1]):
            code = wanted.codes[which, step].astype(np.int64)
            todo = np.flatnonzero(code >= 0)
            if not len(todo):
                break
            near[todo] &= lists.inside(code[todo], low[todo], high[todo])
            todo = todo[exact[todo]]
            want = begin[todo] + wanted.offsets[which[todo], step]
            exact[todo] = lists.inside(code[todo], want, want)
            left = near | exact
            which, spot, begin, exact, near, low, high = (x[left] for x in (which, spot, begin, exact, near, low, high))
        yield which[near], spot[near], np.zeros(near.sum(), dtype=bool)
        yield which[exact], begin[exact], np.ones(exact.sum(), dtype=bool)


def _search_segment(part: dict[str, pa.Array], lists: Postings, wanted: Phrases, within: int) -> pa.RecordBatch:
    places, sizes = lists.places, lists.sizes
    edges = np.zeros(lists.total + 1, dtype=np.int32)
    met: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for which, at, exact in _starts(wanted, lists, within):
        if not len(which):
            continue
        kind = bool(exact[0])
        if kind:
            np.add.at(edges, at, 1)
            np.add.at(edges, at + wanted.lengths[which], -1)
        # One row a document and item; a window may have many owners and stand in many places.
        pairs = np.unique(np.stack([lists.document(at), which], axis=1), axis=0)
        n = (wanted.first_owner[1:] - wanted.first_owner[:-1])[pairs[:, 1]]
        who = wanted.owners[np.arange(n.sum()) + np.repeat(wanted.first_owner[pairs[:, 1]] - (np.cumsum(n) - n), n)]
        met[kind].append(np.unique(np.stack([np.repeat(pairs[:, 0], n), who], axis=1), axis=0))
    hit = np.cumsum(edges[:-1]) > 0
    change = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    opens, closes = change[::2], change[1::2]  # a phrase never reaches the free place behind a document
    owner = lists.document(opens)
    n_hit = np.bincount(owner, weights=closes - opens, minlength=len(places)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(places)))]).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(opens - places[owner]), pa.array(closes - places[owner])], names=["start", "end"])

    def listed(pairs: list[np.ndarray]) -> pa.Array:
        # Items are numbered in their order, so they come out sorted.
        rows = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), dtype=np.int64)
        bounds = np.searchsorted(rows[:, 0], np.arange(len(places) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(wanted.items, pa.string()).take(pa.array(rows[:, 1])))

    return pa.RecordBatch.from_arrays(
        [part["row"], part["doc_id"], part["h"], pa.array(sizes), pa.array(n_hit), pa.ListArray.from_arrays(pa.array(offsets), spans), listed(met[True]), listed(met[False])],
        names=["row", "doc_id", "h", "n_words", "n_hit", "spans", "items", "near_items"],
    )


def _searched(index: DataFrame, block: list[tuple[str, list[bytes]]], window: int, within: int) -> DataFrame:
    """Matches of one block of items in all segments, a row a document."""
    lookup = vocabulary(block)
    shared = index.sparkSession.sparkContext.broadcast((lookup, phrases(block, lookup, term_counts(index, lookup), window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("decontam")
        known, wanted = shared.value
        for part, lists in _segments(batches, known):
            yield _search_segment(part, lists, wanted, within)

    return index.mapInArrow(run, _MATCH_SCHEMA)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_MATCH_ARROW = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
    ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string())),
])


def _merged(parts: DataFrame) -> DataFrame:
    """One row for each document from the rows of several blocks of items."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                spans: list[dict[str, int]] = []
                for span in sorted((x for part in row["spans"] for x in part), key=lambda x: x["start"]):
                    if spans and span["start"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], span["end"])
                    else:
                        spans.append(dict(span))
                lists = {k: sorted({x for part in row[k] for x in part}) for k in ("items", "near_items")}
                out.append(row | lists | {"spans": spans, "n_hit": sum(x["end"] - x["start"] for x in spans)})
            yield pa.RecordBatch.from_pylist(out, schema=_MATCH_ARROW)

    rows = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first("n_words").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        *(F.collect_list(k).alias(k) for k in ("spans", "items", "near_items")),
    )
    return rows.mapInArrow(merge, _MATCH_SCHEMA)


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, within: int = WITHIN, item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, h, n_words, n_hit, spans, items, near_items``, a row for each row that was indexed; h is the hash of the text.

    ``spans`` are the disjoint word ranges ``[start, end)`` inside occurrences of
    windows; ``items`` the ids of items with a window there, as strings, sorted;
    ``near_items`` those with a proximity match: a window's rarest word with all
    its other words at most ``within`` words away.
    """
    ship(index.sparkSession)
    found = [_searched(index, block, window, within) for block in item_blocks(items, item_id, item_text, window, block_words)]
    if not found:
        found = [_searched(index, [("", [])], window, within)]
    whole = found[0] if len(found) == 1 else _merged(reduce(DataFrame.unionByName, found))
    return whole.drop("row")


def match_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS, **options) -> DataFrame:
    """Index ``docs`` in the shared folder and :func:`search` it for ``items``."""
    index = build_index(docs, fresh_path(docs.sparkSession, "index"), id_col, text, segment_words)
    return search(index, items, window, **options)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of any item."""
    hit = match_items(docs, items, id_col=id_col, text=text, **options).where("n_hit > 0").select(F.col("doc_id").alias("i"), F.col("h").alias("d")).distinct()
    hit = broadcast_if_small(stored(hit, "contaminated"), 200_000)
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("k"), F.xxhash64(F.col(text).cast("string")).alias("g"))
    return rows.join(hit, F.col("k").eqNullSafe(F.col("i")) & (F.col("g") == F.col("d")), "left_anti").select("doc.*")


def near_matches(index: DataFrame, query: str, within: int = WITHIN) -> DataFrame:
    """``doc_id, position``: places of the query's rarest word that have all its other words at most ``within`` words away."""
    ship(index.sparkSession)
    words = list(dict.fromkeys(words_of(query.encode())))
    lookup = {word: i for i, word in enumerate(sorted(words))}
    shared = index.sparkSession.sparkContext.broadcast((lookup, phrases([("", words)], lookup, term_counts(index, lookup), max(1, len(words)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = shared.value
        for part, lists in _segments(batches, known):
            for _, at, exact in _starts(wanted, lists, within):
                at = np.unique(at[~exact])
                doc = lists.document(at)
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(doc)), pa.array(at - lists.places[doc], pa.int64())], names=["doc_id", "position"])

    return index.mapInArrow(run, "doc_id long, position long")
