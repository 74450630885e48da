"""Near-duplicate documents by BagMinHash over multisets of word shingles.

A document is the multiset of its runs of ``SHINGLE`` words.  Each shingle
drives independent Poisson processes on dyadic rings of its weight axis ([0,1),
[1,2), [2,4), ...); a shingle that occurs w times uses the rings below w, points
of the last ring being thinned to w.  A point falls into a random register,
which keeps the least; two documents share a register's point with a
probability equal to their weighted Jaccard similarity.  Processes stop once
they pass the largest register, so a long text costs little more than its
shingles.

Registers are banded.  Texts with equal multisets are collapsed to one node
first.  In each bucket every node is verified against one leader only, the node
with the most company; then, in buckets that still hold several components,
members outside the largest one are verified against those nodes of other
components that a bound on their difference leaves.  After that each candidate
pair is verified, ruled out or already connected, without forming all pairs of
a group.

Texts without words are never duplicates; a text of fewer words than a shingle
is one shingle.  Null ids are allowed and come last within a class; repeated
rows are copies; an empty table gives an empty result; other columns are kept
by :func:`drop_near_duplicates` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.components import connected_components
from ..storage import ship, stored
from .caches import keep_only, register
from .words import byte_rows, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: 28 bands of 7 registers find a pair of similarity 0.8 with probability 0.9986, of 0.85 with 0.99997.
BANDS, ROWS = 28, 7
#: Shingles handled together in one step; bounds the memory of a worker.
STEP = 120_000

_U = np.uint64
_GOLD, _M1, _M2, _BASE = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x2545F4914F6CDD1D)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _WordHashes()
register("bagminhash", _HASHES.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix, by element."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``k`` words, sorted, repeats kept."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.zeros(0, dtype=_U)
    if len(_HASHES) > 100_000:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=_U, count=n)
    width = min(k, n)
    total = np.full(n - width + 1, width, dtype=_U)
    for i in range(width):
        total = total * _BASE + h[i : n - width + 1 + i]
    return np.sort(mixed(total))


def counted(sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]])) if len(sorted_hashes) else np.zeros(0, np.int64)
    return sorted_hashes[first], np.diff(np.append(first, len(sorted_hashes)))


def signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """BagMinHash registers (docs x registers) of weighted elements ``(element, doc, weight)``; weights are counts."""
    top = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # the last ring used
    index = np.repeat(np.arange(len(element)), top + 1)
    ring = np.arange(len(index)) - np.repeat(np.cumsum(top + 1) - top - 1, top + 1)
    low = np.where(ring == 0, 0, 1 << np.maximum(ring - 1, 0)).astype(float)
    rate = np.where(ring == 0, 1, low)
    owner, limit = doc[index], weight[index].astype(float)
    state = mixed(element[index] + _GOLD * (ring.astype(_U) + _U(1)))
    time = np.zeros(len(index))
    low_register = np.full(docs * registers, np.inf)
    while len(state):
        state = state + _GOLD
        draw = mixed(state)
        time = time - np.log1p(-(draw >> _U(11)).astype(float) * 2.0**-53) / rate
        other = mixed(draw ^ _BASE)
        where = low + rate * ((other >> _U(32)).astype(float) * 2.0**-32)
        slot = owner * registers + ((other & _U(0xFFFFFFFF)) % _U(registers)).astype(np.int64)
        inside = where < limit
        np.minimum.at(low_register, slot[inside], time[inside])
        last = low_register.reshape(docs, registers).max(1)
        go = time < last[owner]
        state, time, rate, low, owner, limit = state[go], time[go], rate[go], low[go], owner[go], limit[go]
    return low_register.reshape(docs, registers)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each document and band."""
    bits = np.ascontiguousarray(registers).view(_U).reshape(len(registers), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _GOLD, bits.shape[:2]).copy()
    for i in range(rows):
        key = mixed(key * _BASE + bits[:, :, i])
    return key.view(np.int64)


def _fingerprint(element: np.ndarray, weight: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(element.tobytes() + weight.astype("<i8").tobytes())


_SIGNED = "doc_id long, h binary, fp binary, n long, bands array<long>"


def signed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, h, fp, n, bands`` by row: digest of the text, of its multiset, number of shingles, band keys."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    narrow = narrow.withColumn("h", F.unhex(F.md5(F.col("t").cast("binary"))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("bagminhash")
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = start = 0
            for at, raw in enumerate(byte_rows(batch.column("t"))):
                held.append(counted(shingles(raw, k)))
                size += len(held[-1][0])
                if size >= STEP or at + 1 == batch.num_rows:
                    yield _signed_rows(batch.slice(start, len(held)), held, bands, rows)
                    start, held, size = at + 1, [], 0

    return narrow.mapInArrow(sign, _SIGNED)


def _signed_rows(batch: pa.RecordBatch, held: list[tuple[np.ndarray, np.ndarray]], bands: int, rows: int) -> pa.RecordBatch:
    full = [i for i, (element, _) in enumerate(held) if len(element)]
    keys = np.zeros((0, bands), dtype=np.int64)
    if full:
        element, weight = (np.concatenate([held[i][j] for i in full]) for j in (0, 1))
        doc = np.repeat(np.arange(len(full)), [len(held[i][0]) for i in full])
        keys = band_keys(signatures(element, doc, weight, len(full), bands * rows), bands, rows)
    present = np.array([len(element) > 0 for element, _ in held], dtype=bool)
    offsets = np.concatenate([[0], np.cumsum(np.where(present, bands, 0))]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), batch.column("h"),
            pa.array([_fingerprint(*x) if len(x[0]) else None for x in held], pa.binary()),
            pa.array([int(x[1].sum()) for x in held], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
        ],
        names=["doc_id", "h", "fp", "n", "bands"],
    )


def _multisets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """``(fp, s, c)`` of the nodes in ``wanted(fp, print, doc_id)``, from one of their documents; c is empty if all counts are 1."""
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    rows = texts.join(wanted.select("doc_id", "fp", "print"), F.col("i").eqNullSafe(F.col("doc_id"))).select("fp", "print", "t")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("bagminhash")
        for batch in batches:
            out = []
            for node, want, raw in zip(batch.column("fp").to_pylist(), batch.column("print").to_pylist(), byte_rows(batch.column("t"))):
                element, weight = counted(shingles(raw, k))
                if _fingerprint(element, weight) == want:  # an id may stand on several texts
                    out.append((node, element.tobytes(), b"" if weight.max() == 1 else weight.astype("<i4").tobytes()))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["fp", "s", "c"])

    return rows.mapInArrow(gather, "fp long, s binary, c binary")


def shared(sa: bytes, ca: bytes, sb: bytes, cb: bytes) -> int:
    """Size of the common part of two multisets."""
    a, b = np.frombuffer(sa, dtype=_U), np.frombuffer(sb, dtype=_U)
    wa = np.frombuffer(ca, dtype="<i4") if ca else np.ones(len(a), dtype=np.int32)
    wb = np.frombuffer(cb, dtype="<i4") if cb else np.ones(len(b), dtype=np.int32)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = b[at] == a
    return int(np.minimum(wa[same], wb[at[same]]).sum())


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b, an, bn)`` with ``shared``, the size of the common multiset."""
    rows = pairs.join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb"), F.col("c").alias("cb")), "b")
    rows = rows.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa"), F.col("c").alias("ca")), "a")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [
                shared(*(x.as_buffer().to_pybytes() for x in four))
                for four in zip(*(batch.column(k) for k in ("sa", "ca", "sb", "cb")))
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("a", "b", "an", "bn")), pa.array(sizes, pa.int64())], names=["a", "b", "an", "bn", "shared"])

    return rows.select("a", "b", "an", "bn", "sa", "ca", "sb", "cb").mapInArrow(measure, "a long, b long, an long, bn long, shared long")


def _own_weights(sets: DataFrame) -> DataFrame:
    """``(fp, own)``: the weight of shingles that no other multiset in ``sets`` has."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                element = np.frombuffer(batch.column("s")[i].as_buffer().to_pybytes(), dtype=np.int64)
                raw = batch.column("c")[i].as_buffer().to_pybytes()
                weight = np.frombuffer(raw, dtype="<i4") if raw else np.ones(len(element), dtype=np.int32)
                names = pa.repeat(batch.column("fp")[i], len(element))
                yield pa.RecordBatch.from_arrays([pa.array(element), names, pa.array(weight)], names=["e", "fp", "w"])

    rows = sets.mapInArrow(spread, "e long, fp long, w int")
    alone = rows.groupBy("e").agg(F.count(F.lit(1)).alias("k"), F.first("fp").alias("fp"), F.first("w").alias("w")).where("k = 1")
    return alone.groupBy("fp").agg(F.sum("w").alias("own"))


def _pairs_apart(named: DataFrame, stars: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a bucket in different components that can still be similar.

    ``named(key, fp, n, lead, lead_n, comp)``.  With u the weight only one
    text has and l what the bucket's leader has more, two texts differ by
    ``u + u' + |l - l'|`` at least, and similar ones by ``c (n + n')`` at most, c =
    (1 - t) / (1 + t).  Texts too far from every other by that bound are set
    aside by minima over the values of l, before any pair is formed.
    """
    bucket = ["key"]
    parts = named.groupBy(*bucket, "comp").agg(F.count(F.lit(1)).alias("size"))
    mains = parts.groupBy(*bucket).agg(F.max(F.struct("size", "comp")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mains = stored(mains.select(*bucket, F.col("main.comp").alias("main")), "mains")
    split = stored(named.join(mains, bucket), "split")
    here = sets.join(split.select("fp").distinct(), "fp")
    own = stored(_own_weights(here), "own")
    known = stars.select(F.col("a").alias("lead"), F.col("b").alias("fp"), "shared")
    # The buckets of each text, so that a pair is formed in the first that it shares and in no other.
    places = split.groupBy("fp").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    rows = split.join(own.join(places, "fp", "right"), "fp").join(known, ["lead", "fp"], "left")
    lost = F.when(F.col("fp") == F.col("lead"), F.lit(0)).otherwise(F.col("lead_n") - F.col("shared"))
    c = (1 - similarity) / (1 + similarity)
    rows = rows.select(*bucket, "fp", "n", "comp", "main", "keys", F.coalesce("own", F.lit(0)).alias("u"), lost.alias("l"), (c * F.col("n")).alias("cn"))
    rows = stored(rows, "bounds")
    # One row a bucket and value of l, of which there are no more than the leader has shingles.
    levels = rows.groupBy(*bucket, "l").agg(F.min(F.expr("u - l - cn")).alias("near"), F.min(F.expr("u + l - cn")).alias("far"))
    by_l = Window.partitionBy(*bucket).orderBy("l")
    levels = levels.select(
        *bucket, "l",
        F.min("near").over(by_l.rowsBetween(Window.unboundedPreceding, 0)).alias("low_near"),
        F.min("far").over(by_l.rowsBetween(1, Window.unboundedFollowing)).alias("low_far"),
    )
    levels = stored(levels, "levels")
    slack = 1e-6  # sums of doubles
    reach = (F.col("u") + F.col("l") + F.col("low_near") <= F.col("cn") + slack) | (F.col("u") - F.col("l") + F.coalesce("low_far", F.lit(float("inf"))) <= F.col("cn") + slack)
    minor = rows.where("comp <> main").join(levels, [*bucket, "l"]).where(reach)
    minor = stored(minor.select(*bucket, F.col("fp").alias("x"), F.col("n").alias("xn"), F.col("comp").alias("xc"), F.col("u").alias("xu"), F.col("l").alias("xl"), F.col("cn").alias("xcn"), F.col("keys").alias("xkeys")), "minor")
    close = (
        (F.col("comp") != F.col("xc"))
        & ((F.col("comp") == F.col("main")) | (F.col("fp") < F.col("x")))
        & (F.col("u") + F.col("xu") + F.abs(F.col("l") - F.col("xl")) <= F.col("cn") + F.col("xcn") + slack)
        & (F.element_at(F.array_intersect("keys", "xkeys"), 1) == F.col("key"))
    )
    turned = F.col("fp") > F.col("x")
    first, second = (F.struct(F.col(i).alias("fp"), F.col(n).alias("n")) for i, n in (("fp", "n"), ("x", "xn")))
    pairs = rows.join(minor, bucket).where(close).select(F.when(turned, second).otherwise(first).alias("p"), F.when(turned, first).otherwise(second).alias("q"))
    pairs = pairs.select(F.col("p.fp").alias("a"), F.col("q.fp").alias("b"), F.col("p.n").alias("an"), F.col("q.n").alias("bn")).distinct()
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(tested, ["a", "b"], "left_anti")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, h, n_shingles, class_key, class_id, class_size`` of every row of ``docs``.

    ``class_id`` is the smallest id of the class (null if all are null), which
    tells classes apart if ids do; ``class_key`` always does.  A row without
    words has its own id, size 1 and no key.  ``h`` is the digest of the text.
    """
    sigs = stored(signed(docs, id_col, text, k, bands, rows), "signatures")
    prints = sigs.where("fp is not null").withColumnRenamed("fp", "print")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    # From here on a node is a number, shorter to deal out than its digest; which number it is changes no result.
    nodes = stored(nodes.withColumn("fp", F.monotonically_increasing_id()), "nodes")
    bucket = ["key"]
    dealt = nodes.select("fp", "n", F.explode("bands").alias("key"))
    buckets = stored(dealt.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    # Members of buckets with two nodes or more; all later steps read this, not the signatures.
    members = stored(dealt.join(buckets, bucket), "members")
    # A bucket is led by its node with the most company over all bands: the middle of a group of copies.
    company = members.groupBy("fp").agg(F.sum("size").alias("company"))
    ranked = stored(members.join(company, "fp").select(*bucket, "fp", "n", "company"), "ranked")
    leads = ranked.groupBy(*bucket).agg(F.max(F.struct("company", "fp", "n")).alias("top"))
    leads = stored(leads.select(*bucket, F.col("top.fp").alias("lead"), F.col("top.n").alias("lead_n")), "leads")
    led = stored(ranked.join(leads, bucket).select(*bucket, "fp", "n", "lead", "lead_n"), "led")
    stars = led.where("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b"), F.col("lead_n").alias("an"), F.col("n").alias("bn")).distinct()
    inside = led.select("fp").distinct()
    sets = stored(_multisets(docs, nodes.select("fp", "print", "doc_id").join(inside, "fp"), id_col, text, k).dropDuplicates(["fp"]), "multisets")
    stars = stored(_overlaps(stars, sets), "stars")

    def linked(overlaps: DataFrame) -> DataFrame:
        return overlaps.where(F.col("shared") / (F.col("an") + F.col("bn") - F.col("shared")) >= similarity).select("a", "b")

    found = connected_components(linked(stars))
    # What the leaders left apart: buckets with several components.
    named = led.join(found, F.col("fp") == F.col("node"), "left").drop("node").withColumn("comp", F.coalesce("component", "fp")).drop("component")
    apart = stored(_pairs_apart(stored(named, "named"), stars, sets, similarity), "pairs")
    more = stored(linked(_overlaps(apart, sets)), "links")
    if not more.isEmpty():
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    comp = nodes.select("fp", "print", "doc_id", "copies").join(found, F.col("fp") == F.col("node"), "left").select("print", "doc_id", "copies", F.coalesce("component", "fp").alias("comp"))
    comp = stored(comp, "components")
    ids = comp.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    by_print = stored(comp.select("print", "comp").join(ids, "comp").select("print", F.col("comp").alias("class_key"), "class_id", "class_size"), "classes")
    kept = prints.select("doc_id", "h", "n", "print").join(by_print, "print").select("doc_id", "h", F.col("n").alias("n_shingles"), "class_key", "class_id", "class_size")
    alone = sigs.where("fp is null").select("doc_id", "h", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("class_key"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return kept.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each class the one with the smallest id.

    Rows without words all stay.  Null ids come last; of rows with one id the
    smallest digest stays; of equal rows, one.
    """
    named = classes(docs, id_col, text, **options)
    chosen_row = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h")).alias("r")
    stay = named.where("n_shingles > 0").groupBy("class_key").agg(chosen_row).select(F.col("r.doc_id").alias("class_id"), "r.h")
    stay = stored(stay, "stay")
    body = F.col(text).cast("string")
    marked = docs.select(F.struct("*").alias("doc"), F.unhex(F.md5(body.cast("binary"))).alias("digest"), F.col(id_col).cast("long").alias("id"), body.alias("body"))
    mine = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("h"))
    chosen = marked.join(stay, mine, "left_semi").drop("body")
    # Equal rows: one of them. They are few, so only they are dealt out by their key.
    repeats = stored(chosen.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("rid"), F.col("digest").alias("rdigest")), "repeats")
    same = F.col("id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest"))
    once = chosen.join(repeats, same, "left_anti")
    twice = chosen.join(repeats, same, "left_semi").dropDuplicates(["id", "digest"])
    wordless = marked.where(~F.coalesce("body", F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    return once.select("doc.*").unionByName(twice.select("doc.*")).unionByName(wordless.select("doc.*"))
