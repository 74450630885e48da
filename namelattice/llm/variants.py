"""Spelling variants: words one edit apart, met by merging light subtrees of a trie.

The trie of all words is a table of its edges, one row for each word and depth,
named by a rolling hash of the prefix.  At each branching node the child with
most words is heavy.  A word leaves the heavy path at most log2(words) times; at
such a node, with ``p`` before it, ``a`` the word's character there, ``x`` behind
it and ``h`` the heavy character, the light word is merged three ways:

* ``a`` replaced: with the heavy subtree by ``p h x``, with light words of the
  same node by ``p . x``;
* ``a`` skipped: with the node's own subtree by ``p x``;
* ``h`` skipped in the heavy subtree, which is the light word with ``h`` put in: ``p h a x``.

A merge is left out where the other subtree lacks the next edge.  Where terminals coincide two words are one edit apart, and each such pair parts
at one node, so it is found once.  Keys are whole strings, so a clash of prefix
hashes costs at most a look-up: any one character that all words of a
node take for heavy gives all pairs.

Light words of a node that share ``p . x`` differ in one character, so a group
has at most as many rows as there are letters.  Nodes with many words, such as
the root, are few at any depth and are broadcast behind a count; no
other key has more than ``CROWDED`` rows.  Each edge takes some 30 bytes whatever
the word's length, so a run of any length costs in proportion to it.

Null texts have no words; a null id counts as the word ``null`` where a draw
asks for it; repeated rows each count; an empty table gives an empty result;
other columns are ignored.  Of near words of one ``n`` the least in code-point order is the form.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bounded import broadcast_if_small
from .tokens import gathered, steps
from ..storage import ship, stored

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: One in so many (document, run) pairs has a character deleted.
DELETED = 31
#: Nodes of more words are broadcast, up to MOST_CROWDED of them.
CROWDED, MOST_CROWDED = 5_000, 1_000_000
#: The character of an edge to a word's end.
END = -1

_LOWERED = np.array([b if 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], dtype=np.uint8)
_HASH = np.uint64(0x9E3779B97F4A7C15)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def spaced(texts: pa.Array) -> pa.Array:
    """``texts``, null as empty, with runs of ``[A-Za-z\\u00C0-\\u00FF]`` kept, A-Z lower-cased, and a space for every other byte."""
    strings = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = strings.buffers()
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    out = _LOWERED[raw]
    lead = np.flatnonzero(raw == 0xC3)  # U+00C0 to U+00FF are this byte and one more
    lead = lead[lead + 1 < len(raw)]
    out[lead], out[lead + 1] = 0xC3, raw[lead + 1]
    return pa.LargeStringArray.from_buffers(len(strings), offsets, pa.py_buffer(out), offset=strings.offset)


def _flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string array, and where each string starts and how long it is."""
    _, offsets, data = strings.buffers()
    kind = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    ends = np.frombuffer(offsets, dtype=kind)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)), ends[:-1], np.diff(ends)


def crc32_behind(seeds: np.ndarray, strings: pa.Array) -> np.ndarray:
    """crc32 of each string behind the text whose crc32 is its seed, all strings a byte at a time."""
    raw, starts, sizes = _flat(strings)
    crc = ~seeds.astype(np.uint32)
    order = np.argsort(-sizes, kind="stable")
    starts, crc = starts[order], crc[order]
    longer = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")  # strings of more than j bytes
    for j, n in enumerate(longer.tolist()):
        crc[:n] = _CRC[(crc[:n] ^ raw[starts[:n] + j]) & 0xFF] ^ (crc[:n] >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def _runs(ids: pa.Array, texts: pa.Array, least: int) -> pa.Table:
    """``(word, n)`` of the runs of some texts, drawn deletions done."""
    lists = pc.ascii_split_whitespace(spaced(texts))
    runs, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    long = pc.greater_equal(pc.utf8_length(runs), least)
    runs, of = runs.filter(long), of[long.to_numpy(zero_copy_only=False)]
    seeds = np.array([zlib.crc32(f"{'null' if i is None else i}:".encode()) for i in ids.to_pylist()], dtype=np.uint32)
    crc = crc32_behind(seeds[of], runs) if len(runs) else np.zeros(0, dtype=np.uint32)
    drawn = crc % DELETED == 0
    counted = runs.filter(pa.array(~drawn)).value_counts()
    cut = []
    for word, h in zip(runs.filter(pa.array(drawn)).to_pylist(), crc[drawn].tolist()):
        at = h % len(word)
        if len(word) > least:
            cut.append(word[:at] + word[at + 1 :])
    parts = pa.array(cut, pa.large_string()).value_counts()
    return pa.table({
        "word": pa.chunked_array([counted.field("values"), parts.field("values")]).cast(pa.string()),
        "n": pa.chunked_array([counted.field("counts"), parts.field("counts")]),
    })


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of all texts; each task hands on counts of distinct words."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in steps(batch.column("t")):
                yield from _runs(batch.column("i").slice(start, stop - start), batch.column("t").slice(start, stop - start), min_length).combine_chunks().to_batches()

    return narrow.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one behind the other, and the length of each."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.int64), sizes


def trie_edges(words: DataFrame) -> DataFrame:
    """``(k, d, p, c, e)``: for each word (by hash ``k``) the edges on its way: depth, hash of the prefix, character, the next character; END at its end."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in steps(batch.column("word"), 1 << 20):
                rows = batch.slice(start, stop - start)
                codes, sizes = _codes(rows.column("word"))
                starts = np.cumsum(sizes) - sizes
                depth = np.arange(len(codes)) - np.repeat(starts, sizes)
                powers = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, _HASH))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + 1).astype(np.uint64) * powers[depth], dtype=np.uint64)])
                # A word has an edge for each character and one for its end.
                n = sizes + 1
                d = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(starts, n) + d
                p = sums[at] - sums[np.repeat(starts, n)]
                left, ahead = np.repeat(sizes, n) - d, np.concatenate([codes, [END, END]])
                c, e = np.where(left > 0, ahead[at], END), np.where(left > 1, ahead[at + 1], END)
                k = np.repeat(rows.column("k").to_numpy(), n)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(d.astype(np.int32)), pa.array(p.view(np.int64)), pa.array(c.astype(np.int16)), pa.array(e.astype(np.int16))], names=["k", "d", "p", "c", "e"])

    return words.select("word", F.xxhash64("word").alias("k")).mapInArrow(edges, "k long, d int, p long, c short, e short")


def _bit(char: str, half: int) -> Column:
    """A set of one character in one of two 64-bit halves: a-z and END in the first, U+00C0 to U+00FF in the second."""
    at = f"CASE WHEN {char} < 192 THEN IF({char} < 0, 0, {char} - 96) ELSE {char} - 192 END"
    return F.expr(f"IF({char} {'<' if half == 0 else '>='} 192, shiftleft(1L, CAST({at} AS INT)), 0L)")


def _has(sets: str, char: str) -> Column:
    """Whether the set of characters whose halves are columns ``sets`` 0 and 1 holds ``char``."""
    return (F.col(f"{sets}0").bitwiseAND(_bit(char, 0)) != 0) | (F.col(f"{sets}1").bitwiseAND(_bit(char, 1)) != 0)


def light_edges(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``(word, n, d, h, replaced, skipped, put_in, met)``: where a word leaves the heavy path, and which merges go on beyond the first edge.

    ``h`` is the heavy character there.  ``replaced``, ``skipped`` and ``put_in`` say
    whether the subtree to merge with has the word's next edge at all, ``met`` whether
    the node has another light character.
    """
    edges = trie_edges(words)
    ahead = [F.bit_or(_bit("e", half)).alias(f"e{half}") for half in (0, 1)]
    children = edges.groupBy("d", "p", "c").agg(F.count(F.lit(1)).alias("words"), *ahead)
    heavy = F.max(F.when(F.col("c") != END, F.struct("words", "c", "e0", "e1"))).alias("heavy")
    own = [F.bit_or(_bit("c", half)).alias(f"c{half}") for half in (0, 1)]
    nodes = children.groupBy("d", "p").agg(F.count(F.lit(1)).alias("branches"), F.count_if(F.col("c") != END).alias("letters"), F.sum("words").alias("words"), heavy, *own).where("branches > 1")
    nodes = stored(nodes.select("d", "p", "words", F.col("heavy.c").alias("h"), (F.col("letters") > 2).alias("met"), F.col("heavy.e0").alias("h0"), F.col("heavy.e1").alias("h1"), "c0", "c1"), "nodes")
    many = nodes.where(F.col("words") > crowded)
    found = edges.join(nodes, ["d", "p"])
    if not many.isEmpty():
        kept = ["k", "d", "c", "e", "h", "met", "h0", "h1", "c0", "c1"]
        tiered = edges.join(broadcast_if_small(many.drop("words"), MOST_CROWDED), ["d", "p"], "left")
        few = tiered.where("h IS NULL").select("k", "d", "p", "c", "e").join(nodes.where(F.col("words") <= crowded), ["d", "p"])
        found = tiered.where("h IS NOT NULL").select(kept).unionByName(few.select(kept))
    inner = F.col("c") != END
    light = found.where("c != h").select(
        "k", "d", "h", (inner & _has("h", "e")).alias("replaced"), (inner & _has("c", "e") & F.expr("c != e")).alias("skipped"), _has("h", "c").alias("put_in"), (inner & F.col("met")).alias("met")
    ).where("replaced OR skipped OR put_in OR met")
    return light.join(words.withColumn("k", F.xxhash64("word")), "k").drop("k")


def _best(n: str, word: str) -> Column:
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("form")).alias("best")


def near_words(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``(word, n_near, best)`` of words ``(word, n)`` that have near words; best is ``(less: -n, form)`` of the near word of largest n."""
    light = stored(light_edges(words, crowded), "light")
    # Letters are at most U+00FF, which is what char() takes.
    p, a, x, h = F.substr("word", F.lit(1), F.col("d")), F.substr("word", F.col("d") + 1, F.lit(1)), F.substr("word", F.col("d") + 2), F.char("h")
    keys = F.array_compact(F.array(F.when(F.col("replaced"), F.concat(p, h, x)), F.when(F.col("skipped"), F.concat(p, x)), F.when(F.col("put_in"), F.concat(p, h, a, x))))
    wanted = light.where("replaced OR skipped OR put_in").select("word", "n", F.explode(keys).alias("key"))
    met = wanted.join(words.select(F.col("word").alias("key"), F.col("n").alias("m")), "key")
    sides = F.array(F.struct("word", _best("m", "key")), F.struct(F.col("key").alias("word"), _best("n", "word")))
    pairs = met.select(F.explode(sides).alias("s")).select("s.word", F.lit(1).cast("long").alias("n_near"), "s.best")
    # Light words of a node with one rest: at most one for each letter.  The best other one is the first or, for the first, the second.
    group = Window.partitionBy("d", "rest")
    ranked = light.where("met").select("word", "n", "d", F.concat(p, x).alias("rest"), _best("n", "word"))
    ranked = ranked.select("word", F.lead("best").over(group.orderBy("best")).alias("behind"), F.first("best").over(group.orderBy("best")).alias("top"), F.row_number().over(group.orderBy("best")).alias("at"), F.count(F.lit(1)).over(group).alias("size"))
    others = ranked.where("size > 1").select("word", (F.col("size") - 1).alias("n_near"), F.when(F.col("at") == 1, F.col("behind")).otherwise(F.col("top")).alias("best"))
    return pairs.unionByName(others).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the last of the chain word, form, form of the form, ...; pointers double, so rounds are the logarithm of the longest chain."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(further, "root", "left_semi").isEmpty():
            return at
        at = stored(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, crowded: int = CROWDED) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word."""
    # Ranges of words share prefixes, so that edges are counted before they are shuffled.
    words = stored(word_counts(docs, id_col, text, min_length, min_count).repartitionByRange("word"), "words")
    found = words.join(near_words(words, crowded), "word", "left")
    form_n = -F.col("best.less")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form_n >= ratio * F.col("n"), F.col("best.form")).alias("form"), F.when(form_n >= ratio * F.col("n"), form_n).alias("form_n"))
    found = stored(found, "variants")
    rooted = found.join(roots(found.where("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
