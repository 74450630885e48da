"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared by their words (runs of white space are one space).  Equal
lines are collapsed first.  For lines of ``min_words`` words or more the edit
bound is one word inserted, deleted or replaced: every line emits itself and
all its variants with one word deleted as 64-bit keys, and

* two lines that share a variant deleted at one position differ by one
  replaced word: any two lines of such a group do, so each is linked to the
  group's earliest line alone;
* a line that equals a variant of another differs from it by one inserted
  word, and is linked to the earliest such line, and that to it.

So a template that many lines fill costs one link a line.  The earliest linked
line of each line is then compared word by word.  A line is dropped if it
repeats an earlier line or is within the bound of one; the earliest occurrence
(smallest document id, null first, then position) stays.

Only lines that share their first or last half with another line can be within
the bound of it; all others are set aside before variants are emitted, by keys
that are counted, never paired.

Null and empty texts have no lines; blank lines are kept and not counted; rows
equal in id and text are one document and each get its result; an empty table
gives an empty result; other columns are kept by :func:`cleaned`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .bounded import broadcast_if_small
from ..storage import stored

#: Shorter lines are near anything: by default, only exact repeats of them are dropped.
MIN_WORDS = 5
#: Words whose running hashes are folded together at a time, so that long lines stay cheap.
_BLOCK = 64


def normal(line: Column) -> Column:
    """Runs of white space as one space; the few lines that need it are found by plain searches first."""
    odd = F.contains(line, F.lit("  "))
    for mark in ("\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(line, F.lit(mark))
    return F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\r\x0B\x0C]+", " ")).otherwise(line))


def _exploded(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("t")).where("t is not null")
    lines = body.select("doc_id", F.xxhash64("t").alias("h"), F.posexplode(F.split("t", "\n")).alias("pos", "raw"))
    return lines.select("doc_id", "h", "pos", normal(F.col("raw")).alias("line")).where("line <> ''")


def word_count(line: Column) -> Column:
    """Words of a normal line."""
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("int")


def half_keys(line: Column, n: Column) -> Column:
    """Keys of the halves that a line within one word of this one, of ``n`` words, must share one of."""
    def ends(m: Column) -> list[Column]:
        return [F.xxhash64(F.lit(mark), m, F.call_function("substring_index", line, F.lit(" "), count)) for mark, count in (("p", m), ("s", -m))]

    half = F.floor(n / 2).cast("int")
    # A line of n words meets lines of n + 1 by the half of n words, of n - 1 by the half of n - 1.
    return F.when(n % 2 == 0, F.array(*ends(half), *ends(half - 1))).otherwise(F.array(*ends(half)))


def _folded(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))


def _variants(lines: DataFrame) -> DataFrame:
    """``id, v, i`` from ``lines(id, words)``: a key of the line without its word i, and of the whole line as i = -1.

    A key is the exclusive or of the hashes of (word, place), words behind the
    deleted one moving up a place.  Running values are kept by block of words,
    so a line costs its length.  The arrays are written between steps: inlined
    into a lambda they would be computed again for each word.
    """
    here = F.transform("words", lambda w, j: F.xxhash64(w, j))
    moved = F.transform("words", lambda w, j: F.xxhash64(w, j - 1))
    both = F.zip_with(here, moved, lambda a, b: a.bitwiseXOR(b))
    hashed = stored(lines.select("id", moved.alias("moved"), both.alias("both"), _folded(here).alias("whole"), _folded(moved).alias("rest")), "hashed")
    block = F.floor((F.size("both") - 1) / _BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), block), lambda b: _folded(F.slice(F.col("both"), b * _BLOCK + 1, F.lit(_BLOCK))))
    running = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(x))))
    hashed = stored(hashed.withColumn("running", running), "running")

    def without(x: Column, i: Column) -> Column:
        b = F.floor(i / _BLOCK).cast("int")
        before = F.get(F.col("running"), b).bitwiseXOR(_folded(F.slice(F.col("both"), b * _BLOCK + 1, i - b * _BLOCK)))
        return before.bitwiseXOR(F.col("rest")).bitwiseXOR(x)

    keys = hashed.select("id", F.posexplode(F.transform("moved", without)).alias("i", "v"))
    return keys.select("id", "v", "i").unionByName(hashed.select("id", F.col("whole").alias("v"), F.lit(-1).alias("i")))


def within_one(a: Column, b: Column) -> Column:
    """Whether two different word arrays differ by one word inserted, deleted or replaced."""
    def differing(x: Column, y: Column) -> Column:
        return F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda t: t))

    def longer(x: Column, y: Column) -> Column:
        # x has one word more: behind the first difference, it runs one place ahead.
        n = F.size(y)
        at = F.coalesce(F.array_position(F.zip_with(F.slice(x, F.lit(1), n), y, lambda p, q: p != q), F.lit(True)), F.lit(0)).cast("int")
        return (at == 0) | (F.slice(x, at + 1, n) == F.slice(y, at, n))

    same = (F.size(a) == F.size(b)) & (differing(a, b) <= 1)
    return same | F.when(F.size(a) == F.size(b) + 1, longer(a, b)).when(F.size(b) == F.size(a) + 1, longer(b, a)).otherwise(False)


def _near(docs: DataFrame, firsts: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, of)``: lines within the bound of an earlier line, and the earliest such line."""
    keyed = firsts.where("keys is not null").select("id", F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "halves")
    some = stored(keyed.join(broadcast_if_small(shared, 500_000), "key").select("id").distinct().join(firsts.select("id", "first"), "id"), "candidates")
    at = broadcast_if_small(some.select(F.col("id").alias("c"), F.col("first.doc_id").alias("d"), F.col("first.h").alias("ch"), F.col("first.pos").alias("p")), 200_000)
    rows = _exploded(docs, id_col, text).join(at, (F.col("h") == F.col("ch")) & (F.col("pos") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")))
    lines = stored(rows.select(F.col("c").alias("id"), "line").dropDuplicates(["id"]).select("id", F.split("line", " ").alias("words")), "lines")
    keys = stored(_variants(lines), "variants")
    again = stored(keys.groupBy("v").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("v"), "shared")
    met = stored(keys.join(again, "v").join(some.select("id", "first"), "id"), "met")
    leads = stored(met.groupBy("v", "i").agg(F.min(F.struct("first", "id")).alias("lead")), "leads")
    replaced = met.where("i >= 0").join(leads, ["v", "i"]).select("id", "first", "lead")
    wholes = leads.where("i = -1").select("v", "lead")
    longer = met.where("i >= 0").join(wholes, "v").select("id", "first", "lead")
    earliest = leads.where("i >= 0").groupBy("v").agg(F.min("lead").alias("lead"))
    shorter = met.where("i = -1").join(earliest, "v").select("id", "first", "lead")
    pairs = replaced.unionByName(longer).unionByName(shorter).where("lead.first < first").select("id", F.col("lead.id").alias("of"), F.col("lead.first").alias("of_first")).distinct()
    checked = pairs.join(lines, "id").join(lines.select(F.col("id").alias("of"), F.col("words").alias("other")), "of").where(within_one(F.col("words"), F.col("other")))
    return checked.groupBy("id").agg(F.min(F.struct("of_first", "of")).alias("m")).select("id", F.col("m.of").alias("of"))


def line_states(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, h, pos, state`` of every line that isn't blank; h is the hash of the text, state 0 kept, 1 repeated, 2 near an earlier line.

    With ``min_words`` 1 all lines are compared; any two of one word are then
    within the bound.
    """
    n = F.col("n")
    keys = F.when(n >= min_words, half_keys(F.col("line"), n))
    lines = stored(_exploded(docs, id_col, text).withColumn("n", word_count(F.col("line"))).select("doc_id", "h", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("id"), keys.alias("keys")), "occurrences")
    firsts = stored(lines.groupBy("id").agg(F.min(F.struct("doc_id", "pos", "h")).alias("first"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n")), "firsts")
    near = stored(_near(docs, firsts, id_col, text), "near")
    # Lines that occur once and are near no other need no word from anywhere.
    marked = firsts.select("id", "first", "n").join(near.select("id", F.lit(True).alias("near")), "id", "left").where("n > 1 or near")
    known = broadcast_if_small(stored(marked.select(F.col("id").alias("known"), "first", "near"), "known"), 200_000)
    rows = lines.select("doc_id", "h", "pos", "id").join(known, F.col("id") == F.col("known"), "left")
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h")) & (F.col("first.pos") == F.col("pos"))
    return rows.select("doc_id", "h", "pos", F.when(F.col("known").isNull(), 0).when(~first, 1).when(F.col("near"), 2).otherwise(0).alias("state"))


def _by_document(states: DataFrame) -> DataFrame:
    at = F.array_sort(F.collect_set(F.struct("pos", "state")))
    return states.groupBy("doc_id", "h").agg(at.alias("lines"))


def summary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_exact, n_near, kept_lines``, a row for each row of ``docs``; ``kept_lines`` are places, comma-joined."""
    by_doc = _by_document(line_states(docs, id_col, text, min_words)).withColumnsRenamed({"doc_id": "d", "h": "dh"})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    rows = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh")), "left")
    rows = rows.withColumn("lines", F.coalesce("lines", F.expr("cast(array() as array<struct<pos:int,state:int>>)")))
    return rows.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x["state"] == 1)).cast("long").alias("n_exact"),
        F.size(F.filter("lines", lambda x: x["state"] == 2)).cast("long").alias("n_near"),
        F.array_join(F.transform(F.filter("lines", lambda x: x["state"] == 0), lambda x: x["pos"].cast("string")), ",").alias("kept_lines"),
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, all columns, with repeated and near-repeated lines taken out of ``text``."""
    by_doc = _by_document(line_states(docs, id_col, text, min_words)).where("exists(lines, x -> x.state > 0)")
    by_doc = by_doc.select(F.col("doc_id").alias("d"), F.col("h").alias("dh"), F.expr("transform(filter(lines, x -> x.state > 0), x -> x.pos)").alias("gone"))
    body = F.col(text).cast("string")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.xxhash64(body).alias("key"), body.alias("body"))
    rows = rows.join(by_doc, F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("dh")), "left")
    # What stays lies between the places that go: slices, so that no line searches the list.
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    lines = F.split("body", "\n")
    ends = F.concat(F.col("gone"), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(F.col("split"), a + 1, b - a)))
    rows = rows.withColumn("split", F.when(F.col("gone").isNotNull(), lines))
    fresh = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n"))
    return rows.select("doc.*", fresh.alias("fresh")).withColumn(text, F.col("fresh")).select(*docs.columns)
