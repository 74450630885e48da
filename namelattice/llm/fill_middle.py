"""Fill-in-middle texts: a prefix, a middle and a suffix, cut between units and put in another order.

A unit is a run of white space with the word behind it; all of it is relational.
Texts to cut are dealt by a key of their content, once; their units are exploded
with ordinals, a window sums unit lengths to ends, requests ("after unit c") meet
units by key and ordinal, the ends are gathered for each text, and ``substr``
cuts.  Units never cross the network: window and joins use the deal of the texts.
Texts that stay plain aren't dealt at all.

Rows equal in id and text are cut once and joined back to each row.  Null texts
count as empty; empty texts and such as hold a tag stay plain; a null id draws
as the word ``null``; a text of any length is cut whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SPACE = r"\x20\x09-\x0D"
UNIT = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, CUT_PERCENT, SPM_PERCENT = 42, 50, 80
_KEY = ["k", "l"]


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _units(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _cut(texts: DataFrame) -> DataFrame:
    """``texts(k, l, i, t, n, ...)``, one row a key, with the offsets ``a`` and ``b`` in code points where prefix and middle end: after units ``least`` and ``greatest`` of ``h1 % (n + 1)`` and ``h2 % (n + 1)``."""
    after = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    # Texts, requests and units read the same columns of the dealt texts, so that they share one exchange: requests look at
    # the text's size, and units take id and count along.
    requests = texts.where("octet_length(t) > 0").select(*_KEY, F.least(*after).alias("first"), F.greatest(*after).alias("second"))
    units = texts.select(*_KEY, "i", "n", F.posexplode(_units("t")).alias("pos", "unit")).select(*_KEY, "i", "n", (F.col("pos") + 1).alias("ordinal"), F.length("unit").alias("size"))
    running = Window.partitionBy(*_KEY, "i", "n").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.withColumn("end", F.sum("size").over(running)).drop("i", "n")
    met = ends.join(requests, _KEY).where("ordinal = first OR ordinal = second")
    offsets = met.groupBy(*_KEY).agg(F.max(F.when(F.expr("ordinal = first"), F.col("end"))).alias("a"), F.max(F.when(F.expr("ordinal = second"), F.col("end"))).alias("b"))
    return texts.join(offsets, _KEY, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in "ab"})


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``(id_col, n, form, prefix_chars, middle_chars, output)``, a row for each document; form is plain, psm or spm."""
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    h1, h2, h3, h4 = _draws(F.col("i"), seed)
    tagged = F.contains("t", F.lit(PREFIX)) | F.contains("t", F.lit(SUFFIX)) | F.contains("t", F.lit(MIDDLE))
    stays = (F.col("t") == "") | tagged | (h3 % 100 >= cut_percent)
    plain = rows.where(stays).select("i", F.size(_units("t")).cast("long").alias("n"), F.lit("plain").alias("form"), *(F.lit(None).cast("long").alias(c) for c in ("prefix_chars", "middle_chars")), F.col("t").alias("output"))
    # Two hashes of id and text: never null, so that joins use the deal by them as it is.
    keyed = rows.where(~stays).select("i", "t", F.xxhash64("i", "t").alias("k"), F.xxhash64("t", F.lit(1), "i").alias("l"))
    counted = keyed.withColumn("n", F.size(_units("t")).cast("long"))
    cut = _cut(counted.dropDuplicates(_KEY).withColumns({"h1": h1, "h2": h2}))
    spm = h4 % 100 < spm_percent
    pieces = cut.select(
        *_KEY, "n", F.when(spm, F.lit("spm")).otherwise(F.lit("psm")).alias("form"), F.col("a").alias("prefix_chars"), (F.col("b") - F.col("a")).alias("middle_chars"),
        F.concat(F.lit(PREFIX), F.substr("t", F.lit(1), F.col("a"))).alias("p"), F.concat(F.lit(SUFFIX), F.substr("t", F.col("b") + 1)).alias("s"), F.concat(F.lit(MIDDLE), F.substr("t", F.col("a") + 1, F.col("b") - F.col("a"))).alias("m"),
    )
    head = F.when(F.col("form") == "spm", F.concat("s", "p")).otherwise(F.concat("p", "s"))
    moved = pieces.select(*_KEY, "n", "form", "prefix_chars", "middle_chars", F.concat(head, F.col("m")).alias("output"))
    moved = keyed.select("i", *_KEY).join(moved, _KEY).drop(*_KEY)
    return moved.unionByName(plain).withColumnRenamed("i", id_col)


def _between(output: Column, tag: str, end: str) -> Column:
    return F.substring_index(F.substring_index(output, end, 1), tag, -1)


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`transform` made ``output`` of; a text that was cut holds no tag, so each tag is found once, where it was put."""
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(_between(output, PREFIX, SUFFIX), middle, _between(output, SUFFIX, MIDDLE))
    spm = F.concat(_between(output, PREFIX, MIDDLE), middle, _between(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
