"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document draws a uniform u from its id and text and gets the exponential
key ``-ln(u) / w``, w being a quality weight; ascending keys are a weighted
sample without replacement.  A source takes as many complete epochs as fit its
target and then documents in key order until the rest of the target is reached,
the document at the border being taken if that comes closer.

Sizes are first summed by source and slice of the keys' logarithm, which spreads
keys of any weight over slices; the slice that holds the border is found from
these sums.  Its rows are sliced again, between their own least and greatest
key, until at most ``ORDERED`` rows of a source are left; only these are ordered.
So no task gathers a source, however large or evenly weighted.

Null texts have size 0; null sources are one source, last in order; rows equal
in id and text have one key, are one row where keys are ordered, and are taken or
left together; null ids are allowed; an empty table gives an empty result;
:func:`mixed` keeps all columns, other functions ignore those they don't name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .bounded import broadcast_if_small
from ..storage import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Characters that prose seldom holds; their number per word lowers the weight.
MARKS = r"[!#$%&*|<>{}~^=+@\\]"
SOURCE_WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2.0
#: Slices a unit of the keys' logarithm, slices of a later cut, and rows of a source that may be ordered in one task.
SLICES, CUTS, ORDERED = 64, 2048, 100_000


def source_key(source: Column) -> Column:
    """Never null, ordered by code point with null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def sampling_columns(doc_id: Column, text: Column, seed: int = 0) -> dict[str, Column]:
    """``size, key`` of a document."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    size = F.regexp_count(body, F.lit(WORD)).cast("long")
    marks = F.regexp_count(body, F.lit(MARKS))
    weight = F.greatest(F.lit(0.05), 1.0 - marks / F.greatest(size, F.lit(1)))
    drawn = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|"), body).cast("binary"))
    # 48 bits and a half: u is never 0 or 1, so keys are positive and finite.
    u = (F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return {"size": size, "key": -F.ln(u) / weight}


def targets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``sk, source_size, target`` from ``sizes(sk, source_size)``, one row a source.

    Shares follow the weights; a target stops at ``most`` times its source and
    the excess is shared again.  That is filling to one level: with sources
    ordered by cap per weight, the level is the largest of (total - caps before)
    / (weights from here on).  The windows run over sources, not documents: a
    row of three numbers a source, so a million sources are a few dozen MB.
    """
    ordered = Window.orderBy("sk")
    place = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double")
    rows = sizes.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "sk")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = total * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("step", left / F.sum("w").over(after))
    rows = rows.withColumn("level", F.max("step").over(everything))
    return rows.select("sk", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _border(slices: DataFrame, goals: DataFrame) -> DataFrame:
    """``sk, slice, before, rest, n, low, high`` of the slice of each source where its sums reach ``rest``.

    ``slices(sk, slice, s, n, low, high)``; ``goals(sk, above, rest)``, above being the sum before all these slices.
    """
    ahead = Window.partitionBy("sk").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    at = slices.join(broadcast_if_small(goals, 100_000), "sk").withColumn("before", F.col("above") + F.coalesce(F.sum("s").over(ahead), F.lit(0)))
    at = at.where("before < rest and before + s >= rest")
    first = F.min_by(F.struct("slice", "before", "rest", "n", "low", "high"), "slice").alias("b")
    return at.groupBy("sk").agg(first).select("sk", "b.*")


def _slices(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sk", "slice").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


def _inside(rows: DataFrame, border: DataFrame) -> DataFrame:
    """``sk, key, size`` of the rows in border slices."""
    return rows.join(broadcast_if_small(border.select("sk", "slice"), 100_000), ["sk", "slice"]).select("sk", "key", "size")


def border_rows(sized: DataFrame, goals: DataFrame, slices: DataFrame, per_unit: int = SLICES, cuts: int = CUTS, ordered: int = ORDERED) -> tuple[DataFrame, DataFrame]:
    """``(border, rows)``: the last border slice of each source and its rows, at most ``ordered`` a source or all of one key."""
    first_slice = F.floor(F.ln("key") * per_unit).cast("int")
    border = stored(_border(slices, goals.select("sk", F.lit(0).cast("long").alias("above"), "rest")), "borders")
    rows = stored(_inside(sized.withColumn("slice", first_slice), border), "border_rows")
    done: list[tuple[DataFrame, DataFrame]] = []
    while True:
        wide = (F.col("n") > ordered) & (F.col("low") < F.col("high"))
        done.append((border.where(~wide), rows))
        border = border.where(wide)
        if border.isEmpty():
            break
        span = broadcast_if_small(border.select("sk", "low", "high"), 100_000)
        # The least key of the border slice is in cut 0 and the greatest in the last, so each cut splits it.
        part = F.least(F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * cuts), F.lit(cuts - 1)).cast("int")
        finer = stored(rows.join(span, "sk").select("sk", "key", "size", part.alias("slice")), "finer")
        border = stored(_border(_slices(finer), border.select("sk", F.col("before").alias("above"), "rest")), "borders")
        rows = stored(_inside(finer, border), "border_rows")
    borders, found = None, None
    for some, its in done:
        its = its.join(broadcast_if_small(some.select("sk"), 100_000), "sk", "left_semi")
        borders, found = (some, its) if borders is None else (borders.unionByName(some), found.unionByName(its))
    return borders, found


def borders(sized: DataFrame, per_unit: int = SLICES, cuts: int = CUTS, ordered: int = ORDERED, **options) -> DataFrame:
    """``sk, source_size, target, epochs, last, least``: how far each source is taken once more.

    ``sized`` has ``sk, size, key``.  Keys up to ``last`` are, or, where that is
    null, keys below ``least``; where both are null, none.
    """
    slices = stored(_slices(sized.withColumn("slice", F.floor(F.ln("key") * per_unit).cast("int"))), "slices")
    goals = targets(slices.groupBy("sk").agg(F.sum("s").alias("source_size")), **options)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goals = stored(goals, "targets")
    at, inside = border_rows(sized, goals, slices, per_unit, cuts, ordered)
    at = stored(at, "edges")
    equal = inside.groupBy("sk", "key").agg(F.sum("size").alias("size")).join(broadcast_if_small(at.select("sk", "before", "rest"), 100_000), "sk")
    in_order = Window.partitionBy("sk").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0)) + F.col("size") / 2.0
    last = equal.withColumn("reached", reached).where("reached <= rest").groupBy("sk").agg(F.max("key").alias("last"))
    found = goals.join(at.select("sk", F.col("low").alias("least")), "sk", "left").join(last, "sk", "left")
    return stored(found.select("sk", "source_size", "target", "epochs", "last", "least"), "cutoffs")


def copies() -> Column:
    """How often a document is taken, from the columns of :func:`borders` and its ``key``."""
    more = F.when(F.col("least").isNull(), False).when(F.col("last").isNull(), F.col("key") < F.col("least")).otherwise(F.col("key") <= F.col("last"))
    return F.col("epochs") + more.cast("long")


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **options) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` of every document."""
    columns = sampling_columns(F.col(id_col), F.col(text), seed)
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), source_key(F.col(source)).alias("sk"), *(c.alias(n) for n, c in columns.items())), "sized")
    rows = sized.join(broadcast_if_small(borders(sized.select("sk", "size", "key"), **options), 100_000), "sk")
    return rows.select("doc_id", "size", "source_size", "target", copies().alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    columns = sampling_columns(F.col(id_col), F.col(text), seed)
    sized = stored(docs.select(source_key(F.col(source)).alias("sk"), *(c.alias(n) for n, c in columns.items())), "sized")
    goals = broadcast_if_small(borders(sized, **options).select("sk", "epochs", "last", "least"), 100_000)
    whole = docs.select(F.struct("*").alias("doc"), source_key(F.col(source)).alias("sk"), columns["key"].alias("key"))
    rows = whole.join(goals, "sk").withColumn("times", copies()).where("times > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
