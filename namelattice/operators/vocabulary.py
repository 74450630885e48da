"""The vocabulary of a corpus and how its tokens fall into smaller ones.

Children of a token are, in order and each once: its parts around trailing
digits, its runs of letters and digits, and parts that follow another token of
the vocabulary inside it (a token of three characters or more that occurs
exactly once, digits coming next).  A token used up that way serves no longer
token.  Tokens inside others are found by an equi-join on short runs of
characters; what is used up is settled from short tokens to long ones, a join a
round, and so are leaves, a level of children a round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.text import TOKENIZERS, split_runs, split_trailing
from ..storage import stored


def tokenized(points: DataFrame, tokenizer: str = "simple", mode: str = "truncate") -> DataFrame:
    """``point_name, tokens``, one row a distinct non-empty name."""
    names = points.where("point_name <> ''").select("point_name").distinct()
    return names.select("point_name", TOKENIZERS[tokenizer](F.col("point_name"), mode).alias("tokens"))


def unique_tokens(names: DataFrame) -> DataFrame:
    return names.select("point_name", F.array_distinct("tokens").alias("tokens"))


def token_frequency(names: DataFrame) -> DataFrame:
    """``token, size, frequency``: occurrences over all names."""
    rows = names.select(F.explode("tokens").alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("frequency")).select("token", F.length("token").cast("long").alias("size"), "frequency")


def by_frequency(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.orderBy(F.desc("frequency"), "token")


def by_size(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.orderBy("size", "token")


def base_children(token):
    """Children by digits and runs alone, as a column."""
    parts = F.array_distinct(F.concat(split_trailing(token), F.flatten(F.transform(split_trailing(token), split_runs)), split_runs(token)))
    return F.filter(F.array_distinct(F.concat(split_trailing(token), split_runs(token))), lambda t: t != token), parts


def closed(vocabulary: DataFrame) -> DataFrame:
    """``token``: the vocabulary with all parts of its tokens."""
    _, parts = base_children(F.col("token"))
    return vocabulary.select(F.explode(F.concat(F.array("token"), parts)).alias("token")).distinct()


#: Lengths of the runs of characters that tokens inside others are found by; a token goes by the longest it has room for.
GRAMS = (3, 4, 6, 9)


def _grams(token, size: int):
    """The different runs of ``size`` characters of a token of so many or more, as a column."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) - (size - 1)), lambda at: F.substr(token, at, F.lit(size))))


def meeting(targets: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``token, piece``: targets with those tokens of the vocabulary of three characters or more whose rarest run of characters they have.

    Runs are three to nine characters, longer ones for longer tokens: numbers of six digits have runs of three in
    common with a share of all others, so that pairs would grow with their square.  Rows grow with the length of
    the targets, not its square, and frequent runs make pairs only for tokens that have no other.
    """
    token = F.col("token")
    grams = inner = None
    for size, longer in zip(GRAMS, (*GRAMS[1:], None)):
        runs = targets.where(F.length("token") >= max(size, 4)).select("token", F.explode(_grams(token, size)).alias("gram"))
        fits = F.length("token") >= size if longer is None else F.length("token").between(size, longer - 1)
        pieces = vocabulary.where(fits).select(token.alias("piece"), F.explode(_grams(token, size)).alias("gram"))
        grams = runs if grams is None else grams.unionByName(runs)
        inner = pieces if inner is None else inner.unionByName(pieces)
    rarity = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # A run that no target has settles that the token is inside none.
    ranked = inner.join(rarity, "gram", "left").groupBy("piece").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("rarest"))
    rarest = ranked.where("rarest.df > 0").select("piece", F.col("rarest.gram").alias("gram"))
    return grams.join(rarest, "gram").select("token", "piece")


def inside(targets: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``token, piece``: tokens of the vocabulary of three characters or more inside each target, of those that :func:`meeting` lets meet."""
    return meeting(targets, vocabulary).where((F.col("piece") != F.col("token")) & F.contains(F.col("token"), F.col("piece")))


def beside(pairs: DataFrame) -> DataFrame:
    """``token, piece, parts`` of those ``pairs(token, piece)`` whose piece occurs once and leaves parts: digits, and letters behind them, at the start of what is before or behind it."""
    placed = pairs.withColumn("at", F.expr("locate(piece, token)")).where("at > 0 AND locate(piece, token, at + length(piece)) = 0")
    sides = [F.expr("substr(token, 1, at - 1)"), F.expr("substr(token, at + length(piece))")]
    parts = F.array(*(F.regexp_extract(side, "^([0-9]+)([A-Z]+)?", group) for side in sides for group in (1, 2)))
    return placed.withColumn("parts", F.filter(parts, lambda part: part != "")).where("size(parts) > 0").select("token", "piece", "parts")


def followed(pairs: DataFrame) -> DataFrame:
    """``token, parts`` of ``pairs(token, piece, parts)``: what the first piece that isn't used up itself, by length and name, leaves of each token.

    A token is used up if some piece of it isn't.  Pieces are shorter, so in each
    round those tokens are settled whose pieces are; rounds follow the
    longest chain of pieces inside pieces.
    """
    waiting = stored(pairs.select("token", "piece"), "waiting")
    used = None
    while not waiting.isEmpty():
        # A piece that neither waits nor was found used up, which would have taken it off here, is free.
        free = waiting.join(waiting.select(F.col("token").alias("piece")).distinct(), "piece", "left_anti")
        new = stored(free.select("token").distinct(), "used")
        used = new if used is None else used.unionByName(new)
        rest = waiting.join(new, "token", "left_anti").join(new.withColumnRenamed("token", "piece"), "piece", "left_anti")
        waiting = stored(rest.select("token", "piece"), "waiting")
    if used is None:
        return pairs.select("token", "parts")
    return pairs.join(used.withColumnRenamed("token", "piece"), "piece", "left_anti").groupBy("token").agg(F.min_by("parts", F.struct(F.length("piece"), "piece")).alias("parts"))


def _leaves(falls: DataFrame) -> DataFrame:
    """``token, leaves`` of ``falls(token, children)``: children of children and so on, in order, a level a round."""
    children = falls.where(F.size("children") > 0).select(F.col("token").alias("part"), "children")
    level = falls.select("token", F.array().cast("array<int>").alias("place"), F.col("token").alias("part"))
    done = []
    while True:
        met = stored(level.join(children, "part", "left"), "level")
        done.append(met.where("children IS NULL").select("token", "place", "part"))
        more = met.where("children IS NOT NULL")
        if more.isEmpty():
            break
        level = more.select("token", "place", F.posexplode("children").alias("pos", "part")).select("token", F.concat("place", F.array("pos")).alias("place"), "part")
    rows = done[0]
    for further in done[1:]:
        rows = rows.unionByName(further)
    # As many rows a token as it has leaves.
    return rows.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("l")).select("token", F.col("l.part").alias("leaves"))


@dataclass(frozen=True)
class Fall:
    """How a vocabulary falls apart: with its parts by digits and runs (``closed``), what tokens inside others leave in two passes, all tokens in the end."""

    closed: DataFrame
    first: DataFrame
    second: DataFrame
    tokens: DataFrame


def fall(vocabulary: DataFrame) -> Fall:
    digits = F.col("token").rlike("[0-9]")
    words = stored(closed(vocabulary), "vocabulary")
    first = stored(followed(stored(beside(inside(words.where(digits), words)), "beside")), "first")
    new = first.select(F.explode("parts").alias("token")).distinct().join(words, "token", "left_anti")
    if new.isEmpty():  # the second pass then sees what the first saw
        return Fall(words, first, first, words)
    more = stored(words.unionByName(new), "vocabulary")
    second = stored(followed(stored(beside(inside(more.where(digits), more)), "beside")), "second")
    return Fall(words, first, second, stored(more.unionByName(second.select(F.explode("parts").alias("token"))).distinct(), "vocabulary"))


def decomposed(vocabulary: DataFrame, fallen: Fall | None = None) -> DataFrame:
    """``token, children, leaves`` of every token of the closed vocabulary."""
    fallen = fallen or fall(vocabulary)
    rows = fallen.tokens.join(fallen.first.withColumnRenamed("parts", "first"), "token", "left").join(fallen.second.withColumnRenamed("parts", "second"), "token", "left")
    none = F.array().cast("array<string>")
    parts = F.concat(split_trailing(F.col("token")), split_runs(F.col("token")), F.coalesce("first", none), F.coalesce("second", none))
    falls = stored(rows.select("token", F.filter(F.array_distinct(parts), lambda part: part != F.col("token")).alias("children")), "children")
    return falls.join(_leaves(falls), "token")


def frequency_after(vocabulary: DataFrame, fallen: Fall | None = None) -> DataFrame:
    """``token, size, frequency, frequency_after`` of every token of the closed vocabulary; frequency is null for parts that no name has as a token.

    Each time that a pass yields a part, it counts one more, also where a token is its own
    part; the passes are trailing digits, runs, parts beside others twice, trailing digits
    again.  A token's first link to a part other than itself adds the token's own frequency in the end less one.
    Parts are shorter than their token, so weights are handed on from long tokens to
    short ones, a level a round.
    """
    fallen = fallen or fall(vocabulary)
    token = F.col("token")
    trailing = vocabulary.select("token", F.explode(split_trailing(token)).alias("part"))
    once = vocabulary.select("token").unionByName(trailing.select(F.col("part").alias("token"))).distinct()
    yielded = trailing.unionByName(once.select("token", F.explode(split_runs(token)).alias("part")))
    for beside_others in (fallen.first, fallen.second):
        yielded = yielded.unionByName(beside_others.select("token", F.explode("parts").alias("part")))
    yielded = stored(yielded.unionByName(fallen.tokens.select("token", F.explode(split_trailing(token)).alias("part"))).groupBy("token", "part").agg(F.count(F.lit(1)).alias("times")), "yielded")
    links = yielded.where("token != part").select("token", "part")
    times = yielded.groupBy(F.col("part").alias("token")).agg(F.sum("times").alias("times"))
    base = fallen.tokens.join(vocabulary.select("token", "frequency"), "token", "left").join(times, "token", "left")
    base = stored(base.select("token", "frequency", (F.coalesce("frequency", F.lit(0)) + F.coalesce("times", F.lit(0)) - 1).alias("less_one")), "base")
    handed, sums = base.select("token", "less_one"), []
    while True:
        handed = stored(handed.join(links, "token").groupBy(F.col("part").alias("token")).agg(F.sum("less_one").alias("less_one")), "handed")
        if handed.isEmpty():
            break
        sums.append(handed)
    total = base.select("token", "less_one")
    for more in sums:
        total = total.unionByName(more)
    total = total.groupBy("token").agg((F.sum("less_one") + 1).alias("frequency_after"))
    return base.join(total, "token").select("token", F.length("token").cast("long").alias("size"), "frequency", "frequency_after")


def expanded(names: DataFrame, decomposition: DataFrame) -> DataFrame:
    """``point_name, path``: every token of a name replaced by its leaves, in order, repeats kept.

    Tokens of letters alone never fall apart, so they are their own leaves; these are the tokens that most names share.
    """
    rows = names.select("point_name", F.posexplode("tokens").alias("pos", "token"))
    letters = F.col("token").rlike(r"^\p{L}+$")
    whole = rows.where(letters).select("point_name", "pos", F.array("token").alias("leaves"))
    fallen = rows.where(~letters).join(decomposition.select("token", "leaves"), "token").select("point_name", "pos", "leaves")
    parts = whole.unionByName(fallen).groupBy("point_name").agg(F.array_sort(F.collect_list(F.struct("pos", "leaves"))).alias("parts"))
    return parts.select("point_name", F.flatten(F.col("parts.leaves")).alias("path"))
