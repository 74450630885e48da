"""Fuzzy scores of token lists against the catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.jaro import alike, jaro_winkler
from ..functions.text import without_digits
from ..storage import ship, stored
from .catalog import Model, catalog, equipment_model

TOKEN_CUT, JOINED_CUT, MOST_POINTS = 0.85, 0.1, 150
#: Tokens of a block that is compared with one of twice as many, about, blocks that fewer tokens are dealt into, if not below so many each, and tasks that the pairs of blocks are dealt over at most.
BLOCK, FEW_BLOCKS, LEAST_BLOCK, MOST_PARTS = 8192, 32, 256, 2000


def _blocks(tokens: DataFrame, column: str, name: str, size: int, few: int = 1) -> tuple[DataFrame, int]:
    """``at, part, column``: distinct non-empty tokens in rows of about ``size``, and the number of different ``at``, ``few`` if tokens suffice.

    Tokens are dealt by hash of their letters, so that orders of the same letters are in one block; what has more than twice ``size`` is parted by hash of the tokens.
    """
    rows = stored(tokens.select(F.col("token").alias(column)).where(F.col(column) != "").distinct(), name)
    count = rows.count()
    n = max(1, -(-count // size), min(few, count // LEAST_BLOCK))
    letters = F.array_join(F.array_sort(F.split(column, "")), "")
    dealt = stored(rows.select(F.pmod(F.xxhash64(letters), F.lit(n)).cast("int").alias("at"), column), name)
    parts = dealt.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * size)).alias("parts"))
    parted = dealt.join(parts, "at").withColumn("part", F.pmod(F.xxhash64(column), "parts").cast("int"))
    return stored(parted.groupBy("at", "part").agg(F.collect_list(column).alias(column)), name), n


def alike_tokens(tokens: DataFrame, others: DataFrame, cut: float = TOKEN_CUT, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """``token, alt_token, similarity``: distinct ``token``s of two tables whose Jaro-Winkler similarity is above ``cut``, 0.82 at least; rounded to ``digits`` if given.

    With ``m`` common characters Jaro is at most ``(m / |a| + m / |b| + 1) / 3``, and a common start
    adds at most four tenths of what lacks to 1.  Tokens are dealt into blocks by their letters, whatever their order; the
    common letters of all such classes of two blocks are a product of matrices, and only what the bound leaves is scored, the
    tokens of a class together.  So each block meets each, as alike pairs can be a fixed share of all (numbers of one length), but no
    pair is shuffled, and memory is bounded by the blocks.  Empty tokens are alike to none.
    """
    if cut < 0.82:  # a common start counts once Jaro is above 0.7
        raise ValueError("cut must be 0.82 or more")
    spark = tokens.sparkSession
    ship(spark)
    (left, n), (right, k) = _blocks(tokens, "token", "tokens", block, FEW_BLOCKS), _blocks(others, "alt_token", "others", 2 * block)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("token"), batch.column("alt_token")):
                for i, j, similarity in alike(a.values.to_pylist(), b.values.to_pylist(), cut, digits):
                    yield pa.RecordBatch.from_arrays([a.values.take(pa.array(i)), b.values.take(pa.array(j)), pa.array(similarity)], names=["token", "alt_token", "similarity"])

    met = left.select("at", "part", "token", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("alt_at"))
    pairs = met.join(right.withColumnsRenamed({"at": "alt_at", "part": "alt_part"}), "alt_at")
    # A number of parts, or the planner would take the few rows for little work and put them in one task.
    return pairs.repartition(max(1, min(n * k, MOST_PARTS)), "at", "alt_at", "part", "alt_part").select("token", "alt_token").mapInArrow(compare, "token string, alt_token string, similarity double")


def token_catalog_similarity(vocabulary: DataFrame, model: Model | None = None) -> DataFrame:
    """``token, alt_token, similarity``: distinct tokens with the catalogue's tokens more than TOKEN_CUT alike."""
    return alike_tokens(vocabulary, catalog(vocabulary.sparkSession, model).select(F.explode("alt_tokens").alias("token")))


def match_score(tokens: list[str], alternative: list[str]) -> float:
    """1 for equal lists; else the mean of each token's best similarity above TOKEN_CUT over the longer list, or, if that is more, the joined tokens against a single-token alternative, weighed by their lengths."""
    if not tokens or not alternative:
        return 0.0
    if tokens == alternative:
        return 1.0
    score = sum(max([s for a in alternative if (s := jaro_winkler(t, a)) > TOKEN_CUT], default=0.0) for t in tokens) / max(len(tokens), len(alternative))
    if len(alternative) == 1:
        joined, other = "".join(tokens), alternative[0]
        weighed = jaro_winkler(joined, other) * (min(len(joined), len(other)) / max(len(joined), len(other)) if joined and other else 0.0)
        if weighed > score and weighed > JOINED_CUT:
            score = weighed
    return score


def best_score(tokens: list[str], alternatives: list[list[str]]) -> float:
    return max([0.0, *(match_score(tokens, alt) for alt in alternatives)])


def label_scores(points: DataFrame, model: Model | None = None) -> DataFrame:
    """``tokens, equip, label, score``: every distinct token list against every label, best alternative."""
    ship(points.sparkSession)
    model = model or equipment_model()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, equip, label, best_score(t, alts)) for t in batch.column("tokens").to_pylist() for equip, labels in model.items() for label, alts in labels.items()]
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = [pa.list_(pa.string()), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tokens", "equip", "label", "score"])

    return points.select("tokens").distinct().mapInArrow(score, "tokens array<string>, equip string, label string, score double")


def without_common_prefix(points: DataFrame) -> DataFrame:
    """``concept_id, rel_path, tokens``: number tokens dropped, then the longest prefix that all lists of a concept share.

    A place counts as shared if all lists have it with one token; concepts with
    one list keep it whole.
    """
    rows = points.select("concept_id", "rel_path", without_digits(F.col("rel_path")).alias("tokens"))
    totals = rows.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("tokens")).alias("shortest"))
    places = rows.select("concept_id", F.posexplode("tokens").alias("at", "token")).groupBy("concept_id", "at").agg(F.count(F.lit(1)).alias("k"), F.min("token").alias("lo"), F.max("token").alias("hi"))
    broken = places.join(totals, "concept_id").where("k <> n or lo <> hi").groupBy("concept_id").agg(F.min("at").alias("first"))
    cut = totals.join(broken, "concept_id", "left").select("concept_id", F.when(F.col("n") > 1, F.coalesce("first", "shortest")).otherwise(0).alias("cut"))
    return rows.join(cut, "concept_id").select("concept_id", "rel_path", F.slice("tokens", F.col("cut") + 1, F.greatest(F.size("tokens") - F.col("cut"), F.lit(0))).alias("tokens"))


def feature_vectors(points: DataFrame, scores: DataFrame, model: Model | None = None) -> DataFrame:
    """``concept_id, equip, equip_ord, feature``: (3 * mean over labels of the best point's score) squared.

    0 unless the concept has more than one point and fewer than MOST_POINTS.
    """
    cat = catalog(points.sparkSession, model).groupBy("equip", "equip_ord").agg(F.countDistinct("label").cast("long").alias("labels"))
    sizes = points.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
    best = points.join(scores, "tokens").groupBy("concept_id", "equip", "label").agg(F.max("score").alias("best"))
    total = best.groupBy("concept_id", "equip").agg(F.sum(F.round("best", 12)).alias("total"))
    rows = sizes.join(F.broadcast(cat), F.lit(True)).join(total, ["concept_id", "equip"], "left")
    inside = (F.col("n") > 1) & (F.col("n") < MOST_POINTS)
    return rows.select("concept_id", "equip", "equip_ord", F.when(inside, F.pow(3 * F.coalesce("total", F.lit(0.0)) / F.col("labels"), 2)).otherwise(0.0).alias("feature"))


def best_points(points: DataFrame, scores: DataFrame, model: Model | None = None) -> DataFrame:
    """``concept_id, equip, rel_path``: the best point for each equipment's last label, the first of equals."""
    cat = catalog(points.sparkSession, model).groupBy("equip").agg(F.max(F.struct("label_ord", "label")).alias("l")).select("equip", F.col("l.label").alias("label"))
    rows = points.join(scores.join(F.broadcast(cat), ["equip", "label"]), "tokens")
    first = F.row_number().over(Window.partitionBy("concept_id", "equip").orderBy(F.desc("score"), "rel_path"))
    return rows.withColumn("place", first).where("place = 1").select("concept_id", "equip", "rel_path")


def scaled(vectors: DataFrame, mean: list[float], std: list[float]) -> DataFrame:
    """``feature`` as (feature - mean) / std of its equipment."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("equip_ord") + 1)
    return vectors.withColumn("feature", (F.col("feature") - pick(mean)) / pick(std))
