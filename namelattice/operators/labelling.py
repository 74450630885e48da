"""Classes of concepts, labels of their points, and the candidates of every name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import COLLECTION, COMPOSITE, CONTAINER, SKIPPED_CLASS, UNINTELLIGIBLE, UNKNOWN, Config
from ..storage import stored
from .catalog import catalog, point_model
from .components import strongly_connected
from .scoring import label_scores


def device_classes(sizes: DataFrame, vectors: DataFrame, floor: float) -> DataFrame:
    """``concept_id, class_label`` from sizes (concept_id, n) and feature vectors.

    More than 150 points are unintelligible, fewer than two unknown; else the
    equipment with the largest feature, the first of equals, if it reaches
    ``floor``.
    """
    top = vectors.groupBy("concept_id").agg(F.max(F.struct(F.round("feature", 9).alias("feature"), -F.col("equip_ord"), "equip")).alias("t"))
    rows = sizes.join(top, "concept_id", "left")
    label = F.when(F.col("n") > 150, UNINTELLIGIBLE).when(F.col("n") < 2, UNKNOWN).when(F.col("t.feature") >= floor, F.col("t.equip")).otherwise(UNKNOWN)
    return rows.select("concept_id", label.alias("class_label"))


def _revised(own: Column, seen: Column) -> Column:
    """The class of a concept with class ``own`` by the set of classes that it uses, and whether it takes theirs."""
    equipment = F.array(*map(F.lit, ("VAV", "AHU", "VRF")))
    one, unknown = F.size(seen) == 1, F.array_contains(seen, UNKNOWN)
    beside = (F.size(seen) == 2) & unknown & (F.array_contains(seen, "AHU") | F.array_contains(seen, "VRF"))
    label = F.when(one & ~unknown, CONTAINER).when(beside, own).when((F.size(seen) > 1) & F.arrays_overlap(seen, equipment), COMPOSITE).otherwise(own)
    return F.struct(label.alias("label"), (beside & (own == "AHU")).alias("takes"))


def concept_classes(concepts: DataFrame, edges: DataFrame, own: DataFrame) -> DataFrame:
    """``concept_id, class_label``: own classes, revised by the classes of the concepts that each uses.

    One kind of known successors makes a container, several with equipment a
    composite; an air handler among unknowns keeps its own class and takes its
    successors'.  Successors come first: cycles are condensed, and levels of the rest
    solved one after the other, each by joins.  Order decides nothing: links
    within a cycle, and of a concept with itself, see the class all begin with,
    UNKNOWN; classes are taken last, when all are revised.
    """
    known = concepts.select("concept_id").join(own, "concept_id", "left").select("concept_id", F.coalesce("class_label", F.lit(UNKNOWN)).alias("own"))
    known = stored(known, "known")
    links = edges.where("edge_type = 'association'").select("src", "dst").distinct()
    for end in ("src", "dst"):
        links = links.join(known.select(F.col("concept_id").alias(end)), end, "left_semi")
    links = stored(links, "links")
    cycle = strongly_connected(links.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    ends = [cycle.select(F.col("node").alias(end), F.col("component").alias(f"{end}_cycle")) for end in ("src", "dst")]
    within = (F.col("src") == F.col("dst")) | F.coalesce(F.col("src_cycle") == F.col("dst_cycle"), F.lit(False))
    links = stored(links.join(ends[0], "src", "left").join(ends[1], "dst", "left").select("src", "dst", within.alias("within")), "links")
    revised = stored(known.join(links.select(F.col("src").alias("concept_id")), "concept_id", "left_anti").select("concept_id", F.col("own").alias("label"), F.lit(False).alias("takes")), "revised")
    waiting = links
    while not waiting.isEmpty():
        met = waiting.join(revised.select(F.col("concept_id").alias("dst"), "label"), "dst", "left")
        label = F.when(F.col("within"), UNKNOWN).otherwise(F.col("label"))
        # At most a label for each class, so the set is small.
        seen = met.groupBy(F.col("src").alias("concept_id")).agg(F.collect_set(label).alias("seen"), F.bool_or(label.isNull()).alias("waits")).where("NOT waits")
        level = seen.join(known, "concept_id").select("concept_id", _revised(F.col("own"), F.col("seen")).alias("r")).select("concept_id", "r.label", "r.takes")
        level = stored(level, "level")
        revised = revised.unionByName(level)
        waiting = stored(waiting.join(level.select(F.col("concept_id").alias("src")), "src", "left_anti"), "waiting")
    taken = links.where("src <> dst").join(revised.where("takes").select(F.col("concept_id").alias("src")), "src").select(F.col("dst").alias("concept_id"), F.lit(True).alias("taken")).distinct()
    return revised.join(taken, "concept_id", "left").select("concept_id", F.when(F.col("taken"), UNKNOWN).otherwise(F.col("label")).alias("class_label"))


def assigned_labels(points: DataFrame, classes: DataFrame, config: Config = Config()) -> DataFrame:
    """``concept_id, rel_path, label, score`` of points (concept_id, rel_path, tokens) whose concept has equipment for a class.

    Labels are given once, the highest score of a concept first; of equals the
    first label in the order of the catalogue, then the first point in the order
    of paths.  In each round the pairs that are first for both their label and
    their point are taken at once, which gives what taking the first of all
    pairs again and again gives.  Rounds are at most the labels of an equipment.
    If points run out, the rest of the labels is left ("stop") or goes to the
    first point with score -1, the last one staying ("overwrite").
    """
    model = point_model(config.catalog_merge)
    own = classes.where(F.col("class_label").isin(*model)).select("concept_id", F.col("class_label").alias("equip"))
    rows = stored(points.join(own, "concept_id").select("concept_id", "equip", "rel_path", "tokens"), "points")
    order = catalog(rows.sparkSession, model).select("equip", "label", "label_ord").distinct()
    pairs = rows.join(label_scores(rows, model), ["equip", "tokens"]).join(F.broadcast(order), ["equip", "label"])
    first = F.struct((-F.round("score", 12)).alias("less"), "label_ord", "rel_path")
    pairs = stored(pairs.select("concept_id", "rel_path", "label", "label_ord", "score", first.alias("place")), "pairs")
    given, left = None, pairs
    while not left.isEmpty():
        of_label, of_point = Window.partitionBy("concept_id", "label"), Window.partitionBy("concept_id", "rel_path")
        best = (F.col("place") == F.min("place").over(of_label)) & (F.col("place") == F.min("place").over(of_point))
        taken = stored(left.withColumn("best", best).where("best").drop("best"), "taken")
        given = taken if given is None else given.unionByName(taken)
        left = left.join(taken.select("concept_id", "label"), ["concept_id", "label"], "left_anti").join(taken.select("concept_id", "rel_path"), ["concept_id", "rel_path"], "left_anti")
        left = stored(left, "left")
    given = pairs if given is None else given
    found = given.select("concept_id", "rel_path", "label", "score")
    if config.overflow == "stop":
        return found
    over = pairs.select("concept_id", "label", "label_ord").distinct().join(given.select("concept_id", "label"), ["concept_id", "label"], "left_anti").groupBy("concept_id").agg(F.max(F.struct("label_ord", "label")).alias("l"))
    over = over.join(rows.groupBy("concept_id").agg(F.min("rel_path").alias("rel_path")), "concept_id").select("concept_id", "rel_path", F.col("l.label").alias("label"), F.lit(-1.0).alias("score"))
    return found.join(over, ["concept_id", "rel_path"], "left_anti").unionByName(over)


def relabelled(concept_points: DataFrame, labels: DataFrame) -> DataFrame:
    """``concept_points`` with assigned labels put in; other labels and points stay."""
    new = labels.select("concept_id", "rel_path", F.col("label").alias("new_label"), F.col("score").alias("new_score"))
    rows = concept_points.join(new, ["concept_id", "rel_path"], "left")
    return rows.select("concept_id", "rel_path", F.coalesce("new_label", "label").alias("label"), F.coalesce("new_score", "score").alias("score"), "point_name")


def candidates(leaves: DataFrame, closure: DataFrame, membership: DataFrame, classes: DataFrame, concept_points: DataFrame, limit: float = 0.0, drop_unknown: bool = False) -> DataFrame:
    """``point_name, cands``: for each leaf its clustered ancestors from the nearest on, one a class, as structs (ord, class, node, label, score).

    A path that its concept doesn't know is UNKNOWN with score 0.  A candidate
    whose class is COLLECTION has neither label nor score.
    """
    rows = leaves.select("leaf_id", "point_name").join(closure.withColumnRenamed("node_id", "leaf_id"), "leaf_id")
    rows = rows.join(membership.withColumnRenamed("node_id", "ancestor"), "ancestor").join(classes, "concept_id")
    known = concept_points.select("concept_id", "rel_path", "label", "score")
    rows = rows.join(known, ["concept_id", "rel_path"], "left").withColumns({"label": F.coalesce("label", F.lit(UNKNOWN)), "score": F.coalesce("score", F.lit(0.0))})
    rows = rows.where((F.col("score") >= limit) & (F.col("class_label") != SKIPPED_CLASS))
    rows = rows.where(F.col("label") != UNKNOWN) if drop_unknown else rows
    named = F.col("class_label") != COLLECTION
    rows = rows.withColumns({"label": F.when(named, F.col("label")), "score": F.when(named, F.col("score"))})
    nearest = rows.groupBy("point_name", "class_label").agg(F.min(F.struct("distance", F.col("ancestor").alias("node"), "label", "score")).alias("n"))
    one = F.struct(F.col("n.distance").alias("ord"), F.col("class_label").alias("class"), F.col("n.node").alias("node"), F.col("n.label").alias("label"), F.col("n.score").alias("score"))
    return nearest.groupBy("point_name").agg(F.array_sort(F.collect_list(one)).alias("cands"))


def resolved(found: DataFrame) -> DataFrame:
    """``original_point, equipment, node, distance, representation``: the candidate with the highest score, the nearest of equals; one without a score only if there is no other."""
    best = F.array_max(F.transform("cands", lambda c: F.struct(c["score"].alias("score"), (-c["ord"]).alias("near"), c["class"].alias("class"), c["node"].alias("node"), c["label"].alias("label"))))
    rows = found.where(F.size("cands") > 0).select("point_name", best.alias("b"))
    return rows.select(
        F.col("point_name").alias("original_point"), F.col("b.class").alias("equipment"), F.col("b.node").alias("node"),
        F.col("b.score").alias("distance"), F.col("b.label").alias("representation"),
    )


def ranked_labels(scores: DataFrame, top: int = 3) -> DataFrame:
    """``tokens, place, label, score``: the best labels of each token list, in the catalogue's order of equals."""
    order = catalog(scores.sparkSession).select("label", (F.col("equip_ord") * 100 + F.col("label_ord")).alias("o")).distinct()
    rows = scores.join(F.broadcast(order), "label").withColumn("place", F.row_number().over(Window.partitionBy("tokens").orderBy(F.desc("score"), "o")))
    return rows.where(F.col("place") <= top).select("tokens", "place", "label", "score")
