"""Clusters of alike nodes, called concepts, and their refinement and clean-up.

All steps work on distinct sets of children, not on nodes: nodes with equal
sets always fall together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import stored
from .components import connected_components
from .similarity import member_sets, node_sets, similar_sets


@dataclass(frozen=True)
class Concepts:
    """``concepts``: concept_id, members, ord. ``membership``: concept_id, node_id."""

    concepts: DataFrame
    membership: DataFrame


def concept_id(members: Column) -> Column:
    return F.sha2(F.concat_ws("␟", F.array_sort(members)), 256)


#: Pairs of undecided sets that the driver settles itself, so that a long chain costs no round a link.
FEW_ARROWS = 100_000


def _rest(waiting: DataFrame, arrows: DataFrame) -> DataFrame:
    """The seeds among the last undecided sets, one after the other: at most FEW_ARROWS pairs, and only the sets in them."""
    before: dict[str, list[str]] = {}
    order: dict[str, tuple] = {}
    for row in arrows.collect():
        before.setdefault(row.then, []).append(row["first"])
        order |= {row["first"]: row.first_ord, row.then: row.then_ord}
    chosen: set[str] = set()
    for name in sorted(order, key=order.get):
        if not chosen.intersection(before.get(name, ())):
            chosen.add(name)
    linked = arrows.select(F.col("first").alias("set_id")).unionByName(arrows.select(F.col("then").alias("set_id")))
    found = waiting.sparkSession.createDataFrame([(name,) for name in sorted(chosen)], "set_id string")
    return waiting.select("set_id").join(linked, "set_id", "left_anti").unionByName(found)


def seeds(sets: DataFrame, pairs: DataFrame, few: int = FEW_ARROWS) -> DataFrame:
    """``set_id``: the first sets in order none of which is alike another (greedy in order, in rounds).

    A set is decided once all alike sets before it are: it is covered if one
    of them is a seed and a seed otherwise.  ``pairs`` are ``a, b`` of alike sets.
    """
    order = sets.select("set_id", "ord")
    both = pairs.join(order.withColumnsRenamed({"set_id": "a", "ord": "oa"}), "a").join(order.withColumnsRenamed({"set_id": "b", "ord": "ob"}), "b")
    before = F.col("oa") < F.col("ob")
    a, b = (F.struct(F.col(x).alias("id"), F.col(f"o{x}").alias("ord")) for x in "ab")
    arrows = both.select(F.when(before, a).otherwise(b).alias("f"), F.when(before, b).otherwise(a).alias("t"))
    arrows = arrows.select(F.col("f.id").alias("first"), F.col("f.ord").alias("first_ord"), F.col("t.id").alias("then"), F.col("t.ord").alias("then_ord"))
    arrows = stored(arrows, "arrows")
    chosen, waiting = None, sets.select("set_id")
    while True:
        if arrows.limit(few + 1).count() <= few:
            last = _rest(waiting, arrows)
            return last if chosen is None else chosen.unionByName(last)
        ready = stored(waiting.join(arrows.select(F.col("then").alias("set_id")), "set_id", "left_anti"), "seeds")
        chosen = ready if chosen is None else chosen.unionByName(ready)
        covered = arrows.join(ready.select(F.col("set_id").alias("first")), "first").select(F.col("then").alias("set_id")).distinct()
        waiting = stored(waiting.join(ready, "set_id", "left_anti").join(covered, "set_id", "left_anti"), "waiting")
        # Covered sets stop no other.
        still = waiting.select("set_id")
        arrows = stored(arrows.join(still.withColumnRenamed("set_id", "first"), "first", "left_semi").join(still.withColumnRenamed("set_id", "then"), "then", "left_semi"), "arrows")


def find_concepts(tree: DataFrame, members: DataFrame, ratio: float = 0.9) -> Concepts:
    """Each seed with all sets alike it; clusters that share a set are one.

    The concept keeps the set with the fewest members, the first in order of equals.
    """
    sets = stored(member_sets(tree, members), "sets")
    pairs = stored(similar_sets(sets, ratio).select("a", "b"), "pairs")
    linked = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    active = stored(sets.join(linked.withColumn("linked", F.lit(True)), "set_id", "left").where("linked or n_nodes > 1").drop("linked"), "active")
    seed = stored(seeds(active, pairs), "seed")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    stars = both.join(seed.withColumnRenamed("set_id", "a"), "a")
    found = connected_components(stars)
    comp = active.join(found, F.col("set_id") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "set_id"))
    comp = stored(comp.select("set_id", "members", "size", "ord", "comp"), "comp")
    kept = comp.groupBy("comp").agg(F.min(F.struct("size", "ord", "members")).alias("k"), F.min("ord").alias("ord"))
    concepts = stored(kept.select("comp", concept_id(F.col("k.members")).alias("concept_id"), F.col("k.members").alias("members"), "ord"), "concepts")
    of = node_sets(members).join(comp.select("set_id", "comp"), "set_id").join(concepts.select("comp", "concept_id"), "comp")
    return Concepts(concepts.drop("comp"), stored(of.select("concept_id", "node_id"), "membership"))


def refine(tree: DataFrame, members: DataFrame, found: Concepts, ratio: float = 0.9) -> Concepts:
    """Within each concept, nodes move to a concept of their leader's set unless that concept exists already.

    The first set in order that no leader took leads all sets alike it that no
    leader took: leaders are the seeds among sets of one concept, and a set
    follows the first seed alike it.  Leaders that take no other node form
    nothing; concepts left without nodes stay.
    """
    sets = stored(member_sets(tree, members), "sets")
    of = stored(node_sets(members).join(found.membership, "node_id"), "of")
    held = of.groupBy("concept_id", "set_id").agg(F.count(F.lit(1)).alias("n"))
    # A set belongs to one concept, so pairs of sets tell pairs within concepts.
    where = held.select("set_id", "concept_id")
    pairs = similar_sets(sets.join(where, "set_id", "left_semi"), ratio).select("a", "b")
    pairs = pairs.join(where.withColumnsRenamed({"set_id": "a", "concept_id": "ca"}), "a").join(where.withColumnsRenamed({"set_id": "b", "concept_id": "cb"}), "b").where("ca = cb").select("a", "b")
    pairs = stored(pairs, "pairs")
    ordered = stored(sets.join(where, "set_id").select("set_id", "ord"), "ordered")
    lead = stored(seeds(ordered, pairs), "leaders")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    follows = both.join(lead.withColumnRenamed("set_id", "a"), "a").join(ordered.withColumnRenamed("set_id", "a"), "a").groupBy(F.col("b").alias("set_id")).agg(F.min_by("a", "ord").alias("leader"))
    follows = follows.join(lead, "set_id", "left_anti").unionByName(lead.select("set_id", F.col("set_id").alias("leader")))
    led = stored(held.join(follows, "set_id"), "led")
    groups = led.groupBy("concept_id", "leader").agg(F.sum("n").alias("nodes")).where("nodes > 1").select("concept_id", "leader")
    new = groups.join(found.concepts.select(F.col("concept_id").alias("leader")), "leader", "left_anti")
    moves = stored(led.join(new, ["concept_id", "leader"]).select("concept_id", "set_id", F.col("leader").alias("moved")), "moves")
    membership = of.join(moves, ["concept_id", "set_id"], "left").select(F.coalesce("moved", "concept_id").alias("concept_id"), "node_id")
    added = moves.select(F.col("moved").alias("set_id")).distinct().join(sets, "set_id").select(F.col("set_id").alias("concept_id"), "members", "ord")
    return Concepts(stored(found.concepts.unionByName(added), "concepts"), stored(membership, "membership"))


def child_cuts(rows: DataFrame, ratio: float = 0.8) -> DataFrame:
    """``concept_id, token, child_concept``: tokens that concepts lose to concepts of their nodes' children.

    ``rows`` (concept_id, token, child_concept, first_point, depth, members,
    child_members), one for each token and child concept of a concept, are
    decided in order of first point, depth, token and child concept: a token is
    cut if the child has two members or more, more than four members of the
    concept are left, and the child has ``ratio`` of them, one not counted.  All
    decisions up to the first that takes a member away are made at once, for all
    concepts; what is behind it waits for the next round.  So rounds follow the
    most members that one concept loses, and no concept is gathered anywhere.
    """
    first = rows.select(
        "concept_id", "token", "child_concept", F.struct("first_point", "depth", "token", "child_concept").alias("ord"),
        F.array_intersect("members", "child_members").alias("common"), F.size("members").alias("left"), F.array_contains("members", F.col("token")).alias("held"),
    )
    # Five members are left at least where a token is cut, so fewer in common never suffice.
    first = first.where((F.size(F.array_distinct(rows["child_members"])) > 1) & (F.col("left") > 4) & (F.size("common") >= F.lit(4 * ratio)))
    waiting = stored(first, "waiting")
    cuts = waiting.select("concept_id", "token", "child_concept").limit(0)
    while not waiting.isEmpty():
        passing = stored(waiting.where((F.col("left") > 4) & (F.size("common") >= (F.col("left") - 1) * F.lit(ratio))).select("concept_id", "token", "child_concept", "ord", "held"), "passing")
        taking = passing.where("held").groupBy("concept_id").agg(F.min("ord").alias("stop"), F.min_by("token", "ord").alias("gone"))
        taking = stored(taking, "taking")
        now = passing.join(taking, "concept_id", "left").where("stop is null or ord <= stop")
        cuts = cuts.unionByName(stored(now.select("concept_id", "token", "child_concept"), "cuts"))
        behind = waiting.join(taking, "concept_id").where("ord > stop").withColumns({
            "common": F.array_remove("common", F.col("gone")), "left": F.col("left") - 1, "held": F.col("held") & (F.col("token") != F.col("gone")),
        })
        waiting = stored(behind.drop("stop", "gone"), "waiting")
    return cuts


def clean_up(tree: DataFrame, found: Concepts, ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``cut_edges`` (parent_id, node_id) and ``members_after`` (concept_id, members).

    A child that belongs to another concept much like its parent's is cut off,
    and its token leaves the parent's concept, which counts for later tests of
    that concept.  One decision holds for all nodes of a concept with a child
    of the same token and concept; other concepts count as they were created.
    """
    child = tree.where("parent_id is not null").join(found.membership.withColumnRenamed("concept_id", "child_concept"), "node_id")
    of = found.membership.withColumnRenamed("node_id", "parent_id")
    edges = stored(child.join(of, "parent_id").where("child_concept <> concept_id").select("parent_id", "node_id", "token", "first_point", "depth", "concept_id", "child_concept"), "child_edges")
    firsts = edges.groupBy("concept_id", "token", "child_concept").agg(F.min(F.struct("first_point", "depth")).alias("f"))
    both = firsts.join(found.concepts.select("concept_id", "members"), "concept_id").join(
        found.concepts.select(F.col("concept_id").alias("child_concept"), F.col("members").alias("child_members")), "child_concept"
    )
    rows = both.select("concept_id", "token", "child_concept", F.col("f.first_point").alias("first_point"), F.col("f.depth").alias("depth"), "members", "child_members")
    cuts = child_cuts(rows, ratio)
    gone = cuts.groupBy("concept_id").agg(F.collect_set("token").alias("gone"))
    after = found.concepts.join(gone, "concept_id", "left").select("concept_id", F.when(F.col("gone").isNull(), F.col("members")).otherwise(F.array_except("members", "gone")).alias("members"))
    return stored(edges.join(cuts, ["concept_id", "token", "child_concept"]).select("parent_id", "node_id"), "cut_edges"), stored(after, "members_after")


def first_instances(tree: DataFrame, membership: DataFrame) -> DataFrame:
    """``concept_id, node_id``: the first node in order of each concept."""
    rows = membership.join(tree.select("node_id", "first_point", "depth"), "node_id")
    return rows.groupBy("concept_id").agg(F.min(F.struct("first_point", "depth", "node_id")).alias("f")).select("concept_id", F.col("f.node_id").alias("node_id"))


def with_base_classes(found: Concepts, classes: DataFrame, moves: DataFrame) -> Concepts:
    """``found`` with further ``classes(concept_id, members, ord)`` and the nodes of ``moves(node_id, concept_id)`` under them.

    A concept that thereby loses all its nodes goes; concepts that had none stay.
    """
    moved = found.membership.join(moves.withColumnRenamed("concept_id", "moved"), "node_id", "left")
    kept = stored(moved.select(F.coalesce("moved", "concept_id").alias("concept_id"), "node_id").unionByName(moves.select("concept_id", "node_id")).distinct(), "membership")
    had, has = (m.select("concept_id").distinct() for m in (found.membership, kept))
    left = found.concepts.join(had.join(has, "concept_id", "left_anti"), "concept_id", "left_anti")
    added = classes.select("concept_id", "members", "ord").dropDuplicates(["concept_id"]).join(left, "concept_id", "left_anti")
    return Concepts(stored(left.unionByName(added), "concepts"), kept)
