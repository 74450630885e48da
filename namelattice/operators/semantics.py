"""Relations between concepts, their names and the points they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import blank_digits
from ..storage import stored
from .clusters import concept_id, first_instances


def is_derived(members: Column, base: Column) -> Column:
    """The base has more than two members, all of them among a strictly larger set."""
    return (F.size(base) > 2) & (F.size(members) > F.size(base)) & (F.size(F.array_except(base, members)) == 0)


def generalizes(members: Column, other: Column, ratio: float) -> Column:
    """More than two members, all among the other's, which has more, but not more than 1 / ratio as many."""
    return (F.size(members) > 2) & (F.size(members) < F.size(other)) & (F.size(F.array_except(members, other)) == 0) & (F.size(members) >= F.lit(ratio) * F.size(other))


def common_members(a: Column, b: Column, ratio: float) -> Column:
    """The common members in the order of the smaller set if they are ``ratio`` of both, else none."""
    both = F.when(F.size(a) < F.size(b), F.array_intersect(a, b)).otherwise(F.array_intersect(b, a))
    enough = (F.size(both) >= F.lit(ratio) * F.size(a)) & (F.size(both) >= F.lit(ratio) * F.size(b))
    return F.when(enough, both).otherwise(F.array().cast("array<string>"))


def meeting(concepts: DataFrame) -> DataFrame:
    """``a, b, members_a, members_b``: ordered pairs of different concepts that share a member; as many rows as there are such pairs."""
    rows = concepts.select("concept_id", F.explode("members").alias("m"))
    left, right = (rows.select(F.col("concept_id").alias(x), "m") for x in "ab")
    pairs = left.join(right, "m").where("a <> b").select("a", "b").distinct()
    names = concepts.select("concept_id", "members")
    return pairs.join(names.withColumnsRenamed({"concept_id": "a", "members": "members_a"}), "a").join(names.withColumnsRenamed({"concept_id": "b", "members": "members_b"}), "b")


def relatable(concepts: DataFrame, common: float) -> DataFrame:
    """``a, b, members_a, members_b``: ordered pairs of which one can hold the other, or that can share ``common`` of both.

    A set inside another has its rarest member in it; two sets that share enough
    share one of their rarest members.  So frequent members make no pairs.
    """
    rows = concepts.select("concept_id", F.size("members").alias("size"), F.explode("members").alias("m"))
    ranked = rows.join(rows.groupBy("m").agg(F.count(F.lit(1)).alias("df")), "m").withColumn("rank", F.row_number().over(Window.partitionBy("concept_id").orderBy("df", "m")))
    rarest = ranked.where("rank = 1").select(F.col("concept_id").alias("a"), "m")
    inside = rarest.join(rows.select(F.col("concept_id").alias("b"), "m"), "m").select("a", "b")
    prefix = ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * F.lit(common) - F.lit(1e-9)) + 1)
    near = prefix.select(F.col("concept_id").alias("a"), "m").join(prefix.select(F.col("concept_id").alias("b"), "m"), "m").select("a", "b")
    pairs = inside.unionByName(inside.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(near).where("a <> b").distinct()
    names = concepts.select("concept_id", "members")
    return pairs.join(names.withColumnsRenamed({"concept_id": "a", "members": "members_a"}), "a").join(names.withColumnsRenamed({"concept_id": "b", "members": "members_b"}), "b")


def set_relations(concepts: DataFrame, general: float = 0.5, common: float = 0.5) -> DataFrame:
    """``a, b, a_derives_from_b, a_generalizes_b, members``: ordered pairs of concepts that are related, with the members they share enough of.

    Only pairs that :func:`relatable` lets meet are looked at, where :func:`meeting` has all that share any member.
    """
    a, b = F.col("members_a"), F.col("members_b")
    pairs = relatable(concepts, common).select("a", "b", is_derived(a, b).alias("a_derives_from_b"), generalizes(a, b, general).alias("a_generalizes_b"), common_members(a, b, common).alias("members"))
    return pairs.where(F.col("a_derives_from_b") | F.col("a_generalizes_b") | (F.size("members") > 0))


def siblings(edges: DataFrame) -> DataFrame:
    """``a, b``: ordered pairs of concepts that derive from one base."""
    derived = edges.where("edge_type = 'derivation'").select("src", "dst").distinct()
    return derived.select("src", F.col("dst").alias("a")).join(derived.select("src", F.col("dst").alias("b")), "src").where("a <> b").select("a", "b").distinct()


def relatives(edges: DataFrame) -> DataFrame:
    """``a, b``: ordered pairs of concepts that derive from each other."""
    derived = edges.where("edge_type = 'derivation'").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return derived.join(derived.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")


def derivations(concepts: DataFrame, adjacent: DataFrame, general: float = 0.5, common: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """``edges`` (src, dst, edge_type) and ``bases`` (concept_id, members) by set relations of concepts not yet related.

    A concept that generalizes another, or that another derives from, is its
    source; two concepts with enough in common get a new base that both derive
    from.  ``adjacent`` (src, dst, edge_type) are edges there already: concepts
    that one connects, and those that derive from one base, are left out.
    """
    known = adjacent.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    known = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(siblings(adjacent)).distinct()
    pairs = relatable(concepts, common).join(known, ["a", "b"], "left_anti")
    a, b = F.col("members_a"), F.col("members_b")
    direct = pairs.where(generalizes(a, b, general) | is_derived(b, a)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    shared = pairs.where(~(generalizes(a, b, general) | is_derived(b, a) | generalizes(b, a, general) | is_derived(a, b)) & (F.col("a") < F.col("b")))
    shared = shared.withColumn("members", common_members(a, b, common)).where(F.size("members") > 0).withColumn("base", concept_id(F.col("members")))
    bases = shared.groupBy("base").agg(F.min("members").alias("members")).withColumnRenamed("base", "concept_id")
    both = shared.select(F.col("base").alias("src"), F.col("a").alias("dst")).unionByName(shared.select(F.col("base").alias("src"), F.col("b").alias("dst")))
    edges = direct.unionByName(both.where("src <> dst")).distinct().withColumn("edge_type", F.lit("derivation"))
    return edges, bases


def with_derivations(edges: DataFrame, derived: DataFrame, bases: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """``edges`` (src, dst, edge_type) with derivations ``derived(src, dst)`` put in, base first.

    An association that a concept shares with its base goes from the concept.
    With ``bases(concept_id, members)`` and ``names(concept_id, name)``, an
    association with a concept whose name is among the base's members moves
    from the concept to the base.
    """
    new = derived.select("src", "dst").distinct().withColumn("edge_type", F.lit("derivation"))
    links = edges.where("edge_type = 'association'").select("src", "dst")
    under = new.select(F.col("src").alias("base"), F.col("dst").alias("src"))
    of_base = edges.select("src", "dst").unionByName(new.select("src", "dst")).distinct().select(F.col("src").alias("base"), "dst")
    gone = links.join(under, "src").join(of_base, ["base", "dst"], "left_semi").select("src", "dst")
    moved = None
    if bases is not None and names is not None:
        members = bases.select(F.col("concept_id").alias("base"), "members")
        named = names.select(F.col("concept_id").alias("dst"), "name")
        moved = links.join(under, "src").join(members, "base").join(named, "dst").where("array_contains(members, name)")
        gone = gone.unionByName(moved.select("src", "dst"))
    gone = gone.distinct().withColumn("edge_type", F.lit("association"))
    out = edges.select("src", "dst", "edge_type").join(gone, ["src", "dst", "edge_type"], "left_anti").unionByName(new)
    if moved is not None:
        out = out.unionByName(moved.select(F.col("base").alias("src"), "dst", F.lit("association").alias("edge_type")))
    return out.distinct()


def base_with_member(concepts: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``concept_id, token, base_id`` for ``starts(concept_id, token)``: the last concept on the walk over first successors that all have the token.

    The first successor is the one with the least id; a walk ends where it would
    come back.  Starts without the token are left out.
    """
    own = concepts.select("concept_id", "members")
    first = edges.groupBy("src").agg(F.min("dst").alias("next")).join(own.withColumnsRenamed({"concept_id": "next", "members": "next_members"}), "next")
    state = starts.select("concept_id", "token").distinct().join(own, "concept_id").where("array_contains(members, token)")
    state = stored(state.select("concept_id", "token", F.col("concept_id").alias("at"), F.array("concept_id").alias("seen")), "walks")
    done = None
    while True:
        ahead = state.join(first, F.col("at") == F.col("src"), "left")
        goes = F.coalesce(F.expr("array_contains(next_members, token) and not array_contains(seen, next)"), F.lit(False))
        ahead = stored(ahead.select("concept_id", "token", "at", "seen", "next", goes.alias("goes")), "walks")
        ended = ahead.where("not goes").select("concept_id", "token", F.col("at").alias("base_id"))
        done = ended if done is None else done.unionByName(ended)
        state = ahead.where("goes").select("concept_id", "token", F.col("next").alias("at"), F.concat("seen", F.array("next")).alias("seen"))
        if state.isEmpty():
            return done


def simple_bases(tree: DataFrame, members: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(classes, edges, moves)`` of concepts of two nodes or more that all have just one child.

    Where nodes with a child that isn't a number have two different own tokens
    or more, none a number, the child of the last such node is the one member of
    a base, and each own token with its node's child makes a class derived from
    it.  ``classes`` (concept_id, members, ord), ``edges`` (src, dst, edge_type)
    and ``moves`` (node_id, concept_id), the derived class of each node.
    """
    ord_ = F.struct("first_point", "depth")
    rows = membership.join(tree.select("node_id", "token", ord_.alias("ord")), "node_id").join(members, "node_id").withColumn("child", F.element_at("members", 1))
    rows = rows.withColumns({"candidate": ~F.col("child").rlike("^[0-9]+$"), "named": ~F.col("token").rlike("^[0-9]+$")})
    whole = rows.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("size").alias("most"), F.countDistinct(F.when(F.col("candidate") & F.col("named"), F.col("token"))).alias("tokens"),
        F.max(F.when(F.col("candidate"), F.struct("ord", "child"))).alias("last"), F.min("ord").alias("first"),
    )
    whole = whole.where("n > 1 and most = 1 and tokens > 1").select("concept_id", F.array("last.child").alias("base_members"), "first")
    fits = rows.where("candidate and named").join(whole, "concept_id")
    firsts = fits.groupBy("concept_id", "token").agg(F.min(F.struct("ord", "child")).alias("f"), F.first("base_members").alias("base_members"))
    derived = firsts.select("concept_id", "token", concept_id(F.col("base_members")).alias("base"), F.array("token", "f.child").alias("members"), F.col("f.ord").alias("ord"))
    derived = stored(derived.withColumn("derived", concept_id(F.col("members"))), "derived")
    classes = whole.select(concept_id(F.col("base_members")).alias("concept_id"), F.col("base_members").alias("members"), F.col("first").alias("ord"))
    classes = classes.unionByName(derived.select(F.col("derived").alias("concept_id"), "members", "ord")).dropDuplicates(["concept_id"])
    edges = derived.select(F.col("base").alias("src"), F.col("derived").alias("dst")).distinct().withColumn("edge_type", F.lit("derivation"))
    return classes, edges, fits.join(derived.select("concept_id", "token", "derived"), ["concept_id", "token"]).select("node_id", F.col("derived").alias("concept_id"))


def concept_names(tree: DataFrame, members: DataFrame, concepts: DataFrame, membership: DataFrame) -> DataFrame:
    """``concept_id, name``: parent, first child and own token of the first node, numbers blank; without a node the id."""
    first = first_instances(tree, membership).join(tree.select("node_id", "token", "parent_id"), "node_id").join(members.select("node_id", F.element_at("members", 1).alias("child")), "node_id")
    above = tree.select(F.col("node_id").alias("parent_id"), F.col("token").alias("above"))
    parts = [blank_digits(F.coalesce(c, F.lit(""))) for c in ("above", "child", "token")]
    named = first.join(above, "parent_id", "left").select("concept_id", F.concat_ws("_", *parts).alias("name"))
    return concepts.select("concept_id").join(named, "concept_id", "left").select("concept_id", F.coalesce("name", "concept_id").alias("name"))


#: Ways to name a concept, by name.
NAMERS = {"basic": concept_names}


def association_edges(tree: DataFrame, closure: DataFrame, membership: DataFrame, members_after: DataFrame) -> DataFrame:
    """``src, dst, edge_type``: the concept of a node's nearest clustered ancestor uses the node's concept if the node's token is among its members."""
    above = closure.join(membership.select(F.col("node_id").alias("ancestor"), F.col("concept_id").alias("src")), "ancestor")
    nearest = above.join(membership.select("node_id", F.col("concept_id").alias("dst")), "node_id").groupBy("node_id", "dst").agg(F.min(F.struct("distance", "src")).alias("n"))
    used = nearest.select("node_id", "dst", F.col("n.src").alias("src")).join(tree.select("node_id", "token"), "node_id").join(members_after.withColumnRenamed("concept_id", "src"), "src")
    return used.where("array_contains(members, token)").select("src", "dst").distinct().withColumn("edge_type", F.lit("association"))


def concept_points(tree: DataFrame, closure: DataFrame, membership: DataFrame, members_after: DataFrame, least: int, most: int, unknown: str = "UNKNOWN") -> DataFrame:
    """``concept_id, rel_path, label, score, point_name``: paths below the first node of each concept of a fitting size to its leaves and inner points."""
    fitting = members_after.where(F.size("members").between(least, most)).select("concept_id")
    first = first_instances(tree, membership).join(fitting, "concept_id", "left_semi").withColumnRenamed("node_id", "ancestor")
    inner = closure.select(F.col("ancestor").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    ends = tree.join(inner, "node_id", "left").where("inner is null or is_point_first").select("node_id", "first_point")
    rows = closure.join(first, "ancestor").join(ends, "node_id")
    found = rows.groupBy("concept_id", "rel_path").agg(F.min("first_point").alias("point_name"))
    return found.select("concept_id", "rel_path", F.lit(unknown).alias("label"), F.lit(0.0).alias("score"), "point_name")


def explained_leaves(leaves: DataFrame, closure: DataFrame, membership: DataFrame) -> DataFrame:
    """``leaf_id, point_name, explained``: whether the leaf or a node above it is clustered."""
    nodes = membership.select("node_id").distinct()
    above = closure.join(nodes.withColumnRenamed("node_id", "ancestor"), "ancestor", "left_semi").select(F.col("node_id").alias("leaf_id"))
    marked = above.unionByName(nodes.select(F.col("node_id").alias("leaf_id"))).distinct().withColumn("hit", F.lit(True))
    return leaves.join(marked, "leaf_id", "left").select("leaf_id", "point_name", F.coalesce("hit", F.lit(False)).alias("explained"))


def unexplained_points(explained: DataFrame) -> DataFrame:
    return explained.where("not explained").select("point_name")


def unique_points(tree: DataFrame, closure: DataFrame, membership: DataFrame) -> DataFrame:
    """``concept_id, n_points``: leaves below the first node of each concept that no other clustered node hides."""
    clustered = membership.select("node_id").distinct()
    parents = closure.select(F.col("ancestor").alias("node_id")).distinct()
    first = first_instances(tree, membership)
    below = closure.join(first.withColumnRenamed("node_id", "ancestor"), "ancestor")
    ends = below.join(parents, "node_id", "left_anti").join(clustered, "node_id", "left_anti")
    # A clustered node strictly between hides the leaf: it lies above the leaf, closer than the first node.
    hiders = closure.join(clustered.withColumnRenamed("node_id", "ancestor"), "ancestor", "left_semi").groupBy("node_id").agg(F.min("distance").alias("nearest"))
    seen = ends.join(hiders, "node_id").where("nearest = distance")
    return first.select("concept_id").join(seen.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_points")), "concept_id", "left").select("concept_id", F.coalesce("n_points", F.lit(0)).alias("n_points"))


def base_classes(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts that derive from no other."""
    derived = edges.where("edge_type = 'derivation'").select(F.col("dst").alias("concept_id"))
    return concepts.join(derived, "concept_id", "left_anti").select("concept_id", "members")


def derived_closure(edges: DataFrame) -> DataFrame:
    """``src, dst``: concepts with all that derive from them, through any number of steps, each reached once."""
    step = edges.where("edge_type = 'derivation'").select("src", "dst").distinct()
    found, front = step, step
    while not front.isEmpty():
        ahead = front.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("then")), "dst").select("src", F.col("then").alias("dst")).distinct()
        front = stored(ahead.join(found, ["src", "dst"], "left_anti"), "front")
        found = found.unionByName(front)
    return found


def base_usage(concepts: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``concept_id, n_classes, n_instances``: derived classes of each base class and all their nodes."""
    bases = base_classes(concepts, edges).select("concept_id")
    reach = derived_closure(edges).join(bases.withColumnRenamed("concept_id", "src"), "src", "left_semi")
    family = reach.select(F.col("src").alias("base"), F.col("dst").alias("concept_id")).unionByName(bases.select(F.col("concept_id").alias("base"), "concept_id"))
    rows = family.join(membership, "concept_id", "left")
    return rows.groupBy("base").agg((F.countDistinct("concept_id") - 1).alias("n_classes"), F.countDistinct("node_id").alias("n_instances")).withColumnRenamed("base", "concept_id")


def base_report(concepts: DataFrame, edges: DataFrame, membership: DataFrame, names: DataFrame, labels: DataFrame, least: int = 4) -> DataFrame:
    """``base_id, concept_id, value``: a line for each class of ``least`` members or more that derives from a base."""
    bases = base_classes(concepts, edges).select(F.col("concept_id").alias("src"))
    reach = derived_closure(edges).join(bases, "src", "left_semi").select(F.col("src").alias("base_id"), F.col("dst").alias("concept_id"))
    large = concepts.where(F.size("members") >= least).select("concept_id")
    counts = membership.groupBy("concept_id").agg(F.countDistinct("node_id").alias("n"))
    rows = reach.join(large, "concept_id").join(names, "concept_id").join(labels, "concept_id", "left").join(counts, "concept_id", "left")
    said = F.format_string("derived class %s label %s id %s instances %d", "name", F.coalesce("class_label", F.lit("UNKNOWN")), "concept_id", F.coalesce("n", F.lit(0)))
    return rows.select("base_id", "concept_id", said.alias("value"))


def class_instances(membership: DataFrame) -> DataFrame:
    return membership.groupBy("concept_id").agg(F.countDistinct("node_id").alias("n_instances"))


def class_summary(labels: DataFrame, membership: DataFrame) -> DataFrame:
    """``class_label, n_concepts, n_instances`` from ``labels(concept_id, class_label)``."""
    rows = labels.join(membership, "concept_id", "left")
    return rows.groupBy("class_label").agg(F.countDistinct("concept_id").alias("n_concepts"), F.countDistinct("node_id").alias("n_instances"))
