"""The prefix forest of expanded names, as tables keyed by node.

A node stands for a prefix of paths.  Where the same node is reached by several
names, the first name in order creates it and decides its token and parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import stored

#: Between tokens of a node's id where ids keep paths apart.
SEPARATOR = "␟"


def _node_id(path: Column, size: Column, mode: str) -> Column:
    return F.array_join(F.slice(path, F.lit(1), size), "" if mode == "concat" else SEPARATOR)


def occurrences(paths: DataFrame, mode: str = "concat") -> DataFrame:
    """``point_name, depth, node_id, token, parent_id, ends``: a row for each node on each name's walk."""
    rows = paths.where(F.size("path") > 0).select("point_name", "path", F.posexplode("path").alias("at", "token"))
    return rows.select(
        "point_name", (F.col("at") + 1).alias("depth"), _node_id(F.col("path"), F.col("at") + 1, mode).alias("node_id"), "token",
        F.when(F.col("at") > 0, _node_id(F.col("path"), F.col("at"), mode)).alias("parent_id"), (F.col("at") + 1 == F.size("path")).alias("ends"),
    )


def nodes(paths: DataFrame, mode: str = "concat") -> DataFrame:
    """``node_id, token, parent_id, depth, first_point, is_point, is_point_first``."""
    first = F.min(F.struct("point_name", "depth", "token", "parent_id", "ends")).alias("f")
    rows = occurrences(paths, mode).groupBy("node_id").agg(first, F.max("ends").alias("is_point"))
    return rows.select(
        "node_id", F.col("f.token").alias("token"), F.col("f.parent_id").alias("parent_id"), F.col("f.depth").alias("depth"),
        F.col("f.point_name").alias("first_point"), "is_point", F.col("f.ends").alias("is_point_first"),
    )


def node_types(paths: DataFrame, mode: str = "concat") -> DataFrame:
    """``token, node_id``: every token a node was reached by."""
    return occurrences(paths, mode).select("token", "node_id").distinct()


def leaves(paths: DataFrame, mode: str = "concat") -> DataFrame:
    """``leaf_id, point_name, n_points``: ends of walks and the first name that ends there."""
    size = F.size("path")
    ends = paths.where(size > 0).select(_node_id(F.col("path"), size, mode).alias("leaf_id"), "point_name")
    return ends.groupBy("leaf_id").agg(F.min("point_name").alias("point_name"), F.count(F.lit(1)).alias("n_points"))


def point_leaf(paths: DataFrame, mode: str = "concat") -> DataFrame:
    """``point_name, leaf_id``: no name is lost where several share a leaf."""
    size = F.size("path")
    return paths.where(size > 0).select("point_name", _node_id(F.col("path"), size, mode).alias("leaf_id"))


def leaf_parents(tree: DataFrame) -> DataFrame:
    return tree.where("is_point and parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()


def members(tree: DataFrame) -> DataFrame:
    """``node_id, members, size``: tokens of a node's children in the order of their creation."""
    rows = tree.where("parent_id is not null").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("first_point", "depth", "token"))).alias("c"))
    return rows.select(F.col("parent_id").alias("node_id"), F.col("c.token").alias("members"), F.size("c").alias("size"))


def same_type_parents(tree: DataFrame) -> DataFrame:
    """``token, parent_id``: parents of all nodes that have a token, which is what a look-up by type returns."""
    return tree.where("parent_id is not null").select("token", "parent_id").distinct()


def common_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """``n``: number of equal child tokens of two nodes given by their rows of :func:`members`."""
    left, right = a.select(F.explode("members").alias("t")), b.select(F.explode("members").alias("t"))
    return left.join(right, "t").agg(F.count(F.lit(1)).alias("n"))


def report(tree: DataFrame) -> DataFrame:
    """``metric, value``."""
    row = tree.agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("is_point").cast("long")).alias("leaves"), F.countDistinct("token").alias("types"))
    return row.selectExpr("stack(3, 'nodes', nodes, 'leaves', coalesce(leaves, 0), 'types', types) as (metric, value)")


def _edges(tree: DataFrame, cut: DataFrame | None) -> DataFrame:
    edges = tree.where("parent_id is not null").select("node_id", "parent_id", "token")
    return edges if cut is None else edges.join(cut, ["parent_id", "node_id"], "left_anti")


def inner(tree: DataFrame) -> DataFrame:
    """The nodes of ``tree`` that have children."""
    return tree.join(tree.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_semi")


def inner_chains(tree: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """:func:`chains` of nodes with children only.

    Chains double each round, so rounds grow with the logarithm of the forest's depth; those that
    a round finds at their end are written no more.
    """
    edges = _edges(inner(tree), cut)
    found = stored(edges.select("node_id", F.array(F.struct(F.col("parent_id").alias("ancestor"), "token")).alias("chain")), "chains")
    done, size = None, 1
    while True:
        # Shorter chains than the rounds allow end at a root or a cut.
        going = found.where(F.size("chain") == size).withColumn("top", F.element_at("chain", -1)["ancestor"])
        ended = found.where(F.size("chain") < size)
        done = ended if done is None else done.unionByName(ended)
        if going.isEmpty():
            return done
        every = done.unionByName(found.where(F.size("chain") == size))
        above = every.select(F.col("node_id").alias("top"), F.col("chain").alias("more"))
        longer = going.join(above, "top", "left").select("node_id", F.when(F.col("more").isNull(), F.col("chain")).otherwise(F.concat("chain", "more")).alias("chain"))
        found, size = stored(longer, "chains"), 2 * size


def chains(tree: DataFrame, cut: DataFrame | None = None, above: DataFrame | None = None) -> DataFrame:
    """``node_id, chain``: for each node with a parent the way up, as structs (ancestor, token), the token being that of the node below the ancestor.

    ``cut`` (``parent_id, node_id``) are edges that no walk passes.  A row is a
    node; only the ways of inner nodes (``above``, made here if not given) take
    rounds, those of all others are their parents' and a step.
    """
    above = inner_chains(tree, cut) if above is None else above
    ends = _edges(tree.join(tree.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti"), cut)
    met = ends.join(above.select(F.col("node_id").alias("parent_id"), F.col("chain").alias("more")), "parent_id", "left")
    step = F.array(F.struct(F.col("parent_id").alias("ancestor"), "token"))
    leaves = met.select("node_id", F.when(F.col("more").isNull(), step).otherwise(F.concat(step, "more")).alias("chain"))
    return stored(above.unionByName(leaves), "chains")


def _walks(ways: DataFrame) -> DataFrame:
    rows = ways.select("node_id", "chain", F.posexplode("chain").alias("at", "step"))
    path = F.reverse(F.transform(F.slice("chain", F.lit(1), F.col("at") + 1), lambda step: step["token"]))
    return rows.select("node_id", F.col("step.ancestor").alias("ancestor"), (F.col("at") + 1).alias("distance"), path.alias("rel_path"))


def inner_closure(above: DataFrame) -> DataFrame:
    """:func:`closure` of nodes with children only, of their chains ``above``."""
    return _walks(above)


def closure(tree: DataFrame, cut: DataFrame | None = None, above: DataFrame | None = None) -> DataFrame:
    """``node_id, ancestor, distance, rel_path``: every node with every node above it that no edge of ``cut`` parts it from.

    ``rel_path`` are the tokens from below the ancestor to the node.  Only
    :func:`chains` are written; the rows are made of them where they are read, and paths
    only where they are asked for.
    """
    return _walks(chains(tree, cut, above))
