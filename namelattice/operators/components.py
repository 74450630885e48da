"""Connected components by alternating star contraction.

Each round is two grouped minima and two equi-joins over the edges; a hot node
is pre-aggregated on the map side and its edges split by the join, so no group
is ever gathered.  Rounds grow with the logarithm of the longest path.
Edge tables of a round are written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge points from the larger to the smaller node here.
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Self-loops and repeated edges are harmless; rows with a null end are left
    out; without edges the result is empty.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "edges")
    state = _state(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        links = stored(_small_star(_large_star(links)), "edges")
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)


def _trimmed(edges: DataFrame) -> DataFrame:
    return edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")


def _core(edges: DataFrame) -> DataFrame:
    """Edges that are left when nodes without an edge in or without an edge out are taken away again and again: all on cycles or between them."""
    n = edges.count()
    while n:
        edges, before = stored(_trimmed(_trimmed(edges)), "core"), n
        n = edges.count()
        if n == before:
            break
    return edges


def _reached_by(edges: DataFrame) -> DataFrame:
    """``(node, colour)``: for each node of ``edges(a, b)`` the least node that reaches it, itself included."""
    at = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("colour", F.col("node")), "colours")
    while True:
        ahead = edges.join(at.select(F.col("node").alias("a"), "colour"), "a").groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("least"))
        less = at.join(ahead, "node", "left").select("node", F.least("colour", "least").alias("colour"), (F.col("least") < F.col("colour")).alias("moved"))
        less = stored(less, "colours")
        at, moved = less.select("node", "colour"), less.where("moved")
        if moved.isEmpty():
            return at


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of ``edges(a, b)`` that lie on a cycle with another node; the component is its least node.

    Nodes off all cycles are trimmed away; of the rest each takes the least node
    that reaches it, and those that reach that node back are its component; again
    without them until nothing is left.  All steps are grouped minima and
    equi-joins; their number follows the longest path, not the nodes.  Rows with a
    null end and self-loops are left out.
    """
    core = _core(stored(edges.where("a <> b").select("a", "b").distinct(), "links"))
    found = core.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    while not core.isEmpty():
        colour = _reached_by(core)
        alike = core.join(colour.select(F.col("node").alias("a"), F.col("colour").alias("c")), "a").join(colour.select(F.col("node").alias("b"), F.col("colour").alias("d")), "b").where("c = d")
        alike = stored(alike.select("a", "b", "c"), "alike")
        front = back = stored(colour.where("node = colour").select("node"), "back")
        while not front.isEmpty():
            front = stored(alike.join(front.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")).distinct().join(back, "node", "left_anti"), "front")
            back = stored(back.unionByName(front), "back")
        # A node that only reaches itself back is no component.
        own = back.join(colour, "node").select("node", F.col("colour").alias("component"))
        real = own.groupBy("component").count().where("count > 1").select("component")
        found = stored(found.unionByName(own.join(real, "component", "left_semi")), "components")
        core = _core(stored(core.join(back.withColumnRenamed("node", "a"), "a", "left_anti").join(back.withColumnRenamed("node", "b"), "b", "left_anti"), "links"))
    return found
