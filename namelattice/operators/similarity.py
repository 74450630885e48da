"""Nodes with alike children: an exact set-similarity join.

Two nodes are alike if both have two children or more, their numbers are equal
or differ by less than (1 - ratio) of the smaller, and the common tokens are
``ratio`` of the larger at least.  Nodes with equal sets of children are one
set first, so a subtree repeated a million times is compared once; sets meet
only over a rare token of theirs (the prefix that a similar set must share),
so frequent tokens make no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import stored


def member_sets(tree: DataFrame, members: DataFrame) -> DataFrame:
    """``set_id, members, size, ord, n_nodes``: distinct sets of two tokens or more; ord is the first node's place."""
    rows = members.where("size >= 2").join(tree.select("node_id", F.struct("first_point", "depth").alias("ord")), "node_id")
    key = F.sha2(F.concat_ws("␟", F.array_sort("members")), 256)
    rows = rows.select(key.alias("set_id"), "members", "size", "ord")
    first = rows.groupBy("set_id").agg(F.min(F.struct("ord", "members")).alias("f"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n_nodes"))
    return first.select("set_id", F.col("f.members").alias("members"), "size", F.col("f.ord").alias("ord"), "n_nodes")


def node_sets(members: DataFrame) -> DataFrame:
    """``node_id, set_id``."""
    return members.where("size >= 2").select("node_id", F.sha2(F.concat_ws("␟", F.array_sort("members")), 256).alias("set_id"))


def sizes_fit(a: Column, b: Column, ratio: float) -> Column:
    most, least = F.greatest(a, b), F.least(a, b)
    return (a == b) | ((most - least) < least * F.lit(1.0 - ratio))


def similar_sets(sets: DataFrame, ratio: float = 0.9) -> DataFrame:
    """``a, b, overlap, size_a, size_b`` with ``a < b``: pairs of different sets that are alike."""
    tokens = sets.select("set_id", "size", F.explode("members").alias("token"))
    rarity = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(rarity, "token").withColumn("rank", F.row_number().over(Window.partitionBy("set_id").orderBy("df", "token")))
    # A set alike shares ratio * size tokens at least, so one of the rarest size - ceil(ratio * size) + 1.
    prefix = ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * F.lit(ratio) - F.lit(1e-9)) + 1).select("set_id", "size", "token")
    left, right = (prefix.select(F.col("set_id").alias(x), F.col("size").alias(f"size_{x}"), "token") for x in "ab")
    pairs = left.join(right, "token").where((F.col("a") < F.col("b")) & sizes_fit(F.col("size_a"), F.col("size_b"), ratio)).drop("token").distinct()
    bodies = sets.select("set_id", "members")
    both = pairs.join(bodies.withColumnsRenamed({"set_id": "a", "members": "ma"}), "a").join(bodies.withColumnsRenamed({"set_id": "b", "members": "mb"}), "b")
    both = both.withColumn("overlap", F.size(F.array_intersect("ma", "mb")))
    return both.where(F.col("overlap") / F.greatest("size_a", "size_b") >= ratio).select("a", "b", "overlap", "size_a", "size_b")


#: Nodes of a set that are paired together, at most, and those of them that are written out with another block at once.
NODES_A_BLOCK, SLICE = 2000, 8


def _written_out(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """``pairs(a, b, overlap, size_a, size_b)`` of sets, ``a = b`` for the nodes of one set with each other, as ``node_a, node_b, overlap, size_a, size_b`` of their nodes.

    The nodes ``of(node_id, set_id)`` of a set are cut in their order into blocks, and two blocks are
    a row until a task writes their pairs out, so a set of many nodes is no work for one task.  As blocks
    are ranges, most lie before or behind each other, so that their pairs are known to be in order and aren't looked at.
    """
    spark = pairs.sparkSession
    # Ranges of rows, so that no task orders a whole set; the number of a row follows the order within its partition.
    placed = of.repartitionByRange("set_id", "node_id").sortWithinPartitions("set_id", "node_id").withColumn("row", F.monotonically_increasing_id())
    blocks = placed.groupBy("set_id", F.floor(F.col("row") / NODES_A_BLOCK).alias("block"))
    blocks = stored(blocks.agg(F.collect_list("node_id").alias("nodes"), F.min("node_id").alias("least"), F.max("node_id").alias("most")), "blocks")
    names = ("set_id", "block", "nodes", "least", "most")
    of_a, of_b = (blocks.withColumnsRenamed({n: x if n == "set_id" else f"{n}_{x}" for n in names}) for x in "ab")
    # Which blocks meet is known by their ranges alone; their nodes are joined to that.
    met = pairs.join(of_a.drop("nodes_a"), "a").join(of_b.drop("nodes_b"), "b").where((F.col("a") != F.col("b")) | (F.col("least_a") <= F.col("least_b")))
    before, behind = F.col("most_a") < F.col("least_b"), F.col("most_b") < F.col("least_a")
    met = met.select("a", "block_a", "b", "block_b", "overlap", "size_a", "size_b", F.when(before, 1).when(behind, -1).otherwise(0).alias("order"))
    filled = met.join(of_a.select("a", "block_a", "nodes_a"), ["a", "block_a"]).join(of_b.select("b", "block_b", "nodes_b"), ["b", "block_b"])
    # Small as these rows are, each is as many as a block squared: their number of partitions is given, so that they aren't put together.
    swap = F.col("order") < 0
    turned = [F.when(swap, F.col(f"{n}_{y}")).otherwise(F.col(f"{n}_{x}")).alias(f"{n}_{x}") for n in ("size", "nodes") for x, y in ("ab", "ba")]
    same = ((F.col("a") == F.col("b")) & (F.col("block_a") == F.col("block_b"))).alias("same")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filled = filled.select("order", same, *(F.col(c).cast("long").alias(c) for c in ("overlap", "size_a", "size_b")), "nodes_a", "nodes_b")
    filled = filled.select("order", "same", "overlap", *turned).repartition(n)
    # Rows that generated code writes out of one row are all held until they are read, so a row is cut into some nodes with a block
    # first; coalesce, to the partitions that there are, ends the code that does that.
    some = F.transform(F.sequence(F.lit(0), F.floor((F.size("nodes_a") - 1) / SLICE).cast("int")), lambda i: F.slice("nodes_a", i * SLICE + 1, SLICE))
    cut = filled.select("order", "same", "overlap", "size_a", "size_b", "nodes_b", F.explode(some).alias("some")).coalesce(n)
    each = cut.withColumn("x", F.explode("some")).drop("some").withColumn("y", F.explode("nodes_b")).drop("nodes_b")
    # In a block with itself each two nodes meet twice.
    x, y, known = F.col("x"), F.col("y"), F.col("order") != 0
    turn = ~known & (x > y)
    return each.where(known | ~F.col("same") | (x < y)).select(
        F.when(turn, y).otherwise(x).alias("node_a"), F.when(turn, x).otherwise(y).alias("node_b"), "overlap",
        F.when(turn, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"), F.when(turn, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"),
    )


def similar_nodes(tree: DataFrame, members: DataFrame, ratio: float = 0.9) -> DataFrame:
    """``node_a, node_b, overlap, size_a, size_b`` with ``node_a < node_b``: all pairs written out.

    As many rows as there are pairs; :func:`similar_sets` with :func:`node_sets`
    says the same in rows that grow with the sets and nodes alone.
    """
    sets = stored(member_sets(tree, members), "sets")
    apart = similar_sets(sets, ratio)
    equal = sets.where("n_nodes > 1").select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.col("size").alias("overlap"), F.col("size").alias("size_a"), F.col("size").alias("size_b"))
    return _written_out(apart.unionByName(equal), node_sets(members))


def similar_sets_asymmetric(members: DataFrame, ratio: float = 0.9) -> DataFrame:
    """``a, b, overlap``: ordered pairs of sets, equal ones with themselves, whose common tokens are ``ratio`` of a's at least, sizes fitting."""
    sets = members.where("size >= 2").select(F.sha2(F.concat_ws("␟", F.array_sort("members")), 256).alias("set_id"), "members", "size").dropDuplicates(["set_id"])
    tokens = sets.select("set_id", "size", F.explode("members").alias("token"))
    rarity = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(rarity, "token").withColumn("rank", F.row_number().over(Window.partitionBy("set_id").orderBy("df", "token")))

    def prefix(name: str, share: float) -> DataFrame:
        # Of a set that must share so many of its tokens, one of the rarest others and one more.
        few = F.col("size") - F.ceil(F.col("size") * F.lit(share) - F.lit(1e-9)) + 1
        return ranked.where(F.col("rank") <= few).select(F.col("set_id").alias(name), F.col("size").alias(f"size_{name}"), "token")

    # a has more than b's tokens / (2 - ratio), so b shares ratio times that.
    met = prefix("a", ratio).join(prefix("b", ratio / (2 - ratio)), "token").where((F.col("a") != F.col("b")) & sizes_fit(F.col("size_a"), F.col("size_b"), ratio)).drop("token").distinct()
    bodies = sets.select("set_id", "members")
    both = met.join(bodies.withColumnsRenamed({"set_id": "a", "members": "ma"}), "a").join(bodies.withColumnsRenamed({"set_id": "b", "members": "mb"}), "b")
    found = both.withColumn("overlap", F.size(F.array_intersect("ma", "mb")).cast("long")).where(F.col("overlap") / F.col("size_a") >= ratio).select("a", "b", "overlap")
    return found.unionByName(sets.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.col("size").cast("long").alias("overlap")))


def similar_asymmetric(members: DataFrame, ratio: float = 0.9) -> DataFrame:
    """``node_a, node_b, overlap``: the pairs of :func:`similar_sets_asymmetric`, written out by nodes."""
    of = node_sets(members)
    pairs = similar_sets_asymmetric(members, ratio).join(of.withColumnsRenamed({"set_id": "a", "node_id": "node_a"}), "a").join(of.withColumnsRenamed({"set_id": "b", "node_id": "node_b"}), "b")
    return pairs.where("node_a <> node_b").select("node_a", "node_b", "overlap")
