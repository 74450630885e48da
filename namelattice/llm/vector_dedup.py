"""Near-duplicate vectors by sorted projection passes.

Each pass gives every vector the bits of random hyperplanes, concatenated;
vectors are ordered by them, and each is compared in double precision with the
``WINDOW`` or more that follow it in that order.  Every other pass takes the
hyperplanes through the mean of the table, where vectors that share a direction
still differ.  A window covers a run of equal leading bits where vectors lie
apart; where they crowd it covers as many more leading bits as it takes, so a
pass costs the same wherever vectors lie, and crowds need more passes.

The order is cut into spans by place, not by bits: a task has ``SPAN`` places and
one window of those after it, whatever the bits are, so no bucket is hot.  Bits
and node digests are what is sorted; vectors are fetched once for each pass and
the window that two spans share.  Pairs found in a task are contracted to stars
before they leave it, and all passes are united as connected components.

The first passes are as many as find a pair at the threshold with probability
``RECALL`` among vectors that lie apart.  Then recall is measured: ``PROBES``
vectors, drawn by digest, are compared with all vectors, and up to ``BINS`` links
of each, drawn too, are looked for among the components.  Passes go on until the
share found is ``RECALL`` or more.

Links are then counted inside components by blocks of vectors: a component,
however large, is dealt out as pairs of blocks, no pair of vectors ever being a
row.  Vectors nearer than half the threshold's angle to their component's centre
are all linked with each other and counted without comparing them.  Equal
vectors are one node that counts as often as it occurs.

Vectors travel in the precision they are stored in and are compared in double.

Vectors that are null, empty, all zero, or hold a null or non-finite component
link with nothing; vectors of different lengths never link; a null id is allowed
and stays null; repeated rows are copies; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bounded import broadcast_if_small
from ..operators.components import connected_components
from ..storage import released, ship, stored

SIMILARITY, RECALL = 0.9, 0.99
#: Hyperplanes whose bits are concatenated, and passes that share a job (so much more than the table is shuffled at once).
BITS, PASSES_A_JOB = 48, 8
#: Neighbours that a vector is compared with at least, and places of the order in a task.
WINDOW, SPAN = 1024, 8192
#: Vectors that recall is measured on, and links looked for of each.
PROBES, BINS = 4096, 8
#: Vectors in a block when links are counted, vectors of small components in a task, and vectors a centre is the mean of, about.
BLOCK, TOGETHER, CENTRE_OF = 512, 4096, 64


def passes_for(bits: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Passes that find a pair at the threshold with probability ``recall`` if it must share so many leading bits."""
    meet = (1 - math.acos(similarity) / math.pi) ** bits
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _kind(vectors: DataFrame, vector: str) -> str:
    """How components travel: floats as they are, all else as doubles."""
    return "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"


def _usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, vec`` as little-endian components; null where a vector can't link."""
    kind = _kind(vectors, vector)
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch.column("v"):
                values = cell.values
                x = None
                if values is not None and len(values) and not values.null_count:
                    x = values.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # -0.0 becomes 0.0
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                out.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "vec"])

    id_type = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(pack, f"id {id_type}, vec binary")


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of large components overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(raw: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.array([len(r) for r in raw])
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _probes(nodes: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Digests and vectors of at most ``PROBES`` nodes, those of the least hashes."""
    drawn = nodes.select("node", "vec", F.xxhash64("node").alias("h")).orderBy("h", "node").limit(PROBES).toArrow()
    return drawn.column("node").to_pylist(), drawn.column("vec").to_pylist()


def _links_of_probes(nodes: DataFrame, digests: list[bytes], vecs: list[bytes], kind: str, similarity: float) -> DataFrame:
    """``a, b``: of each probe ``a`` up to ``BINS`` of its links over all nodes, the least by hash of each bin of hashes."""
    shared = nodes.sparkSession.sparkContext.broadcast((digests, vecs))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, raw = shared.value
        by_size = {len(raw[pick[0]]): (pick, _unit([raw[i] for i in pick], kind)) for pick in _by_length(raw)} if raw else {}
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                rows = batch.slice(start, 2048)
                ids, h, cells = rows.column("node").to_pylist(), rows.column("h").to_numpy(), rows.column("vec").to_pylist()
                a, b, hs = [], [], []
                for pick in _by_length(cells):
                    size = len(cells[pick[0]])
                    if size in by_size:
                        probe, unit = by_size[size]
                        pick = pick[np.argsort(h[pick], kind="stable")]
                        close = _unit([cells[i] for i in pick], kind) @ unit.T >= similarity
                        place = {names[j]: at for at, j in enumerate(probe)}
                        for at, i in enumerate(pick):
                            if ids[i] in place:
                                close[at, place[ids[i]]] = False
                        for bin_ in range(BINS):
                            some = np.flatnonzero(h[pick] % BINS == bin_)
                            if len(some):
                                first = close[some].argmax(axis=0)
                                for j in np.flatnonzero(close[some].any(axis=0)):
                                    i = pick[some[first[j]]]
                                    a.append(names[probe[j]])
                                    b.append(ids[i])
                                    hs.append(int(h[i]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(hs, pa.int64())], names=["a", "b", "h"])

    met = nodes.select("node", "vec", F.xxhash64("node").alias("h")).mapInArrow(search, "a binary, b binary, h long")
    least = met.groupBy("a", F.pmod("h", F.lit(BINS)).alias("bin")).agg(F.min(F.struct("h", "b")).alias("least"))
    return least.select("a", F.col("least.b").alias("b"))


def _share_found(expected: DataFrame, found: DataFrame) -> float:
    """Of the links ``expected(a, b)`` those within one of the components ``found(node, component)``; 1 if none are expected."""
    left, right = (found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    joined = expected.join(left, "a", "left").join(right, "b", "left")
    share = joined.agg(F.avg(F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False)).cast("double")).alias("share")).first().share
    return 1.0 if share is None else share


def _keys(nodes: DataFrame, first: int, count: int, means: dict[int, np.ndarray], seed: int, kind: str) -> DataFrame:
    """``pass, dim, key, node``: a row for each node and pass."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        odd = np.repeat(np.arange(first, first + count) % 2, BITS)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                raw = rows.column("vec").to_pylist()
                for pick in _by_length(raw):
                    unit = _unit([raw[i] for i in pick], kind)
                    dim, n = unit.shape[1], len(pick)
                    if dim not in planes:
                        normals = np.concatenate([np.random.default_rng([seed, p, dim]).normal(size=(dim, BITS)) for p in range(first, first + count)], axis=1)
                        planes[dim] = normals, odd * (means.get(dim, np.zeros(dim)) @ normals)
                    normals, shift = planes[dim]
                    keys = ((unit @ normals > shift).reshape(n, count, BITS)) @ powers
                    chosen = rows.column("node").take(pa.array(pick))
                    for p in range(count):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, first + p, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(keys[:, p]), chosen], names=["pass", "dim", "key", "node"])

    return nodes.select("node", "vec").mapInArrow(project, "pass int, dim int, key long, node binary")


def _places(keys: DataFrame) -> DataFrame:
    """``pass, dim, node, place``: the place of each row in the order of passes, lengths, bits and digests."""
    order = ["pass", "dim", "key", "node"]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = keys.repartitionByRange(*order).sortWithinPartitions(*order).select("pass", "dim", "node", F.spark_partition_id().alias("part"), inside.alias("at"))
    # Written before it is read twice: ranges are drawn anew by each run.
    ranges = stored(ranges, "ordered")
    sizes = sorted(map(tuple, ranges.groupBy("part").count().collect()))  # a row a partition
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).astype(int).tolist()
    starts = keys.sparkSession.createDataFrame([(part, start) for (part, _), start in zip(sizes, before)], "part int, start long")
    return ranges.join(F.broadcast(starts), "part").select("pass", "dim", "node", (F.col("start") + F.col("at")).alias("place"))


def _stars(close: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Components of a symmetric truth table, as their first place and the others."""
    free = close.any(axis=1)
    for first in np.flatnonzero(free):
        if free[first]:
            free[first] = False
            members, edge = [], np.array([first])
            while len(edge):
                edge = np.flatnonzero(close[edge].any(axis=0) & free)
                free[edge] = False
                members.append(edge)
            yield first, np.concatenate(members)


def _windows(nodes: DataFrame, places: DataFrame, kind: str, similarity: float) -> DataFrame:
    """``a, b``: stars over the linked rows of each span of ``places``, every row compared with ``WINDOW`` rows after it or more."""
    span = F.floor(F.col("place") / SPAN)
    shared = (F.col("place") % SPAN < WINDOW) & (span > 0)
    task = F.explode(F.when(shared, F.array(span, span - 1)).otherwise(F.array(span)))
    tasks = places.join(nodes.select("node", "vec"), "node").withColumn("task", task)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort(table.column("place").to_numpy(), kind="stable")
        marks = np.stack([table.column(c).to_numpy() for c in ("pass", "dim")])[:, order]
        own = table.column("place").to_numpy() // SPAN == table.column("task")[0].as_py()
        vecs, nodes_ = table.column("vec"), table.column("node").to_pylist()
        a, b = [], []
        for at in np.split(order, np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1):
            unit = _unit(vecs.take(pa.array(at)).to_pylist(), kind)
            for start in range(0, int(own[at].sum()), 512):
                rows = unit[start : start + 512]
                ahead = unit[start : start + 512 + WINDOW]
                close = np.zeros((len(ahead), len(ahead)), dtype=bool)
                close[: len(rows)] = rows @ ahead.T >= similarity
                close |= close.T
                np.fill_diagonal(close, False)
                for first, others in _stars(close):
                    a += [nodes_[at[start + first]]] * len(others)
                    b += [nodes_[at[start + i]] for i in others]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return tasks.groupBy("task").applyInArrow(compare, "a binary, b binary").distinct()


def found_components(nodes: DataFrame, rows: int, kind: str, similarity: float = SIMILARITY, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """``node, component`` of the nodes that passes link, as many passes as reach the measured recall."""
    spark: SparkSession = nodes.sparkSession
    digests, vecs = _probes(nodes)
    units = [_unit([vecs[i] for i in pick], kind) for pick in _by_length(vecs)] if vecs else []
    means = {u.shape[1]: u.mean(axis=0) for u in units}
    expected = stored(_links_of_probes(nodes, digests, vecs, kind, similarity), "probed")
    links, done, total = None, 0, passes_for(max(0, math.ceil(math.log2(max(1, rows) / WINDOW))), similarity, recall)
    while True:
        while done < total:
            count = min(PASSES_A_JOB, total - done)
            with released(spark):
                part = stored(_windows(nodes, _places(_keys(nodes, done, count, means, seed, kind)), kind, similarity), "links", keep=True)
            links = part if links is None else links.unionByName(part)
            done += count
        with released(spark):
            found = stored(connected_components(links), "components", keep=True)
        if _share_found(expected, found) >= recall:
            return found
        links, total = found.select(F.col("node").alias("a"), F.col("component").alias("b")), done + PASSES_A_JOB


def _with_core(large: DataFrame, kind: str, similarity: float) -> DataFrame:
    """``large(comp, node, vec, copies, blocks)`` with ``core``: so near the centre of its component that all such are linked.

    The centre is the mean of about ``CENTRE_OF`` vectors drawn by digest; any
    centre is right, a good one makes more vectors core.
    """
    drawn = large.where(F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks") * max(1, BLOCK // CENTRE_OF)) == 0).select("comp", "vec")

    def mean(table: pa.Table) -> pa.Table:
        centre = _unit(table.column("vec").to_pylist(), kind).mean(axis=0)
        return pa.table({"comp": table.column("comp").slice(0, 1), "centre": pa.array([centre.tobytes()], pa.binary())})

    centres = broadcast_if_small(stored(drawn.groupBy("comp").applyInArrow(mean, "comp binary, centre binary"), "centres"), 2000)
    # Two angles of less than half the threshold's add up to less than it; the margin is for rounding.
    near = math.cos(max(0.0, math.acos(similarity) / 2 - 1e-6))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = np.zeros(batch.num_rows, dtype=bool)
            raw, centre = batch.column("vec").to_pylist(), batch.column("centre").to_pylist()
            for i in range(batch.num_rows):
                if centre[i] is not None:
                    c = np.frombuffer(centre[i])
                    norm = np.linalg.norm(c)
                    core[i] = norm > 0 and _unit([raw[i]], kind)[0] @ c >= near * norm
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("comp", "node", "vec", "copies")), pa.array(core)], names=["comp", "node", "vec", "copies", "core"])

    return large.join(centres, "comp", "left").select("comp", "node", "vec", "copies", "centre").mapInArrow(mark, "comp binary, node binary, vec binary, copies long, core boolean")


_COUNTED = "node binary, links long"


def _counted_links(members: DataFrame, rows: int, kind: str, similarity: float) -> DataFrame:
    """``node, links``: other vectors of the component within the threshold, from ``members(node, comp, vec, copies)``."""
    sizes = stored(members.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "sizes")
    known = members.join(sizes, "comp").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    # Small components share a task's call, about TOGETHER vectors of them.
    calls = max(1, math.ceil(rows / TOGETHER))
    small = F.struct(F.lit(b"").alias("comp"), F.pmod(F.xxhash64("comp"), F.lit(calls)).cast("int").alias("i"), F.lit(-1).alias("j"))
    columns = ["task", "comp", "own", "node", "vec", "copies"]
    together = known.where("blocks = 1").withColumn("task", small).withColumn("own", F.lit(0)).select(*columns)
    # A large one is dealt as pairs of its blocks: others first, then core, which meets the others only.
    marked = stored(_with_core(known.where("blocks > 1"), kind, similarity), "marked")
    of_core = F.coalesce(F.sum(F.col("core").cast("long")), F.lit(0))
    parts = marked.groupBy("comp").agg(of_core.alias("n_core"), F.sum(F.when(F.col("core"), F.col("copies"))).alias("core_copies"), F.count(F.lit(1)).alias("n"))
    parts = stored(parts.select("comp", "core_copies", F.ceil((F.col("n") - F.col("n_core")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("n_core") / BLOCK).cast("int").alias("cores")), "parts")
    dealt = marked.join(broadcast_if_small(parts, 200_000), "comp")
    of = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.when(F.col("core"), F.col("cores")).otherwise(F.col("others")))).cast("int")
    own = F.when(F.col("core"), F.col("others") + of).otherwise(of)
    last = F.when(F.col("core"), F.col("others")).otherwise(F.col("others") + F.col("cores")) - 1
    inside = dealt.where("core").select("node", (F.col("core_copies") - F.col("copies")).alias("links"))
    dealt = dealt.where("not core or others > 0").withColumn("own", own)
    pair = F.explode(F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(F.col("comp"), F.least(F.col("own"), x).alias("i"), F.greatest(F.col("own"), x).alias("j"))))
    dealt = together.unionByName(dealt.withColumn("task", pair).select(*columns))

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        comps, own = table.column("comp").to_pylist(), table.column("own").to_numpy()
        task = table.column("task")[0].as_py()
        groups: dict = {}
        for at, comp in enumerate(comps):
            groups.setdefault(comp, []).append(at)
        raw, copies, links = table.column("vec").to_pylist(), table.column("copies").to_numpy(), np.zeros(len(comps), dtype=np.int64)
        for places in groups.values():
            where = np.array(places)
            for pick in _by_length([raw[i] for i in where]):
                at = where[pick]
                unit = _unit([raw[i] for i in at], kind)
                if task["j"] == -1 or task["i"] == task["j"]:
                    links[at] = (unit @ unit.T >= similarity) @ copies[at]
                    links[at] -= np.where(np.einsum("ij,ij->i", unit, unit) >= similarity, copies[at], 0)
                else:
                    left, right = own[at] == task["i"], own[at] == task["j"]
                    close = unit[left] @ unit[right].T >= similarity
                    links[at[left]], links[at[right]] = close @ copies[at][right], close.T @ copies[at][left]
        return pa.table({"node": table.column("node"), "links": pa.array(links)})

    return dealt.groupBy("task").applyInArrow(count, _COUNTED).unionByName(inside).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each row of ``vectors``."""
    ship(vectors.sparkSession)
    kind = _kind(vectors, vector)
    usable = stored(_usable(vectors, id_col, vector).withColumn("node", F.unhex(F.md5("vec"))), "vectors")
    linkable = usable.where("vec is not null")
    nodes = stored(linkable.groupBy("node").agg(F.first("vec").alias("vec"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    found = found_components(nodes, nodes.count(), kind, similarity, recall)
    members = stored(nodes.join(found, "node").select("node", F.col("component").alias("comp"), "vec", "copies", "least"), "members")
    counted = stored(_counted_links(members.drop("least"), members.count(), kind, similarity), "counted")
    firsts = members.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = members.select("node", "comp").join(firsts, "comp").join(counted, "node").select("node", "component_id", "links")
    known = nodes.select("node", "least", "copies").join(named, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    rows = linkable.select("id", "node").join(stored(known, "known"), "node").select("id", "n_links", "component_id")
    alone = usable.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = rows.unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
