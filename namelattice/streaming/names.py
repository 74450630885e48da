"""New names as a stream: tokenized as they come, or resolved against a run that is stored.

Tokenizing is local to a row, so the same expression serves a stream; clusters
need the whole table and are formed in batches, after which new names are held
against what a run found.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import stripped, tokens
from ..operators import labelling, vocabulary
from ..operators.tree import SEPARATOR
from ..plans.pipeline import Run
from ..sources.points import name_lines


def tokenized_stream(lines: DataFrame, mode: str = "truncate", watermark: tuple[str, str] | None = None) -> DataFrame:
    """``point_name, tokens`` of a stream of ``value`` lines; with a watermark (column, delay), a name is passed on once within the delay."""
    rows = lines.withColumn("point_name", stripped(F.col("value"))).where("point_name <> '' and not contains(point_name, ',')")
    if watermark:
        rows = rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(["point_name"])
    return rows.select("point_name", tokens(F.col("point_name"), mode).alias("tokens"))


@dataclass(frozen=True)
class Known:
    """What a run knows: leaves of tokens, cut edges, nodes of concepts, classes of concepts, labels of their points."""

    decomposition: DataFrame
    cut: DataFrame
    membership: DataFrame
    classes: DataFrame
    concept_points: DataFrame
    settings: DataFrame

    @classmethod
    def of(cls, run: Run) -> "Known":
        c = run.config
        settings = run.points.sparkSession.createDataFrame([(c.id_mode, c.uncamel)], "id_mode string, uncamel string")
        return cls(run.decomposition.select("token", "leaves"), run.cleaned[0].select("parent_id", "node_id"), run.found.membership, run.classes, run.concept_points, settings)

    def save(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.parquet(f"{path}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Known":
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)})


def resolve_names(names: DataFrame, known: Known, limit: float = 0.0) -> DataFrame:
    """``original_point, leaf, equipment, node, distance, representation`` of ``names(point_name)``, distinct ones.

    A name falls apart as the run's vocabulary does, tokens that it lacks by
    digits and runs alone; nodes on its way are named by its path, and a cut edge
    of the run ends the way up.  A name without a clustered node above it has
    null in all but the first two.
    """
    settings = known.settings.head()
    cut_up = vocabulary.tokenized(names, mode=settings.uncamel).select("point_name", F.posexplode("tokens").alias("pos", "token"))
    own, _ = vocabulary.base_children(F.col("token"))
    alone = F.when(F.size(own) > 0, own).otherwise(F.array("token"))
    fallen = cut_up.join(known.decomposition, "token", "left").select("point_name", "pos", F.coalesce("leaves", alone).alias("leaves"))
    # As many rows a name as it has tokens.
    paths = fallen.groupBy("point_name").agg(F.array_sort(F.collect_list(F.struct("pos", "leaves"))).alias("l")).select("point_name", F.flatten(F.col("l.leaves")).alias("path")).where(F.size("path") > 0)
    between = "" if settings.id_mode == "concat" else SEPARATOR
    nodes = F.transform("path", lambda _, i: F.array_join(F.slice("path", F.lit(1), i + 1), between))
    ways = paths.select("point_name", "path", nodes.alias("nodes"))
    leaves = ways.select(F.col("point_name").alias("leaf_id"), "point_name", F.element_at("nodes", -1).alias("leaf"))
    steps = ways.select("point_name", "path", "nodes", F.posexplode("nodes").alias("at", "node_id")).withColumn("parent_id", F.get("nodes", F.col("at") - 1))
    ends = steps.join(known.cut, ["parent_id", "node_id"], "left_semi").groupBy("point_name").agg(F.max("at").alias("top"))
    above = steps.join(ends, "point_name", "left").where((F.col("at") < F.size("path") - 1) & (F.col("at") >= F.coalesce("top", F.lit(0))))
    rest = F.slice("path", F.col("at") + 2, F.size("path") - F.col("at") - 1)
    closure = above.select(F.col("point_name").alias("node_id"), F.col("node_id").alias("ancestor"), (F.size("path") - 1 - F.col("at")).alias("distance"), rest.alias("rel_path"))
    found = labelling.resolved(labelling.candidates(leaves.drop("leaf"), closure, known.membership, known.classes, known.concept_points, limit))
    return leaves.select(F.col("point_name").alias("original_point"), "leaf").join(found, "original_point", "left")


def resolve_stream(lines: DataFrame, known: Known, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Resolve a stream of ``value`` lines into Parquet under ``path``, each name once.

    Each batch writes a folder of its own, which it writes anew if it is run again
    after a failure, and leaves out names of the folders of other batches; so a
    restart from the checkpoint neither repeats nor loses names.
    """

    def resolve(batch: DataFrame, number: int) -> None:
        names = name_lines(batch.select("value"))[0]
        if number:
            seen = batch.sparkSession.read.option("basePath", path).parquet(*(f"{path}/batch={n}" for n in range(number)))
            names = names.join(seen.select(F.col("original_point").alias("point_name")), "point_name", "left_anti")
        resolve_names(names, known).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(resolve).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
