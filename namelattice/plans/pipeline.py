"""Whole runs: names to resolved labels, with or without classes, and the training-set builder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import UNKNOWN, Config
from ..operators import clusters, labelling, scoring, semantics, similarity, tree, vocabulary
from ..sources import points as sources
from ..sources import sinks
from ..storage import measured_broadcasts, stored


@dataclass(frozen=True)
class Run:
    """One run over ``points(point_name)``; every table is made when it is first asked for.

    Tables that several others read are written once to the shared folder.
    """

    points: DataFrame
    config: Config = Config()
    classify: bool = False
    #: Plug-ins: (sizes, vectors, floor) to classes of concepts; (points, classes, config) to labels of points; a namer of concepts.
    device_classifier: Callable[[DataFrame, DataFrame, float], DataFrame] = labelling.device_classes
    point_labeller: Callable[[DataFrame, DataFrame, Config], DataFrame] = labelling.assigned_labels
    namer: str = "basic"

    def __post_init__(self) -> None:
        measured_broadcasts(self.points.sparkSession)

    @classmethod
    def from_database(cls, spark: SparkSession, url: str, table: str, dataset_id: str, properties: dict[str, str] | None = None, partitions: tuple[str, int, int, int] | None = None, **options) -> "Run":
        """A run over the points of one dataset of a database, which filters them; ``partitions`` as for ``read_points_jdbc``."""
        points = sources.read_points_jdbc(spark, url, table, dataset_id, properties, partitions)
        return cls(stored(points.select("point_name").distinct(), "points"), **options)

    @cached_property
    def names(self) -> DataFrame:
        return stored(vocabulary.tokenized(self.points, mode=self.config.uncamel), "names")

    @cached_property
    def vocabulary(self) -> DataFrame:
        return stored(vocabulary.token_frequency(self.names), "token_frequency")

    @cached_property
    def decomposition(self) -> DataFrame:
        return stored(vocabulary.decomposed(self.vocabulary), "decomposition")

    @cached_property
    def paths(self) -> DataFrame:
        return stored(vocabulary.expanded(self.names, self.decomposition), "paths")

    @cached_property
    def tree(self) -> DataFrame:
        return stored(tree.nodes(self.paths, self.config.id_mode), "nodes")

    @cached_property
    def leaves(self) -> DataFrame:
        return tree.leaves(self.paths, self.config.id_mode)

    @cached_property
    def members(self) -> DataFrame:
        return stored(tree.members(self.tree), "members")

    @cached_property
    def similar(self) -> DataFrame:
        return similarity.similar_nodes(self.tree, self.members, self.config.similarity)

    @cached_property
    def found(self) -> clusters.Concepts:
        first = clusters.find_concepts(self.tree, self.members, self.config.similarity)
        return clusters.refine(self.tree, self.members, first, self.config.refinement)

    @cached_property
    def cleaned(self) -> tuple[DataFrame, DataFrame]:
        return clusters.clean_up(self.tree, self.found, self.config.cleanup)

    @cached_property
    def inner_chains(self) -> DataFrame:
        return tree.inner_chains(self.tree, self.cleaned[0])

    @cached_property
    def closure(self) -> DataFrame:
        return tree.closure(self.tree, self.cleaned[0], self.inner_chains)

    @cached_property
    def edges(self) -> DataFrame:
        # Clustered nodes have children, so ways up from others aren't needed.
        return stored(semantics.association_edges(self.tree, tree.inner_closure(self.inner_chains), self.found.membership, self.cleaned[1]), "association")

    @cached_property
    def unlabelled(self) -> DataFrame:
        c = self.config
        return stored(semantics.concept_points(self.tree, self.closure, self.found.membership, self.cleaned[1], c.least_members, c.most_members), "concept_points")

    @cached_property
    def concept_names(self) -> DataFrame:
        return semantics.NAMERS[self.namer](self.tree, self.members, self.found.concepts, self.found.membership)

    @cached_property
    def prepared(self) -> DataFrame:
        return stored(scoring.without_common_prefix(self.unlabelled), "prepared")

    @cached_property
    def vectors(self) -> DataFrame:
        return stored(scoring.feature_vectors(self.prepared, scoring.label_scores(self.prepared)), "features")

    @cached_property
    def classes(self) -> DataFrame:
        """``concept_id, class_label``: all UNKNOWN unless the run classifies."""
        if not self.classify:
            return self.found.concepts.select("concept_id", F.lit(UNKNOWN).alias("class_label"))
        sizes = self.unlabelled.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
        own = self.device_classifier(sizes, self.vectors, self.config.class_floor)
        return stored(labelling.concept_classes(self.found.concepts, self.edges, own), "classes")

    @cached_property
    def concept_points(self) -> DataFrame:
        if not self.classify:
            return self.unlabelled
        return stored(labelling.relabelled(self.unlabelled, self.point_labeller(self.prepared, self.classes, self.config)), "labelled")

    def candidates(self, limit: float = 0.0, drop_unknown: bool = False) -> DataFrame:
        return labelling.candidates(self.leaves, self.closure, self.found.membership, self.classes, self.concept_points, limit, drop_unknown)

    def resolved(self, limit: float = 0.0) -> DataFrame:
        return labelling.resolved(self.candidates(limit))

    def save(self, path: str, limit: float = 0.0) -> None:
        """Candidates and the best label of each name, as CSV folders under ``path``."""
        found = stored(self.candidates(limit), "candidates")
        sinks.write_candidates(found, f"{path}/candidates", "csv")
        sinks.write_resolved(labelling.resolved(found), f"{path}/resolved")

    def report(self) -> DataFrame:
        """``metric, value`` of the tree and its concepts."""
        explained = semantics.explained_leaves(self.leaves, self.closure, self.found.membership)
        counts = explained.agg(F.sum(F.col("explained").cast("long")).alias("e"), F.sum((~F.col("explained")).cast("long")).alias("u"))
        unique = semantics.unique_points(self.tree, self.closure, self.found.membership).agg(F.sum("n_points").alias("n"))
        return (
            tree.report(self.tree)
            .unionByName(counts.selectExpr("stack(2, 'explained', coalesce(e, 0), 'unexplained', coalesce(u, 0)) as (metric, value)"))
            .unionByName(unique.selectExpr("'unique_points' as metric", "coalesce(n, 0) as value"))
            .unionByName(self.found.concepts.agg(F.count(F.lit(1)).alias("value")).selectExpr("'concepts' as metric", "value"))
        )


def training_lines(clusters_table: DataFrame) -> DataFrame:
    """Labelled clusters (as ``sources.points.read_clusters`` gives them) to libsvm lines."""
    prepared = stored(sources.cluster_points(clusters_table), "prepared")
    vectors = scoring.feature_vectors(prepared, scoring.label_scores(prepared))
    classes = clusters_table.select(F.col("cluster").alias("concept_id"), "class_label").distinct()
    return sinks.libsvm_lines(vectors, classes)
