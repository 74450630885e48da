"""Names and metadata from text, tables, databases and labelled cluster files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema
from ..functions.text import stripped
from ..operators.scoring import without_common_prefix

#: The key by which two points are one.
POINT_KEY = ["point_name", "object_type", "device_id", "object_id"]


def name_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(points, rejected)`` from ``lines(value)``: trimmed, not empty, without a comma, distinct; rejected lines hold a comma."""
    rows = lines.select(stripped(F.col("value")).alias("value")).where("value <> ''")
    comma = F.contains("value", F.lit(","))
    return rows.where(~comma).select(F.col("value").alias("point_name")).distinct(), rows.where(comma)


def read_names(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One name a line, UTF-8, no header."""
    return name_lines(spark.read.text(path))


def distinct_points(points: DataFrame) -> DataFrame:
    """Points as a set: names blank by default, one row a POINT_KEY."""
    filled = points.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("object_type", "object_id")} | {"device_id": F.coalesce("device_id", F.lit(-1))})
    return filled.dropDuplicates(POINT_KEY)


def read_points_jdbc(spark: SparkSession, url: str, table: str, dataset_id: str, properties: dict[str, str] | None = None, partitions: tuple[str, int, int, int] | None = None) -> DataFrame:
    """Points of one dataset from a database; the filter runs there.

    ``partitions`` (column, lower, upper, number) reads in parallel.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **(properties or {}))
    if partitions:
        column, lower, upper, number = partitions
        reader = reader.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(number))
    return distinct_points(reader.load().where(F.col("dataset_id") == dataset_id))


def read_clusters(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``cluster, class_label, at, tokens, point_label`` from labelled cluster files; folders give all their ``.json``."""
    rows = spark.read.schema(schema.CLUSTER_FILE).option("multiLine", True).option("pathGlobFilter", "*.json").json(paths)
    classes = rows.select(F.input_file_name().alias("file"), F.posexplode("CLASSES").alias("k", "c"))
    named = classes.select(F.concat_ws("#", "file", "k").alias("cluster"), F.col("c.LABEL").alias("class_label"), F.posexplode("c.POINTS").alias("at", "p"))
    return named.select("cluster", "class_label", "at", F.col("p.POINT").alias("tokens"), F.col("p.LABEL").alias("point_label"))


def cluster_truth(clusters: DataFrame) -> DataFrame:
    """``point_key, point_label``: the label of each comma-joined token list."""
    return clusters.select(F.concat_ws(",", "tokens").alias("point_key"), "point_label").distinct()


def cluster_points(clusters: DataFrame) -> DataFrame:
    """``concept_id, rel_path, tokens`` of labelled clusters, prepared as for scoring."""
    return without_common_prefix(clusters.select(F.col("cluster").alias("concept_id"), F.col("tokens").alias("rel_path")))
