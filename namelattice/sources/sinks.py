"""Results as files and tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import stored


def write_candidates(found: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Candidates as they are, or for CSV with each list as JSON."""
    if fmt == "csv":
        lists = {name: F.to_json(F.col(f"cands.{field}")) for name, field in (("className", "class"), ("clusterID", "node"), ("label", "label"), ("distance", "score"))}
        found.select(F.col("point_name").alias("pointName"), *(c.alias(n) for n, c in lists.items())).write.option("header", True).csv(path)
    else:
        found.write.format(fmt).save(path)


def write_resolved(rows: DataFrame, path: str) -> None:
    names = {"original_point": "OriginalPoint", "equipment": "Equipment", "node": "Node", "distance": "Distance", "representation": "Representation"}
    rows.select(*(F.col(a).alias(b) for a, b in names.items())).write.option("header", True).csv(path)


def candidate_lines(found: DataFrame) -> DataFrame:
    """``value``: name, class, node, label and score of each candidate, comma and tab between, in the order of names."""
    rows = found.select("point_name", F.explode("cands").alias("c")).orderBy("point_name", "c.ord")
    return rows.select(F.concat_ws(",\t", "point_name", "c.class", "c.node", "c.label", F.col("c.score").cast("string")).alias("value"))


#: Columns that describe a dataset, and those of its points.
DATASET_COLUMNS = ["dataset_name", "vendor", "date", "distributor", "site"]
POINT_COLUMNS = ["point_name", "description", "object_type", "device_id", "device_name", "object_id", "program_name", "value"]


@contextmanager
def _statements(spark: SparkSession, url: str, properties: dict[str, str]) -> Iterator[Callable[[str], int | None]]:
    """Runs statements of one transaction from the driver: each gives its one number, if it is a query; an error rolls all of them back."""
    jvm = spark._jvm
    given = jvm.java.util.Properties()
    for key, value in properties.items():
        given.setProperty(key, value)
    if "driver" in properties:  # as the JDBC source does
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()

        def run(sql: str) -> int | None:
            if not statement.execute(sql):
                return None
            rows = statement.getResultSet()
            rows.next()
            return rows.getLong(1)

        yield run
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def _quoted(columns: list[str]) -> str:
    return ", ".join(f'"{c}"' for c in columns)


def stage_rows(rows: DataFrame, url: str, staging: str, properties: dict[str, str]) -> None:
    """Append ``rows``, which hold a ``place`` each, to the staging table; a task that is tried again repeats places with the same rows."""
    rows.write.jdbc(url, f'"{staging}"', mode="append", properties=properties)


def publish_rows(spark: SparkSession, expected: int, columns: list[str], url: str, staging: str, table: str, properties: dict[str, str]) -> None:
    """Put the staged rows into ``table``, one a place, in one transaction; an error, with nothing put in, if there aren't ``expected`` places."""
    with _statements(spark, url, properties) as run:
        once = f'SELECT DISTINCT "place", {_quoted(columns)} FROM "{staging}"'
        found, places = run(f"SELECT count(*) FROM ({once}) d"), run(f'SELECT count(DISTINCT "place") FROM "{staging}"')
        if not found == places == expected:
            raise RuntimeError(f"{staging} holds {found} rows in {places} places, not {expected}")
        run(f"INSERT INTO {table} ({_quoted(columns)}) SELECT {_quoted(columns)} FROM ({once}) d")


def append_once(rows: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> int:
    """Append ``rows`` to a database table, each exactly once or none at all, and return how many.

    Tasks write in batches to a staging table of this call, which takes its
    types from ``table``; the database itself moves it in one transaction when all have
    ended.  Rows are first stored, so that a task that is tried again writes the same rows in the
    same places, of which one is kept; nothing but counts passes through the driver.
    """
    spark, properties, columns = rows.sparkSession, properties or {}, rows.columns
    placed = stored(rows, "rows").withColumn("place", F.monotonically_increasing_id())
    staging = f"staging_{uuid.uuid4().hex[:16]}"
    with _statements(spark, url, properties) as run:
        run(f'CREATE TABLE "{staging}" AS SELECT {_quoted(columns)} FROM {table} WITH NO DATA')
        run(f'ALTER TABLE "{staging}" ADD COLUMN "place" BIGINT')
    try:
        stage_rows(placed, url, staging, properties)
        expected = placed.count()
        publish_rows(spark, expected, columns, url, staging, table, properties)
    finally:
        with _statements(spark, url, properties) as run:
            run(f'DROP TABLE "{staging}"')
    return expected


def write_dataset(points: DataFrame, about: dict[str, str], url: str, index_table: str, point_table: str, properties: dict[str, str] | None = None) -> int:
    """Append a row of DATASET_COLUMNS to the index table, read back the id that the database gave it, and append the points under this id, exactly once or not at all.

    The newest of equal rows counts.
    """
    spark, properties = points.sparkSession, properties or {}
    about = {c: about.get(c) for c in DATASET_COLUMNS}
    row = spark.createDataFrame([tuple(about.values())], ", ".join(f"{c} string" for c in DATASET_COLUMNS))
    append_once(row, url, index_table, properties)
    same = [F.col(c).isNull() if v is None else F.col(c) == v for c, v in about.items()]
    index = spark.read.jdbc(url, index_table, properties=properties)
    dataset_id = index.where(reduce(and_, same)).agg(F.max("dataset_id").alias("id")).first().id
    append_once(points.select(*POINT_COLUMNS, F.lit(dataset_id).alias("dataset_id")), url, point_table, properties)
    return dataset_id


def instance_sections(concepts: DataFrame, membership: DataFrame, members: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(concept, n_instances, n_members)`` and ``(concept, node_id, n_children, children)``."""
    named = concepts.join(names, "concept_id").select("concept_id", "name", F.size("members").alias("n_members"))
    counts = membership.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_instances"))
    first = named.join(counts, "concept_id", "left").select(F.col("name").alias("concept"), F.coalesce("n_instances", F.lit(0)).alias("n_instances"), "n_members")
    rows = membership.join(named, "concept_id").join(members, "node_id")
    return first, rows.select(F.col("name").alias("concept"), "node_id", F.col("size").alias("n_children"), F.array_join("members", ",").alias("children"))


def cluster_json(concept_points: DataFrame, classes: DataFrame, membership: DataFrame) -> DataFrame:
    """``value``: a labelled cluster a line, with its nodes and its points' labels and scores."""
    points = concept_points.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rel_path").alias("POINT"), F.col("label").alias("LABEL"), F.col("score").alias("likelihood")))).alias("POINTS"))
    counts = membership.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
    rows = points.join(classes, "concept_id").join(counts, "concept_id", "left")
    return rows.select(F.to_json(F.struct(F.col("class_label").alias("LABEL"), F.col("concept_id").alias("id"), F.coalesce("n", F.lit(0)).alias("#instances"), "POINTS")).alias("value"))


def dot_lines(names: DataFrame, instances: DataFrame, edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``ord, value``: the concept graph as lines of the DOT language, nodes wider by the logarithm of their instances.

    With ``classes(concept_id, class_label, n_points)``, concepts of more than
    three points stand in a cluster of their class, all others in a first one.
    """
    colour = F.create_map(*(F.lit(x) for x in ("association", "red", "contains", "black", "derivation", "blue")))
    sized = names.join(instances, "concept_id", "left").withColumn("width", 1.6 + F.ln(F.greatest(F.coalesce("n_instances", F.lit(1)), F.lit(1))))
    quoted = F.format_string('"%s" [label="%s" width=%.3f];', "concept_id", F.replace("name", F.lit('"'), F.lit("'")), "width")
    spark = names.sparkSession
    if classes is None:
        nodes = sized.select(F.lit("1").alias("ord"), quoted.alias("value"))
    else:
        rows = sized.join(classes, "concept_id", "left")
        rows = rows.select(F.when(F.col("n_points") > 3, F.concat(F.lit("device "), F.col("class_label"))).otherwise(F.lit("")).alias("group"), quoted.alias("value"))
        groups = rows.select("group").distinct()
        title = F.when(F.col("group") == "", F.lit("other")).otherwise(F.col("group"))
        head = groups.select(F.concat(F.lit("1"), F.col("group"), F.lit("/0")).alias("ord"), F.format_string('subgraph "cluster %s" { label="%s"; style=filled; color=lightgrey;', title, title).alias("value"))
        body = rows.select(F.concat(F.lit("1"), F.col("group"), F.lit("/1")).alias("ord"), "value")
        nodes = head.unionByName(body).unionByName(groups.select(F.concat(F.lit("1"), F.col("group"), F.lit("/2")).alias("ord"), F.lit("}").alias("value")))
    arrows = edges.select(F.lit("2").alias("ord"), F.format_string('"%s" -> "%s" [color=%s];', "src", "dst", F.coalesce(colour[F.col("edge_type")], F.lit("black"))).alias("value"))
    ends = spark.createDataFrame([("0", "digraph concepts {"), ("3", "}")], "ord string, value string")
    return ends.unionByName(nodes).unionByName(arrows)


def libsvm_lines(vectors: DataFrame, classes: DataFrame) -> DataFrame:
    """``value``: class code, then ``index:feature`` from 0 on, tabs between; unknown classes have code 0."""
    from ..operators.catalog import class_codes

    code = F.coalesce(F.create_map(*(F.lit(x) for pair in class_codes().items() for x in pair))[F.col("class_label")], F.lit(0))
    rows = vectors.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("equip_ord", "feature"))).alias("f")).join(classes, "concept_id")
    cells = F.transform("f", lambda x: F.concat_ws(":", x["equip_ord"].cast("string"), x["feature"].cast("string")))
    return rows.select(F.concat_ws("\t", code.cast("string"), F.array_join(cells, "\t")).alias("value"))


def scaler_json(mean: list[float], std: list[float]) -> str:
    return json.dumps({"param": {"with_mean": True, "with_std": True}, "mean": mean, "std": std})


def read_scaler(text: str) -> tuple[list[float], list[float]]:
    found = json.loads(text)
    return found["mean"], found["std"]
