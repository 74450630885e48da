"""A catalogue of one's own: equipment, labels and their alternatives from JSON or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.catalog import Model

#: A line of a catalogue file.
CATALOGUE_LINE = "equip string, label string, alternatives array<array<string>>"
#: Alternatives of a catalogue at most: every name is scored against each.
MOST_ALTERNATIVES = 100_000


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``equip, label, alternative`` of a file or folder of JSON lines such as ``{"equip": "AHU", "label": "Humidity", "alternatives": [["RH"], ["AIR", "HUMIDITY"]]}``; a line that isn't one is an error."""
    rows = spark.read.schema(CATALOGUE_LINE).option("mode", "FAILFAST").json(path)
    return rows.select("equip", "label", F.explode("alternatives").alias("alternative"))


def checked_model(rows: DataFrame, most: int = MOST_ALTERNATIVES) -> Model:
    """The catalogue of ``rows(equip, label, alternative)``, in the order of names, for scoring.

    An error names what is wrong: more than ``most`` rows, a row without equipment,
    label or tokens, an empty token, or one alternative of a label twice.  Nothing is sent to the
    driver before its number is known.
    """
    rows = rows.select("equip", "label", "alternative")
    empty = F.coalesce(F.col("equip") == "", F.lit(True)) | F.coalesce(F.col("label") == "", F.lit(True)) | F.coalesce(F.size("alternative") < 1, F.lit(True))
    empty = empty | F.coalesce(F.exists("alternative", lambda token: token.isNull() | (token == "")), F.lit(True))
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(empty).alias("empty")).head()
    if told.n > most:
        raise ValueError(f"a catalogue of {told.n} alternatives; {most} at most")
    if told.empty:
        raise ValueError(f"{told.empty} rows of the catalogue lack equipment, label or tokens")
    twice = rows.groupBy("equip", "label", "alternative").count().where("count > 1").orderBy("equip", "label", "alternative").head(3)
    if twice:
        raise ValueError("twice in the catalogue: " + "; ".join(f"{r.equip} {r.label} {' '.join(r.alternative)}" for r in twice))
    model: Model = {}
    for r in rows.orderBy("equip", "label", "alternative").collect():
        model.setdefault(r.equip, {}).setdefault(r.label, []).append(list(r.alternative))
    return model
