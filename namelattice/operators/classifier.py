"""Equipment classes from feature vectors by linear support vector machines, one against the rest.

No fitted model is published, so one is trained on labelled clusters; a saved
model is read with Spark's own loader, which runs no foreign code.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC, OneVsRest, OneVsRestModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import UNINTELLIGIBLE, UNKNOWN
from ..storage import stored
from .catalog import class_codes
from .scoring import scaled


def assembled(vectors: DataFrame, mean: list[float] | None = None, std: list[float] | None = None) -> DataFrame:
    """``concept_id, features``: one vector a concept, in the order of equipment."""
    rows = scaled(vectors, mean, std) if mean and std else vectors
    cells = F.array_sort(F.collect_list(F.struct("equip_ord", "feature")))
    return rows.groupBy("concept_id").agg(cells.alias("c")).select("concept_id", array_to_vector(F.col("c.feature")).alias("features"))


def fitted_scaler(vectors: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and standard deviation of each equipment's feature; a deviation of 0 counts as 1."""
    rows = vectors.groupBy("equip_ord").agg(F.avg("feature").alias("m"), F.stddev_pop("feature").alias("s")).orderBy("equip_ord").collect()
    return [r.m for r in rows], [r.s or 1.0 for r in rows]


@dataclass(frozen=True)
class DeviceModel:
    """A fitted model and the class that each of its predictions stands for."""

    model: OneVsRestModel
    labels: list[str]

    def save(self, path: str) -> None:
        """Under ``path``: the model in Spark's own format, and its labels as a text file."""
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(self.labels),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/labels")

    @classmethod
    def load(cls, path: str) -> "DeviceModel":
        labels = json.loads(SparkSession.active().read.text(f"{path}/labels").first().value)
        return cls(OneVsRestModel.load(f"{path}/model"), labels)


def train(vectors: DataFrame, classes: DataFrame, mean: list[float] | None = None, std: list[float] | None = None, iterations: int = 50) -> DeviceModel:
    """A model from vectors and ``classes(concept_id, class_label)``; labels that are no equipment count as UNKNOWN."""
    label = F.when(F.col("class_label").isin(*class_codes()), F.col("class_label")).otherwise(UNKNOWN)
    known = classes.select("concept_id", label.alias("class_label"))
    labels = sorted(r.class_label for r in known.select("class_label").distinct().collect())  # four at most
    codes = F.create_map(*(F.lit(x) for i, name in enumerate(labels) for x in (name, float(i))))
    rows = assembled(vectors, mean, std).join(known, "concept_id").select("features", codes[F.col("class_label")].alias("label"))
    # The fit goes over the rows again and again.
    return DeviceModel(OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=0.01)).fit(stored(rows, "training")), labels)


def predicted(vectors: DataFrame, sizes: DataFrame, model: DeviceModel, mean: list[float] | None = None, std: list[float] | None = None) -> DataFrame:
    """``concept_id, class_label`` by the model; sizes (concept_id, n) decide first, as for the arg-max."""
    name = F.get(F.array(*map(F.lit, model.labels)), F.col("prediction").cast("int"))
    found = model.model.transform(assembled(vectors, mean, std)).select("concept_id", name.alias("found"))
    label = F.when(F.col("n") > 150, UNINTELLIGIBLE).when(F.col("n") < 2, UNKNOWN).otherwise(F.coalesce("found", F.lit(UNKNOWN)))
    return sizes.join(found, "concept_id", "left").select("concept_id", label.alias("class_label"))
