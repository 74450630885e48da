"""The training-data operators as one pipeline over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps,
all columns, also such as clash with names used inside; the last returns a row
for each document written.  Between stages the documents lie as Parquet in the
shared folder, so a lost executor costs a re-read of one stage's input; what a
stage wrote on its way is dropped once its documents are stored.

Null and empty texts are clean: they pass toxicity by the bias alone, are no
one's duplicates, hold no benchmark window, weigh nothing in the mix and take an
end id in the token files.  Null ids are allowed and come last among copies and
first in files; rows equal in id and text are one document to the duplicates
stage and go together through all others; of equal copies the least id stays.
An empty table passes through all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namelattice.llm import bagminhash, decontam, mixing, token_orc, toxicity
from namelattice.llm.queries import tokenizer_path
from namelattice.storage import released, stored


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject; all of them where no label is left to learn."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id; all documents without words."""
    return bagminhash.drop_near_duplicates(docs)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; all of them where there is no item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, null sources being one source."""
    return mixing.mixed(docs)


def written(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document in the token files, which are written in the order of ids, null first."""
    return token_orc.token_file_rows(docs, tokenizer_path())


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", not_contaminated),
    ("mixing", mixed),
    ("token_files", written),
]

#: Scores of a fitted model and token ids have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with released(spark):
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
