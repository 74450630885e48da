"""A bounded sample of labelled documents for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, y, t, h)`` of at most ``limit`` labelled documents outside the held-out fold; h is the hash of the text.

    Ids are drawn in the order of their hash, so the sample is spread over the
    table and the same on each run.  Null ids and labels are left out; of
    several labels of an id the largest holds.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    named = named.where(id_remainder(F.col("id"), modulus) != held_out)
    drawn = named.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    return texts.join(F.broadcast(drawn), "id").select("id", "y", "t", F.xxhash64("t").alias("h"))


def one_each(rows: DataFrame, *columns: str) -> DataFrame:
    """``id`` and ``columns`` of one row for each id, that with the least ``h``: the same on each run, whatever order rows arrive in."""
    return rows.groupBy("id").agg(F.min(F.struct("h", *columns)).alias("r")).select("id", *(F.col(f"r.{c}").alias(c) for c in columns))
