"""Token ids of a corpus as ORC files that can be read stripe by stripe.

One row is one document: ``doc_id``, ``n_tokens``, ``first`` (the ids before it
in its part), ``part`` and ``ids``.  ORC stores the ids with its integer
run-length encoding; every stripe has row indexes, and Bloom filters on
``doc_id`` let a point read skip stripes.  Parts are ranges of ascending
``doc_id``; a manifest of one row a part holds the ids before it, so that
``start`` needs no global sort beyond the range partitioning, and readers take
stripes in parallel.

Null ids sort first; equal ids are ordered by text.  Null and empty texts give
just the end id.  An empty table writes no part and reads back empty.  Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bounded import broadcast_if_small
from ..storage import fresh_path, ship
from .tokens import encoder, steps

END_ID = 1
#: Parts whose rows in the manifest are broadcast.
MOST_PARTS = 500_000


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, stripe_mb: int = 16, cache_size: int = 1_000_000) -> None:
    """Encode every whole text and write ``path``/ids (ORC) and ``path``/manifest (ORC)."""
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    # Ranges are dealt before encoding: the sampling pass of the range partitioner then costs a scan only.
    ordered = narrow.repartitionByRange("doc_id", F.xxhash64("t")).sortWithinPartitions("doc_id", F.xxhash64("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, part, first = encoder(tokenizer, cache_size), TaskContext.get().partitionId(), 0
        for batch in batches:
            for start, stop in steps(batch.column("t")):
                rows = batch.slice(start, stop - start)
                ids, ends = codec.encode(rows.column("t"))
                ids = np.insert(ids, ends, end_id)
                ends = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                sizes = np.diff(ends)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(sizes), pa.array(first + ends[:-1]), pa.array(np.full(len(sizes), part, dtype=np.int32)), lists],
                    names=["doc_id", "n_tokens", "first", "part", "ids"],
                )
                first += int(ends[-1])

    rows = ordered.mapInArrow(encode, "doc_id long, n_tokens long, first long, part int, ids array<int>")
    orc_options = {
        "compression": "zstd",
        "orc.stripe.size": str(stripe_mb << 20),
        "orc.row.index.stride": "1000",
        "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    rows.write.options(**orc_options).orc(f"{path}/ids")
    # One row a part from the columns beside the ids; the window runs over parts, not documents.
    parts = spark.read.orc(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("n_docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.orc(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` as the files hold them."""
    rows = spark.read.schema("doc_id long, n_tokens long, first long, part int, ids array<int>").orc(f"{path}/ids")
    parts = spark.read.schema("part int, n long, n_docs long, base long").orc(f"{path}/manifest")
    # One row of two numbers a part, a task's worth of documents; beyond MOST_PARTS of them the two are joined by a shuffle.
    return rows.join(broadcast_if_small(parts.select("part", "base"), MOST_PARTS), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")


def digest(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows as :func:`read_tokens` gives them."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = np.ascontiguousarray(ids.values.to_numpy(), dtype="<u4"), ids.offsets.to_numpy()
            raw = memoryview(flat).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            counted = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), counted, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_rows(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write, read back and digest; ``path`` defaults to the shared folder."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return digest(read_tokens(spark, path))
