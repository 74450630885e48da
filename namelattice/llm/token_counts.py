"""Token counts by a two-tier lookup on the map side; no shuffle of pre-tokens.

Tier one is a broadcast table of the token lengths of frequent pieces, its
size fixed by ``table_size``; it sets speed only, so it is counted on about ``sample_docs``
whole texts, drawn by the hash of id and text, in ``SAMPLE_TASKS`` tasks whose bounded
counters the driver adds up.  Tier two encodes what the table lacks and keeps it in the
worker's cache.  Nothing leaves a counting task but one row for each document.

Null texts count as empty (0 bytes, 0 tokens); null ids and repeated rows each
give a row; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..storage import ship
from .tokens import encoder, steps


#: Texts, about, that frequent pieces are counted on, and tasks that count them.
SAMPLE_DOCS, SAMPLE_TASKS = 10_000, 8
#: Bytes of the longest piece that the table takes, so that its size is bounded.
LONGEST = 256


def _most_frequent(counted: pa.Table, size: int) -> pa.Table:
    """The ``size`` most frequent pieces of ``counted(piece, n)``, counts of one piece being added up."""
    summed = counted.group_by("piece").aggregate([("n", "sum")]).rename_columns(["piece", "n"])
    return summed.take(pc.sort_indices(summed, [("n", "descending"), ("piece", "ascending")])[:size]).combine_chunks()


def frequent_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", table_size: int = 20_000, sample_docs: int = SAMPLE_DOCS) -> dict[bytes, int]:
    """The most frequent pieces of a sample of texts and their token lengths.

    Only sampled texts are dealt anew.  A task holds the counts of ``16 * table_size`` pieces
    and those of one step of text at most, and hands on ``2 * table_size``.
    """
    share = sample_docs / max(1, docs.count())
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t")).where("t is not null")
    sample = narrow.where(F.xxhash64("id", "t") / F.lit(2.0**64) + 0.5 < share).select("t").repartition(SAMPLE_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"piece": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        for batch in batches:
            for start, stop in steps(batch.column("t")):
                found = pc.ascii_split_whitespace(batch.column("t").slice(start, stop - start)).flatten().value_counts()
                part = pa.table({"piece": found.field("values").cast(pa.string()), "n": found.field("counts")})
                sizes = pc.binary_length(part.column("piece"))
                held = pa.concat_tables([held, part.filter(pc.and_(pc.greater(sizes, 0), pc.less_equal(sizes, LONGEST)))])
                if held.num_rows > 16 * table_size:
                    held = _most_frequent(held, 4 * table_size)
        yield from _most_frequent(held, 2 * table_size).to_batches()

    pieces = _most_frequent(sample.mapInArrow(count, "piece string, n long").toArrow(), table_size).column("piece")
    lengths = encoder(tokenizer).counts(pieces.combine_chunks())
    return dict(zip((piece.encode() for piece in pieces.to_pylist()), lengths.tolist()))


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", table_size: int = 20_000, cache_size: int = 1_000_000) -> DataFrame:
    """``(id_col, n_bytes, n_tokens)`` of every whole text."""
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer, id_col, text, table_size))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer, cache_size)
        for batch in batches:
            for start, stop in steps(batch.column("t")):
                rows = batch.slice(start, stop - start)
                sizes = pc.fill_null(pc.binary_length(rows.column("t")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("id"), sizes, pa.array(codec.counts(rows.column("t"), table.value))], names=["id", "n_bytes", "n_tokens"])

    return narrow.mapInArrow(count, f"id {dict(narrow.dtypes)['id']}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
