"""Where intermediate tables live, and how a frame's lineage is cut.

Intermediates go to the shared folder that the cluster names in
``spark.checkpoint.dir``; a lost executor then costs a re-read, not a re-run.
Where that setting is absent, a local master gets a folder of its own (tests,
one machine); on a cluster that would scatter a table over machines, so it is
an error.  Tables live until the driver ends, or until the :func:`released`
block that wrote them does.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: The folders written in each open block of :func:`released` of this thread or task, innermost last.
_BLOCKS: ContextVar[tuple[list[str], ...]] = ContextVar("blocks", default=())
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
PLANNED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; one of our own only if none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="namelattice-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path nothing else uses, dropped when the block of :func:`released` around it ends (that block's own block with ``keep``), or the driver."""
    path = f"{shared_dir(spark)}/namelattice-{uuid.uuid4().hex[:12]}/{name}"
    atexit.register(discard, spark, os.path.dirname(path))
    blocks = _BLOCKS.get()
    blocks = blocks[: len(blocks) - keep]
    if blocks:
        blocks[-1].append(os.path.dirname(path))
    return path


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Drop the tables written inside this block when it ends; nothing made in it may be read later but what was stored with ``keep``."""
    block: list[str] = []
    token = _BLOCKS.set((*_BLOCKS.get(), block))
    try:
        yield
    finally:
        _BLOCKS.reset(token)
        for path in block:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that no later read needs; through Hadoop, as the folder may be remote."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already; the cluster's own clean-up has the folder then
        pass


def stored(df: DataFrame, name: str, fmt: str = "parquet", keep: bool = False, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the frame that reads it back; ``keep`` as for :func:`fresh_path`."""
    spark = df.sparkSession
    path = fresh_path(spark, name, keep)
    df.write.format(fmt).options(**options).save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)


def measured_broadcasts(spark: SparkSession) -> None:
    """Let joins of this session broadcast a side by the size of its rows as they were shuffled, under the limit that held for planned sizes.

    A planned size is that of the files, and names, digests and lists of tokens
    take 20 times less in Parquet than as rows, all of which pass through the driver.  Hints hold as before.
    """
    if spark.conf.get("spark.sql.adaptive.enabled") == "true" and spark.conf.get(MEASURED, None) is None:
        spark.conf.set(MEASURED, spark.conf.get(PLANNED))
        spark.conf.set(PLANNED, "-1")


def ship(spark: SparkSession) -> None:
    """Let Python workers of this session import the package, and hand them batches of a moderate size."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    # Batches of 64 MB, the built-in size, are held several times over on both sides of the pipe.
    if spark.conf.get(ARROW_BYTES) in ("67108864b", "64m", "67108864"):
        spark.conf.set(ARROW_BYTES, "16m")
