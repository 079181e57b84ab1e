"""Spark session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession


Item = TypeVar("Item")
Result = TypeVar("Result")

# Jobs of different tables submitted at the same time.
CONCURRENT_JOBS = 8


def each(items: Iterable[Item], work: Callable[[Item], Result]) -> list[Result]:
    """Results of `work` in order; the jobs of several items share the cluster instead of queueing."""
    items = list(items)
    if len(items) < 2:
        return [work(item) for item in items]
    with ThreadPoolExecutor(min(CONCURRENT_JOBS, len(items))) as pool:
        return list(pool.map(work, items))


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE, skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call-site capture for every column expression costs more than planning on wide tables
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Bytes of a batch of rows that need no watching.
NARROW_BYTES = 64 << 20
_BATCH_BYTES, _BATCH_ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def narrow_rows(spark: SparkSession, width: int) -> Iterator[None]:
    """Within, jobs of this thread end Arrow batches by their number of rows alone, where rows of at most `width` bytes stay small so.

    Spark otherwise adds up the bytes of the batch at every row, which costs several times as much as writing the row. A limit that the
    session sets itself stays in force.
    """
    context, rows = spark.sparkContext, int(spark.conf.get(_BATCH_ROWS))
    if not 0 < rows * max(width, 1) <= NARROW_BYTES:
        yield
        return
    before = context.getLocalProperty(_BATCH_BYTES)
    context.setLocalProperty(_BATCH_BYTES, str(2 ** 31 - 1))
    try:
        yield
    finally:
        context.setLocalProperty(_BATCH_BYTES, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local master may fall back to a temporary folder; on a cluster a missing setting is an
    error, since a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="plumbline-")
    context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: lineage ends at the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/plumbline/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
