"""Reading tables, cutting lineage and connected components for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.session import materialize

#: A word: anything but space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, after the session's Arrow batches are held to BATCH_ROWS rows: whole texts are handed to Python in batches, and two
    workers share what an executor has beside its heap."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def per_batch(work: Callable[[dict[str, pa.Array]], dict[str, object]], schema: pa.Schema):
    """A function for mapInArrow: columns of a batch by name in, columns of the result out. Strings arrive as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(dict(zip(batch.schema.names, batch.columns)))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema for x in [out[f.name]]],
                    schema=schema)

    return run


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for each node of `edges` (a, b): the smallest node that its links reach.

    Every round hooks each node to its smallest neighbour, halves the paths and contracts the edges, so the edge table
    shrinks at least by half per round. Rounds are written to the shared folder; only a count reaches the driver.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .distinct(), f"{label}-edges")
    roots = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up"))
        hop = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = materialize(up.join(hop, "up").select("node", "up", "top"), f"{label}-up")
        if roots is None:
            roots = up.select("node", F.col("top").alias("root"))
        else:
            step = up.select(F.col("node").alias("root"), F.col("top").alias("next"))
            roots = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        roots = materialize(roots, f"{label}-roots")
        to_a = up.select(F.col("node").alias("a"), F.col("top").alias("x"))
        to_b = up.select(F.col("node").alias("b"), F.col("top").alias("y"))
        moved = edges.join(to_a, "a").join(to_b, "b").select("x", "y")
        # a path longer than two hops: its node has moved to a top that itself moves on
        on = up.where("node = up").select(F.col("node").alias("top"), F.lit(True).alias("still"))
        further = up.join(on, "top", "left").where("still IS NULL").select(
            F.col("top").alias("x")).distinct().join(up.select(F.col("node").alias("x"), F.col("top").alias("y")), "x")
        edges = materialize(moved.unionByName(further).where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{label}-edges")
        if edges.isEmpty():
            return roots
