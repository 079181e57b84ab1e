"""Gap-free numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rows aimed at per bucket: what one task sorts.
BUCKET_ROWS = 1 << 20


def number_rows(df: DataFrame, order: list[str], out: str, group: list[str] | None = None,
                bucket: Column | None = None) -> DataFrame:
    """0-based position of each row within its group, ordered by (bucket, order).

    Rows are sorted bucket by bucket; only one count per bucket is summed across buckets, so a group
    holding most of the table is still spread over many tasks. `bucket` must hold a bounded number
    of rows and rise with the wanted order (an id divided by a width, or a random bucket when any
    fixed order will do).
    """
    group = list(group or [])
    if bucket is None:
        bucket = F.floor(F.col(order[0]) / F.lit(BUCKET_ROWS))
    keyed = df.withColumn("__bucket", bucket.cast("bigint"))
    offsets = (
        keyed.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(
            F.sum("__n").over(W.partitionBy(*group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0)))
        .drop("__n")
    )
    within = F.row_number().over(W.partitionBy(*group, "__bucket").orderBy(*order))
    numbered = keyed.withColumn("__within", within)
    # the offsets get names of their own: both sides stem from the same columns
    keys = [*group, "__bucket"]
    offsets = offsets.select(*[F.col(k).alias(f"__of_{i}") for i, k in enumerate(keys)], "__before")
    matched = [F.col(k).eqNullSafe(F.col(f"__of_{i}")) for i, k in enumerate(keys)]
    joined = numbered.join(offsets, matched, "inner")
    return joined.withColumn(out, F.col("__before") + F.col("__within") - F.lit(1)).drop(
        "__bucket", "__within", "__before", *[f"__of_{i}" for i in range(len(keys))])
