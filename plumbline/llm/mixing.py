"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every source gets a target number of words: its weight's share of the budget, at most `most` times its own size, with the
excess shared out again by weight. Whole copies of a source (epochs) come first; what is left of the target is filled by
documents in the order of exponential keys -ln(u) / quality, u drawn from the document's id, until the sum is nearest
to the target.

The order within a source is a prefix sum, so a source with a third of all rows would be one window in one task. Instead keys
are cut into buckets of a bounded number of rows: sums per bucket are added up over the few buckets, and only the order within
a bucket is a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.session import materialize

from .common import WORD

#: Rows that a bucket of keys holds on average.
BUCKET_ROWS = 2_000


def word_count(text: Column) -> Column:
    """Words of a text; null has none. Counted by removing all but each word's first character."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A quality weight in [0.5, 1.5]: 0.5 plus the share of letters and spaces in the text."""
    other = F.coalesce(F.regexp_count(text, F.lit(r"[^\p{L}\s]")), F.lit(0))
    return F.lit(1.5) - other / F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1))


def uniform(seed: int, key: Column) -> Column:
    """A draw in (0, 1) from 48 bits of a hash of the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources by code point, null last, take the weights in turn. A source is held at its limit when the limit per weight is
    no more than what the sources not yet held can still get per weight; in the order of limit per weight those are
    the first ones, so one running sum tells who is held.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighted = sizes.withColumn("turn", turn).withColumn(
        "weight", F.array(*[F.lit(float(w)) for w in weights])[F.col("turn")]).withColumn(
        "limit", F.col("source_size") * float(most))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = weighted.withColumn("budget", F.sum("source_size").over(everything) * float(share)).withColumn(
        "left", F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn(
        "weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).withColumn(
        "held", F.col("limit") * F.col("weights") <= F.col("left") * F.col("weight"))
    free = F.min(F.when(~F.col("held"), F.struct(
        (F.col("limit") / F.col("weight")).alias("at"), F.col("left"), F.col("weights")))).over(everything)
    return level.withColumn("free", free).select(
        "source", "source_size", F.when(F.col("held"), F.col("limit")).otherwise(
            F.col("free.left") * F.col("weight") / F.col("free.weights")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row: words of the document, of its source, the source's target
    and the words the mix takes of the document, repeats counted.

    A null text has the size 0 and takes 0; a null source is a source of its own, after all others. Rows that repeat a doc_id
    are rows of their own; rows with equal keys are ordered by doc_id and size, and equal ones are interchangeable. A
    source without words has the target 0. Other columns are ignored; an empty table gives an empty result.
    """
    key = F.col(doc_id)
    rows = docs.select(key.alias("doc_id"), F.col(source).cast("string").alias("source"),
                       word_count(F.col(text)).alias("size"), quality(F.col(text)).alias("quality"))
    rows = materialize(rows.select("doc_id", "source", "size", (-F.log(uniform(
        seed, F.col("doc_id"))) / F.col("quality")).alias("key")), "mix-rows")

    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    aims = targets(sums.select("source", "source_size"), weights, share, most).join(
        sums.select(F.col("source").alias("s"), "source_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size"))).otherwise(F.lit(0))).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    # 1 - exp(-key) grows with the key and spreads the keys about evenly over (0, 1), so its thirds, hundredths and
    # so on are consecutive stretches of the order with about equally many rows
    aim = aims.select(F.col("source").alias("of"), "source_size", "target", "epochs", "rest", F.ceil(
        F.col("source_rows") / BUCKET_ROWS).alias("buckets"))
    placed = rows.join(aim, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn(
        "bucket", F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")).cast("long"))
    per_bucket = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    offsets = per_bucket.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("words").over(
        Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))

    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    reached = placed.withColumn("upto", F.sum("size").over(within)).join(
        offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).withColumn(
        "upto", F.col("upto") + F.col("offset"))
    # the document that crosses the target is taken if that ends nearer to it
    chosen = F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size"))
    return reached.select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * (F.col("epochs") + F.when(chosen, 1).otherwise(0))).cast("long").alias("taken"))
