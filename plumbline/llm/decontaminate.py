"""Benchmark items found in documents by SimHash of item-sized windows, in DataFrame functions only.

1. Windows: word n-grams that a document shares with an item say where the item would begin; the window has the
   item's number of words (or the whole document's). A window without any n-gram of an item cannot be similar to one.
2. Fingerprints: 64-bit SimHash over the window's words, each as often as it occurs.
3. Multi-index: a fingerprint is BLOCKS blocks. Of two that differ in at most RADIUS = 2 * BLOCKS - 1 bits, some block differs in
   one bit at most, so items are indexed under each block and all its one-bit neighbours and no pair within the radius is missed.
4. Candidates within the radius are verified by the exact weighted Jaccard similarity of word n-grams, weights being counts.

The benchmark is broadcast only while its n-grams are at most BROADCAST_ROWS; beyond, the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.session import materialize

from .common import WORD

BLOCKS, BITS = 8, 8
RADIUS = 2 * BLOCKS - 1
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def ngram_hashes(column: str, width: int) -> Column:
    """Hashes of a word array's n-grams in order; fewer words are one n-gram, no words none."""
    parts = ", ".join(f"{column}[i + {k}]" for k in range(width))
    return F.expr(f"""CASE WHEN size({column}) >= {width}
        THEN transform(sequence(0, size({column}) - {width}), i -> xxhash64({parts}))
        WHEN size({column}) > 0 THEN array(xxhash64(array_join({column}, ' '), 0)) ELSE array() END""")


def simhash(column: str) -> Column:
    """Bit b is set where more than half of the words' hashes have it set."""
    h = F.transform(F.col(column), lambda w: F.xxhash64(F.lit(3), w))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(
        F.when(2 * F.aggregate(h, F.lit(0).cast("long"), lambda n, x: n + F.call_function(
            "shiftrightunsigned", x, b).bitwiseAND(F.lit(1).cast("long"))) > F.size(h),
            F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def _block(fingerprint: str, k: str) -> str:
    return f"int(shiftrightunsigned({fingerprint}, {BITS} * {k}) & {(1 << BITS) - 1}L)"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, start, n_words) for each document and item that it holds nearly whole.

    `start` is the first word of the most similar window (the first of equal ones). Null, empty and blank documents and items match
    nothing. Rows that repeat a doc_id with another text are documents of their own, told apart by the text's hash; equal rows
    are one. Equal items all match. Other columns are ignored; empty tables give an empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(
        "text IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), words(F.col(item_text)).alias("w")).distinct().where("size(w) > 0")
    items = materialize(items.select("item_id", "w", F.size("w").alias("n_words"), ngram_hashes("w", width).alias("grams"),
                                     simhash("w").alias("print")), "leaks-items")
    places = items.select("n_words", F.posexplode("grams").alias("offset", "gram")).distinct()
    n_places = places.count()

    # every n-gram of every document, each document's text read once and not carried along; the outer form keeps the optimizer
    # from testing the size of the array by a filter that would compute it anew for each element
    grams = docs.select("doc_id", "text_hash", words(F.col("text")).alias("w")).select(
        "doc_id", "text_hash", F.size("w").alias("n"), ngram_hashes("w", width).alias("grams"))
    hits = grams.select("doc_id", "text_hash", "n", F.posexplode_outer("grams").alias("at", "gram")).join(
        _small(places, n_places), "gram")
    starts = hits.select("doc_id", "text_hash", "n_words", F.greatest(F.lit(0), F.least(
        F.col("at") - F.col("offset"), F.col("n") - F.col("n_words"))).alias("start")).distinct()
    per_doc = materialize(starts.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n_words")).alias("spots")),
                          "leaks-starts")

    some = docs.join(_small(per_doc.select("text_hash").distinct(), per_doc.count()), "text_hash", "left_semi").select(
        "doc_id", "text_hash", words(F.col("text")).alias("w")).dropDuplicates(["doc_id", "text_hash"])
    windows = some.join(per_doc.withColumnRenamed("doc_id", "of"), (F.col("doc_id").eqNullSafe(F.col("of"))) & (
        some["text_hash"] == per_doc["text_hash"])).select(
        "doc_id", some["text_hash"], "w", F.explode("spots").alias("spot")).select(
        "doc_id", "text_hash", F.col("spot.start").alias("start"), F.col("spot.n_words").alias("n_words"),
        F.expr("slice(w, spot.start + 1, spot.n_words)").alias("v"))
    windows = materialize(windows.select("doc_id", "text_hash", "start", "n_words", ngram_hashes("v", width).alias("found"),
                                         simhash("v").alias("seen")), "leaks-windows")

    index = items.select("item_id", "n_words", "grams", "print", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    index = index.select("item_id", "n_words", "grams", "print", "block", F.explode(F.expr(
        f"concat(array({_block('print', 'block')}), transform(sequence(0, {BITS - 1}), b -> "
        f"{_block('print', 'block')} ^ shiftleft(1, b)))")).alias("value"))
    blocks = windows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn(
        "value", F.expr(_block("seen", "block")))
    near = blocks.join(_small(index, n_places), ["n_words", "block", "value"]).where(f"bit_count(print ^ seen) <= {RADIUS}")
    # a pair within the radius meets in several blocks: it is verified in the first
    first = F.expr(f"array_position(transform(sequence(0, {BLOCKS - 1}), k -> bit_count({_block('print', 'k')} ^ "
                   f"{_block('seen', 'k')}) <= 1), true) - 1")
    near = near.where(F.col("block") == first)
    both = F.expr("""aggregate(array_distinct(grams), 0, (n, g) -> n + least(size(filter(grams, x -> x = g)),
        size(filter(found, x -> x = g))))""")
    near = near.withColumn("both", both).withColumn("either", F.size("grams") + F.size("found") - F.col("both"))
    near = near.where(100 * F.col("both") >= percent * F.col("either"))
    best = F.max(F.struct((F.col("both") / F.col("either")).alias("similarity"), (-F.col("start")).alias("start")))
    return near.groupBy("doc_id", "text_hash", "item_id", "n_words").agg(best.alias("best")).select(
        "doc_id", "text_hash", "item_id", "best.similarity", (-F.col("best.start")).alias("start"), "n_words")
