"""The corpus pipeline: documents through five operators of plumbline.llm, one stage after the other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import decontaminate, mixing, ngram_jaccard, suffix_dedup, toxicity
from plumbline.llm.common import table
from plumbline.session import materialize, shared_dir

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents with at least this toxicity score are rejected.
TOXIC = 0.7
#: Up to so many ids of rejected documents are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def _without(docs: DataFrame, rejected: DataFrame, on) -> DataFrame:
    small = rejected.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(rejected) if small else rejected, on, "left_anti")


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of TOXIC or more go; those without text stay."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs.select(DOCUMENT_COLUMNS), lexicon, TOXIC)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones (five words, Jaccard 0.8) stays: one with the smallest id, null last.

    Rows that repeat a doc_id, or have none, are told apart by their text's hash; of rows that repeat both, the smallest by its
    other columns stays. Rows without words are in no group and stay.
    """
    found = ngram_jaccard.similar_components(docs, width=5, percent=80, with_first=True).select(
        F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"), "n_shingles", "first")
    rows = docs.select(DOCUMENT_COLUMNS)
    on = rows["doc_id"].eqNullSafe(F.col("of")) & (F.xxhash64(rows["text"]) == F.col("hash"))
    per_key = found.where("n_shingles > 0").groupBy("of", "hash").agg(F.min("first").alias("first"), F.count("*").alias("copies"))
    per_key = materialize(per_key.where("NOT first OR copies > 1"), "pipeline-keys")
    # keys that are not one row already: none of them stays here, and one row of each first one is added again
    alone = _without(rows, per_key.select("of", "hash"), on)
    repeated = per_key.where("first").select("of", "hash")
    n = repeated.count()
    if not n:
        return alone
    copies = rows.join(F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated, on, "left_semi")
    one = copies.groupBy("doc_id", F.xxhash64("text").alias("hash")).agg(F.min(F.struct(
        "text", "lang", "source", "n_chars")).alias("row"))
    return alone.unionByName(one.select("doc_id", "row.*").select(DOCUMENT_COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur twice are cut out of the texts; a document of which nothing is left goes."""
    found = suffix_dedup.remove_repeats(docs, with_text=True, carry=("lang", "source", F.col("text").isNull().alias("none")))
    found = found.where("n_removed = 0 OR kept <> ''")
    text = F.when(~F.col("none"), F.col("kept")).alias("text")
    return found.select("doc_id", text, "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(
        F.col("doc_id").alias("leaking"), F.col("text_hash").alias("hash")).distinct()
    on = docs["doc_id"].eqNullSafe(leaks["leaking"]) & (F.xxhash64(docs["text"]) == leaks["hash"])
    return _without(docs, leaks, on).select(DOCUMENT_COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", non_toxic),
    ("ngram_jaccard", one_of_similar),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("source_mix", mixed),
]

#: A fitted lexicon and SimHash fingerprints cannot be expressed in SQL; tests/llm compares the similar, repeated and mixed stages with
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/plumbline/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
