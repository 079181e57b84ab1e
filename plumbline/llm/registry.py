"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

import zlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (cap_filters, chat, collocations, decontaminate, language, licenses, mixing, ngram_jaccard, periodic, quality,
               suffix_dedup, token_index, toxicity)
from .common import table
from .fitting import remainder


def op1_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cap_filters.link_vectors(table(spark, sf_dir, "embeddings"), 0.9)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def _held_out(by: int, rest: int):
    return F.coalesce(remainder(F.col("doc_id"), by) == rest, F.lit(False)).alias("held_out")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    turns = turns.unionByName(spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")))
    found = chat.read_examples(chat.unfold(chat.format_conversations(turns)))
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.concat_ws("", "losses")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", spoken), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start", "n_words")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.summarize(docs, licenses.scan(docs, licenses.fit(docs)))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_token_index(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """`tokenizer` is the path of a tokenizer's JSON file on the driver; executors get its content."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents")
    store = token_index.write_store(docs, Path(tokenizer).read_text(encoding="utf-8"), end=2)
    return token_index.fetch(docs, store).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def looped_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, drawn by id, end in repetitions of some of their words."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents"), looped_tail)
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = periodic.strongest(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", told), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_cap_filters": op1_cap_filters,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_language_id": op3_language_id,
    "op4_quality_cnn": op4_quality_cnn,
    "op5_chat_examples": op5_chat_examples,
    "op6_decontaminate": op6_decontaminate,
    "op7_source_mix": op7_source_mix,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_token_index": op11_token_index,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}
