"""Cases that once went wrong: constructed hash collisions, very long roles, conversations and texts, repeated ids in samples."""

import time

import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, fitting, suffix_dedup, toxicity


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_constructed_collisions_are_told_apart(spark):
    """Polynomials modulo 2**64 take the same value on a Thue-Morse string and its complement, to any base."""
    head, tail = "common beginning " * 4, " and the same ending of both" * 3
    texts = [head + thue_morse(2048, "a", "b") + tail, head + thue_morse(2048, "b", "a") + tail]
    grams = [{t[i:i + 200] for i in range(len(t) - 199)} for t in texts]
    shared = grams[0] & grams[1]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(rows, with_text=True).collect()}
    for i, t in enumerate(texts):
        again = [k for k in range(len(t) - 199) if t[k:k + 200] in shared or t.count(t[k:k + 200]) > 1
                 or t.find(t[k:k + 200], k + 1) >= 0]
        gone = {p for k in again for p in range(k, k + 200)}
        assert found[i]["n_removed"] == len(gone)
        assert found[i]["kept"] == "".join(c for p, c in enumerate(t) if p not in gone)


def test_a_probed_pair_without_a_common_string_stays(spark):
    pair = [thue_morse(344, "a", "b"), thue_morse(344, "c", "d")]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")).collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in found] == [(344, 0, 0)] * 2


@pytest.mark.parametrize("size", [3_000, 1_000_000])
def test_long_roles_and_texts_are_read_back(spark, size):
    role, text = ("ro:le\\ " * size)[:size], ("### a: </turn>\n\\" * size)[:size]
    turns = spark.createDataFrame([(1, 0, role, text), (1, 1, "assistant", text), (2, 0, None, None)],
                                  "conv_id long, turn int, role string, text string")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert [tuple(t) for t in found[1]["turns"]] == [(role, text), ("assistant", text)] and found[1]["losses"] == [text]
    assert [tuple(t) for t in found[2]["turns"]] == [("", "")]


def test_a_conversation_of_very_many_turns_is_linear(spark):
    n = 100_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("x").alias("links"),
                                  F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.lit("hi").alias("text"))
    start = time.time()
    found = chat.read_back(chat.format_conversations(turns)).first()
    assert len(found["turns"]) == n and found["losses"] == ["hi"] * (n // 2)
    per_turn = [len(f"### {r}: hi </turn>\n") for r in ("user", "assistant")]
    assert found["formatted_chars"] == sum(sum(per_turn) * (k + 1) for k in range(n // 2))
    assert time.time() - start < 120


def test_every_example_is_written_out(spark):
    rows = [(1, 0, "user", "a#b"), (1, 1, "assistant", "one"), (1, 2, "user", "c"), (1, 3, "assistant", "two: </turn>"), (1, 4, "user", "rest"),
            (2, 0, "assistant", "only"), (2, 0, "assistant", "only")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    found = {(r["conv_id"], r["example"]): (r["prompt"], r["target"]) for r in chat.unfold(formatted).collect()}
    first = "### user: a\\#b </turn>\n"
    assert found[1, 0] == (first + "### assistant: ", "one </turn>\n")
    second = first + "### assistant: one </turn>\n### user: c </turn>\n### assistant: "
    assert found[1, 1] == (second, "two\\: \\</turn> </turn>\n")
    assert found[1, 2][1] == "" and found[1, 2][0].endswith("### user: rest </turn>\n")
    assert found[2, 0][1] == "only </turn>\n" and found[2, 1] == ("### assistant: only </turn>\n### assistant: ", "only </turn>\n")


@pytest.mark.parametrize("ids", [1, 10, None])
def test_samples_are_bounded_whatever_ids_repeat(spark, ids):
    rows = spark.range(20_000).select(
        (F.lit(None).cast("long") if ids is None else F.col("id") % ids + 32).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"),
        F.lit("en").alias("lang"))
    found = fitting.bounded_sample(rows, "lang", 400)
    assert len(found) == 400 == len({t for _, t in found}) and found == fitting.bounded_sample(rows.repartition(5), "lang", 400)
    if ids:
        labels = rows.select("doc_id", F.lit(1).alias("label")).distinct()
        assert len(fitting.bounded_sample(labels, "label", 300, rows)) == 300


def test_copies_of_one_text_do_not_hide_a_label(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") < 29_950, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"),
                                      F.lit("en").alias("lang")).withColumnRenamed("id", "doc_id")
    assert len(fitting.bounded_sample(rows, "lang", 40)) == 40


def test_too_many_labels_are_an_error_and_rare_ones_are_left_out(spark):
    rare = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"),
                                   F.when(F.col("id") < 400, "en").otherwise(F.concat(F.lit("dirty"), "id")).alias("lang"))
    assert {v for v, _ in fitting.bounded_sample(rare, "lang", 50)} == {"en"}
    with pytest.raises(ValueError):
        fitting.bounded_sample(rare.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 70)), "lang", 50)
    assert fitting.bounded_sample(rare.limit(0), "lang", 50) == []


def test_exception_phrases_in_one_sweep():
    lexicon = toxicity.Lexicon({"bad": 2.0, "worse": 1.0}, ["not bad", "bad luck charm"])
    machine = lexicon.automaton()
    text = "bad not bad worse bad luck charm, bad luck"
    assert toxicity.matches(machine, text)[:2] == (5.0, 3)
    start = time.time()
    assert toxicity.matches(machine, "not bad bad " * 40_000)[1] == 40_000
    assert time.time() - start < 10
