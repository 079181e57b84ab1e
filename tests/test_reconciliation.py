"""Matching against a plain loop, report parsing, costs and numbering."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.numbering import number_rows
from plumbline.operators import reconciliation as rec

LOG = "run_number int, id int, table string, column string, anomaly string, nb_rows_affected string"


def loop(first, second):
    """Items of `second` in the order the first log claims them."""
    taken = {}
    for a in first:
        for b in second:
            fits = a[2] == b[2] and a[4] == b[4] and (a[3] == b[3] or "" in (a[3], b[3])) and a[0] == b[0]
            if fits and (b[0], b[1]) not in taken:
                taken[(b[0], b[1])] = (b[0], a[1], b[1], a[5] == b[5])
    return sorted(taken.values())


def random_log(rng, size):
    return [(rng.randint(1, 2), i + 1, rng.choice("ab"), rng.choice(["", "x", "y"]), rng.choice("pq"), rng.choice("12"))
            for i in range(size)]


@pytest.mark.parametrize("seed", range(6))
def test_matches_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    first, second = random_log(rng, rng.randint(1, 25)), random_log(rng, rng.randint(1, 25))
    found = rec.matches(spark.createDataFrame(first, LOG), spark.createDataFrame(second, LOG))
    assert sorted(tuple(r) for r in found.collect()) == loop(first, second)


def test_first_claimant_and_strict(spark):
    injected = spark.createDataFrame([(1, 1, "t", "c", "a", "5")], LOG)
    found = spark.createDataFrame([(1, 1, "t", "c", "a", "5"), (1, 2, "t", "", "a", "6")], LOG)
    assert rec.matches(injected, found).count() == 2
    assert rec.strict_matches(injected, found).count() == 1
    row = rec.scores(injected, found).first()
    assert (row["matched"], row["false_positives"], row["not_found"]) == (2, 1, -1)


@pytest.mark.parametrize("seed", range(3))
def test_strict_is_one_to_one(spark, seed):
    rng = random.Random(seed)
    first, second = random_log(rng, 30), random_log(rng, 30)
    found = rec.strict_matches(spark.createDataFrame(first, LOG), spark.createDataFrame(second, LOG)).collect()
    assert len({(r[0], r[1]) for r in found}) == len(found) == len({(r[0], r[2]) for r in found})
    a, b = {(r[0], r[1]): r for r in first}, {(r[0], r[1]): r for r in second}
    for r in found:
        x, y = a[(r[0], r[1])], b[(r[0], r[2])]
        assert x[2] == y[2] and x[4] == y[4] and (x[3] == y[3] or "" in (x[3], y[3]))


def test_runs_without_matches_are_scored(spark):
    injected = spark.createDataFrame([(1, 1, "t", "c", "a", "5"), (2, 1, "t", "c", "a", "5")], LOG)
    found = spark.createDataFrame([(3, 1, "u", "", "a", "5")], LOG)
    rows = {r[0]: tuple(r)[1:] for r in rec.scores(injected, found).collect()}
    assert rows == {1: (0, 0, 1), 2: (0, 0, 1), 3: (0, 1, 0)}


def test_reports(spark):
    text = ("Intro\n### **OUTPUT**\nT_new_data | c | insert_null | 0 | 10 | 14 | Critical \n"
            "short | line\nU |  | duplicate_rows | 0 | 2 | 3 | High\n\n### **FEEDBACK**\n  more tools \n\nsecond\n")
    reports = spark.createDataFrame([(4, 1, text), (4, 2, "nothing here"), (4, 3, "**OUTPUT**\nV|d|x|1|2|3|Low")],
                                    "run_number int, report long, text string")
    rows = rec.with_ids(rec.parse_reports(reports)).orderBy("id").collect()
    assert [(r["id"], r["table"], r["column"], r["nb_rows_affected"], r["severity"]) for r in rows] == [
        (1, "T", "c", "14", "Critical"), (2, "U", "", "3", "High"), (3, "V", "d", "3", "Low")]
    assert [r["line"] for r in rec.rejected_lines(reports).collect()] == ["short | line"]
    assert [r["line"] for r in rec.feedback_lines(reports).orderBy("line_no").collect()] == ["more tools", "second"]


def test_cost(spark):
    usage = spark.createDataFrame([("tier_1", 1_000_000, 200_000, 500_000, 80_000), ("unknown", 1, 1, 1, 1)],
                                  "model string, total_input_tokens long, total_output_tokens long, "
                                  "total_cache_read long, total_cache_written long")
    rows = {r["model"]: r["total_cost_usd"] for r in rec.usage_cost(usage).collect()}
    assert rows == {"tier_1": 2.15, "unknown": None}


def test_numbering_is_gap_free_in_large_groups(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("g"),
                                  (F.col("id") * 3).alias("id"))
    numbered = number_rows(df, ["id"], "n", ["g"], bucket=F.floor(F.col("id") / 100))
    for g, size in (("hot", 2500), ("cold", 500)):
        rows = [tuple(r) for r in numbered.filter(F.col("g") == g).orderBy("id").select("id", "n").collect()]
        assert [n for _, n in rows] == list(range(size))
