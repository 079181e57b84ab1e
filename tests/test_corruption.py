"""Corruption operators and rounds: counts, bounds and repeatability."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import corruption as ops
from plumbline.operators.detection import Context, detect
from plumbline.operators.profile_store import read_profiles
from plumbline.plans import corruption_round as rounds
from plumbline.plans.closed_loop import run_experiment
from plumbline.plans.profile_dataset import profile_dataset


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(1)
    rows = [(i, f"p{i:04d}", rng.choice("abc"), round(rng.gauss(50, 10), 2), rng.randint(1, 9), i % 40) for i in range(1000)]
    return spark.createDataFrame(rows, "row_id long, code string, label string, size double, grade int, team int")


def test_insert_null(people):
    out = ops.insert_null(people, "size", 0.3, "s")
    assert out.filter("hit").count() == out.filter("size IS NULL").count()
    assert 240 < out.filter("hit").count() < 360
    # the same rows whatever the partitioning
    again = ops.insert_null(people.repartition(5), "size", 0.3, "s")
    assert sorted(out.filter("hit").select("row_id").collect()) == sorted(again.filter("hit").select("row_id").collect())


def test_insert_column(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "A int")
    out = ops.insert_column(df, "A").drop("hit")
    assert out.columns == ["A", "NEW_A"] and [tuple(r) for r in out.collect()] == [(1, 1), (2, 2), (3, 3)]


def test_duplicate_rows(people):
    marked = people.withColumn("__hit_0", F.lit(True))
    out = ops.duplicate_rows(marked, 0.2, "s", earlier_hits=("__hit_0",))
    copies = out.filter("hit").count()
    assert out.count() == 1000 + copies and copies > 100
    assert out.drop("row_id", "hit", "__hit_0").distinct().count() == 1000
    assert out.select("row_id").distinct().count() == out.count()
    assert out.filter("__hit_0").count() == 1000
    ids = [r["row_id"] for r in ops.in_row_order(out).select("row_id").collect()]
    assert [i if i >= 0 else -1 - i for i in ids] == sorted(i if i >= 0 else -1 - i for i in ids)


def test_shift_stays_in_bounds_and_rounds_half_to_even(spark, people):
    out = ops.distribution_shift(people, "size", 25.0, "spread", None, 30.0, 70.0, 0.5, "s")
    assert out.filter("hit AND (size < 30 OR size > 70)").count() == 0 and out.filter("hit_clamped").count() > 0
    whole = spark.createDataFrame([(i, v) for i, v in enumerate([2, 3])], "row_id long, v int")
    moved = ops.distribution_shift(whole, "v", 0.5, "shift", 1, 0, 10, 1.0, "s", whole=True)
    assert [r["v"] for r in moved.orderBy("row_id").collect()] == [2, 4]


@pytest.mark.parametrize("column,whole", [("size", False), ("grade", True)])
def test_out_of_range(people, column, whole):
    out = ops.out_of_range(people, column, 1.0, 9.0, 4.0, "both", 0.3, "s", whole)
    hit = out.filter("hit")
    assert hit.count() > 200
    assert hit.filter(f"{column} >= 1 AND {column} <= 9").count() == 0
    assert hit.filter(f"hit_below AND {column} >= 1").count() == 0
    assert hit.filter(f"{column} < -3 OR {column} > 13").count() == 0


def test_correlation_break_keeps_values(people):
    before = sorted(r[0] for r in people.select("size").collect())
    for buckets in (None, 7):
        out = ops.correlation_break(people, "size", 0.6, "s", buckets=buckets)
        assert sorted(r[0] for r in out.select("size").collect()) == before
        joined = out.select("row_id", F.col("size").alias("new"), "hit").join(people, "row_id")
        assert joined.filter("NOT hit AND new <> size").count() == 0
        assert joined.filter("hit AND new <> size").count() > 400
    gaps = people.withColumn("size", F.when(F.col("grade") > 3, F.col("size")))
    nulls = gaps.filter("size IS NULL").count()
    assert ops.correlation_break(gaps, "size", 0.6, "s").filter("size IS NULL").count() == nulls


def test_duplicate_primary_key(people):
    out = ops.duplicate_primary_key(people, "code", 0.3, "s")
    keys = {r[0] for r in out.filter("NOT hit").select("code").collect()}
    assert out.count() == 1000 and out.filter("hit").count() > 200
    assert all(r[0] in keys for r in out.filter("hit").select("code").collect())
    everything = ops.duplicate_primary_key(people, "code", 1.1, "s")
    assert everything.filter("hit").count() == 0


def test_wrong_datatype(people):
    out = ops.wrong_datatype(people, "grade", "int", "str", 0.4, "s")
    hits = out.filter("hit")
    assert hits.filter("grade__type <> 'str'").count() == 0
    assert out.join(people.select("row_id", F.col("grade").cast("string").alias("old")), "row_id").filter("grade <> old").count() == 0
    dates = ops.wrong_datatype(people, "label", "str", "datetime", 0.4, "s").filter("hit").orderBy("row_id")
    found = [r["label"] for r in dates.collect()]
    assert found == sorted(found) and found[0] == "2000-01-01 00:00:00" and found[-1] == "2050-12-31 00:00:00"
    for new, pattern in (("float", r"^0\.[0-9]{5}$|^1\.00000$"), ("bool", "^[01]$"), ("int", "^[0-9]{1,3}$")):
        changed = ops.wrong_datatype(people, "label", "str", new, 0.4, "s").filter("hit")
        assert changed.filter(~F.col("label").rlike(pattern)).count() == 0


@pytest.mark.parametrize("values,kind", [
    (list(range(0, 1500)), "bigint"), ([-3, -25, -7, 0, 9], "int"), ([1.5, 2.0, -30.25], "double"),
    (["a", "b", "ab", "ba", "ABC-1", ""], "string"), ([2 ** 63 - 2, 10], "bigint"),
])
def test_orphan_keys_are_new(spark, values, kind):
    parents = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    found = ops.orphan_key_map(parents, parents, "s").collect()
    assert len(found) == len(set(values))
    assert all(r["new_key"] is not None and r["new_key"] not in values for r in found)
    assert sorted(found) == sorted(ops.orphan_key_map(parents.repartition(3), parents, "s").collect())


def test_orphan_keys_where_all_candidates_exist(spark):
    # every text of one or two digits exists, and the candidates of "1" are added as parents
    child = spark.createDataFrame([("1",)], "k string")
    known = [str(i) for i in range(100)]
    while True:
        parents = spark.createDataFrame([(k,) for k in known], "k string")
        new = ops.orphan_key_map(child, parents, "s").first()["new_key"]
        assert new not in known
        if len(known) > 108:
            break
        known.append(new)


def test_orphan_foreign_key_keeps_equal_keys_equal(spark, people):
    parents = spark.range(40).select(F.col("id").cast("int").alias("id"))
    out = ops.orphan_foreign_key(people, "team", parents, 0.5, "s")
    joined = out.select("row_id", F.col("team").alias("new"), "hit").join(people, "row_id").filter("hit")
    assert joined.filter("new BETWEEN 0 AND 39").count() == 0
    assert joined.groupBy("team").agg(F.countDistinct("new").alias("n")).filter("n > 1").count() == 0
    assert out.count() == 1000


@pytest.fixture(scope="module")
def dataset(spark, people):
    teams = spark.createDataFrame([(i, f"team{i}", 100.0 + i) for i in range(40)], "team_id int, team_name string, budget double")
    teams = teams.withColumn("row_id", F.col("team_id").cast("long"))
    linked = people.withColumn("twice", F.col("size") * 2 + F.col("grade"))
    clean, test = linked.filter("pmod(xxhash64(row_id), 5) > 0"), linked.filter("pmod(xxhash64(row_id), 5) = 0")
    clean = {"people": clean, "teams": teams}
    test = {"people": test, "teams": teams.limit(0)}
    return clean, test, read_profiles(profile_dataset(clean, test, clusters=False, key="row_id"))


def test_round_is_repeatable_and_hits_a_column_once(dataset):
    clean, test, profiles = dataset
    once = rounds.run_round(3, clean, test, profiles, tables=["people"], anomalies=list(rounds.ANOMALIES))
    again = rounds.run_round(3, clean, test, profiles, tables=["people"], anomalies=list(rounds.ANOMALIES))
    assert [r[:9] for r in once.injections] == [r[:9] for r in again.injections] and len(once.injections) >= 5
    columns = [r[3] for r in once.injections if r[3]]
    assert len(columns) == len(set(columns))
    assert not once.failures and [r[1] for r in once.injections] == list(range(1, len(once.injections) + 1))
    assert not any(c.startswith("__hit_") for c in once.batch["people"].columns)


def test_failures_are_recorded(dataset, monkeypatch):
    clean, test, profiles = dataset

    def broken(*_):
        raise ValueError("cannot be built")

    monkeypatch.setitem(rounds.CHOOSERS, "insert_null", broken)
    done = rounds.run_round(1, clean, test, profiles, tables=["people"], anomalies=["insert_null", "duplicate_rows"])
    assert done.failures[0][1:4] == ("people", "insert_null", "ValueError: cannot be built")
    assert [r[4] for r in done.injections] == ["duplicate_rows"]


def test_choices_cover_none_to_all():
    rng = random.Random(0)
    sizes = {len(rounds.choose_tables(["a", "b", "c"], rng)) for _ in range(100)}
    errors = {len(rounds.choose_anomalies(rng)) for _ in range(200)}
    assert sizes == {0, 1, 2, 3} and errors == set(range(6))


@pytest.mark.parametrize("anomaly", rounds.ANOMALIES)
def test_closed_loop_finds_each_anomaly(spark, dataset, anomaly, monkeypatch):
    clean, test, profiles = dataset
    # strong settings, so that 200 rows are enough to see the change
    monkeypatch.setattr(random.Random, "random", lambda self: 0.5)
    monkeypatch.setattr(rounds, "SHIFTS_IN_STD", (2.0,))
    for run in range(1, 4):
        done, findings, scores = run_experiment(run, clean, test, profiles, tables=["people"], anomalies=[anomaly])
        if not done.injections:
            continue
        table, column = done.injections[0][2:4]
        found = findings.filter(F.col("anomaly") == anomaly).collect()
        # text or number written into a text column changes nothing a detector could tell without its type
        assert [r for r in found if r["table"] == table and r["column"] in ("", column)], (done.injections, found)
        assert scores.first()["matched"] >= 1
        return
    pytest.skip("no row was hit")


def test_clean_batch_gives_no_finding(dataset):
    clean, test, profiles = dataset
    assert detect(test["people"], profiles["people"], Context(clean, test)).collect() == []


def test_empty_batch(dataset):
    clean, test, profiles = dataset
    assert detect(test["people"].limit(0), profiles["people"], Context(clean, test)).collect() == []
