"""Steps whose work must spread over tasks and grow with the input: plans, widths and results."""

import io
from contextlib import redirect_stdout
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import session
from plumbline.functions import percentiles
from plumbline.functions.percentiles import Span, ordered, values_at_ranks
from plumbline.operators import association, clusters, corruption, keys, numeric_profile
from plumbline.operators import table_profile as tp
from plumbline.plans import registered
from plumbline.plans.profile_dataset import profile_dataset


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_donors_are_numbered_in_their_order_whatever_the_buckets(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").alias("row_id"), ((F.col("id") * 7919) % 1009).alias("k"))
    whole = {tuple(r) for r in corruption.duplicate_primary_key(df, "k", 0.3, "s").collect()}
    monkeypatch.setattr(corruption, "BUCKET_ROWS", 40)
    assert {tuple(r) for r in corruption.duplicate_primary_key(df, "k", 0.3, "s").collect()} == whole


def test_candidates_of_orphan_keys_are_made_by_many_tasks(spark, monkeypatch):
    seen, make = [], corruption._candidates
    monkeypatch.setattr(corruption, "KEYS_PER_TASK", 100, raising=False)
    monkeypatch.setattr(corruption, "_candidates", lambda k, *rest: seen.append(k.rdd.getNumPartitions()) or make(k, *rest))
    found = corruption.orphan_key_map(spark.range(1000).toDF("k"), spark.range(1000).toDF("p"), "s").collect()
    assert seen == [10]
    assert len(found) == 1000 and all(r["new_key"] >= 1000 or r["new_key"] < 0 for r in found)


def test_no_aggregate_of_a_scan_is_wide(spark, monkeypatch):
    widths, counts = [], tp._type_counts
    monkeypatch.setattr(tp, "_type_counts", lambda df: widths.append(len(df.columns)) or counts(df))
    df = spark.range(50).select(*[(F.col("id") % (n + 2)).alias(f"c{n}") for n in range(11)], F.lit(None).cast("string").alias("t"))
    scan = tp.scan_columns(df)
    assert max(widths) <= 3
    assert list(scan.types) == df.columns and scan.rows == 50 and scan.values["t"] == 0
    assert scan.evidence["c0"].least == 2 and 2 < scan.evidence["c9"].least <= 11


def test_more_keys_than_a_word_has_bits(spark):
    parents = spark.createDataFrame([(n, n + 1) for n in range(70)], "parent int, parent_rank int")
    # key n holds the values up to n, column 100 those below 20
    counts = spark.createDataFrame([(n, 0, float(v), None, 1) for n in range(70) for v in range(n + 1)] + [
        (100, 0, float(v), None, 2) for v in range(20)], "attr int, family int, num double, txt string, cnt long")
    words = keys._holder_words(parents)
    found = keys._by_value(counts, parents, words).filter("attr = 100").join(F.broadcast(parents), keys._holds(words)).groupBy(
        "parent").agg(F.sum("cnt").alias("hits")).collect()
    assert len(words) == 2 and {r["parent"]: r["hits"] for r in found} == {n: 2 * min(n + 1, 20) for n in range(70)}


@pytest.mark.parametrize("of", ["cramers_v", "correlation_ratio"])
def test_tables_of_counts_are_made_once(spark, of):
    df = spark.range(300).select((F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 5).cast("string").alias("b"),
                                 (F.col("id") * 1.5).alias("x"))
    found = association.cramers_v("t", df, ["a", "b"]) if of == "cramers_v" else association.correlation_ratio("t", df, ["a", "b"], ["x"])
    assert "InArrow" not in plan_of(found)
    assert found.count() == (1 if of == "cramers_v" else 2)


def test_labels_are_counted_as_stored(spark):
    df = spark.createDataFrame([(0.0, True), (-0.0, None), (1.5, False), (None, True)], "f double, b boolean")
    found = tp.category_distribution({"t": df}, {"t": ["f", "b"]})
    # cells are read once for counts and shares
    assert plan_of(found).count("InArrow") == 1
    assert {(r["column_name"], r["category"]): (r["cnt"], round(r["share"], 4)) for r in found.collect()} == {
        ("f", "0.0"): (2, 0.6667), ("f", "1.5"): (1, 0.3333), ("b", "true"): (2, 0.6667), ("b", "false"): (1, 0.3333)}


def test_points_travel_in_blocks_and_go_to_the_first_nearest_centre(spark):
    points = spark.range(7000).select(F.lit(1.0).alias("weight"), (F.col("id") % 9).cast("double").alias("c0"),
                                      (F.col("id") % 4).cast("double").alias("c1")).coalesce(1)
    packed = clusters._packed(points)
    assert packed.count() <= 7000 // 1000
    centres = np.array(list(product([0.0, 4.0, 8.0], [1.0, 2.0])))
    x = np.random.default_rng(1).integers(0, 9, (2, 500)).astype(float)
    by_hand = ((x.T[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
    assert (clusters._labels(x, centres) == by_hand).all()
    sums = clusters._pass(packed, {6: centres}, 2)[6]
    assert sums.weight.sum() == 7000 and sums.sums[:, 0].sum() == sum(i % 9 for i in range(7000))


def test_rows_told_apart_by_a_key_are_not_fingerprinted(spark, monkeypatch):
    seen, fingerprint = [], tp.row_fingerprint
    monkeypatch.setattr(tp, "row_fingerprint", lambda df, *rest: seen.append(df.columns) or fingerprint(df, *rest))
    tables = {"keyed": spark.range(300).select("id", (F.col("id") % 3).alias("x")), "none": spark.range(0),
              "copies": spark.range(300).select((F.col("id") % 200).alias("y"))}
    found = profile_dataset(tables, numeric=False, parts={"profile_table"})["profile_table"].collect()
    assert seen == [["y"]]
    assert {r["table_name"]: tuple(r)[1:] for r in found} == {
        "copies": (300, 1, 100, 0.3333), "keyed": (300, 2, 0, 0.0), "none": (0, 1, 0, 0.0)}


@pytest.mark.parametrize("how", ["hash", "position"])
def test_sides_of_a_round_are_written_once(spark, monkeypatch, how):
    monkeypatch.setattr(registered, "TABLES", ("nation",))
    monkeypatch.setattr(registered, "profile_dataset", lambda *a, **k: {})
    clean, test, _ = registered._round_inputs(spark, "/root/testdata/sf0.001", how)
    for side in (clean["nation"], test["nation"]):
        assert "md5" not in plan_of(side) and "Join" not in plan_of(side)
    assert clean["nation"].union(test["nation"]).select("row_id").distinct().count() == 25


def test_frequent_values_are_counted_without_unfolding_rows(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("a"), F.when(F.col("id") < 300, 7.5).otherwise(F.col("id") * 1.0).alias("b"),
                                  F.col("id").alias("c"), F.lit(None).cast("int").alias("d"))
    found = numeric_profile.frequent_values(df, df.columns)
    assert "Generate" not in plan_of(found)
    assert {r["column_name"]: tuple(r)[1:] for r in found.collect()} == {"a": (0.0, 250, 0.25), "b": (7.5, 300, 0.3)}
    assert numeric_profile.frequent_values(df, ["c", "d"]).collect() == []


def test_passes_read_blocks_as_bytes_and_add_up_over_tasks(spark):
    points = spark.range(0, 25_003, 1, 3).select((F.col("id") % 3 + 1).cast("double").alias("weight"), F.sin("id").alias("c0"),
                                                 F.cos(F.col("id") * 7).alias("c1"))
    packed = clusters._packed(points)
    assert isinstance(packed.first(), bytes) and packed.getNumPartitions() == 3
    rows = np.array([tuple(r) for r in points.collect()])
    w, x = rows[:, 0], rows[:, 1:]
    fits = {k: np.random.default_rng(k).normal(size=(k, 2)) for k in (2, 3, 7)}
    for k, sums in clusters._pass(packed, fits, 2).items():
        label = ((x[:, None, :] - fits[k][None]) ** 2).sum(2).argmin(1)
        assert sums.weight.tolist() == np.bincount(label, w, k).tolist()
        assert np.allclose(sums.squares, np.bincount(label, w * (x * x).sum(1), k))
        assert np.allclose(sums.sums, np.stack([np.bincount(label, w * c, k) for c in x.T], axis=1))


def test_a_value_that_fills_a_range_ends_the_search(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(percentiles, "FEW_VALUES", 100)
    monkeypatch.setattr(percentiles, "_pass", lambda *a, own=percentiles._pass: passes.append(1) or own(*a))
    values = [-1e300, -0.3, 0.1, 7.7, 1e300]
    df = spark.range(5000).select(F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % 5 + 1).cast("int")).alias("x"))
    ranks = [0, 999, 1000, 2500, 3999, 4999]
    found = values_at_ranks(df, {"x": ordered(df, "x")}, {"x": ranks}, {"x": Span(-1e300, 1e300, 5000)})
    assert found["x"] == {r: sorted(values * 1000)[r] for r in ranks}
    assert len(passes) == 2


def test_bytes_of_narrow_rows_are_not_added_up(spark):
    context, limit = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    with session.narrow_rows(spark, 64):
        assert context.getLocalProperty(limit) == str(2 ** 31 - 1)
        with session.narrow_rows(spark, 1 << 20):
            assert spark.range(3).mapInArrow(lambda batches: batches, "id long").count() == 3
    assert context.getLocalProperty(limit) is None
    with session.narrow_rows(spark, 1 << 20):
        assert context.getLocalProperty(limit) is None
