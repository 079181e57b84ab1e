"""Profile operators on small literal tables."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import as_double, is_date_text, nan_to_null, parse_datetime
from plumbline.functions import percentiles
from plumbline.functions.percentiles import Span, double_keys, interpolated, key_double, ordered, ranks_of, values_at_ranks
from plumbline.operators import association, keys, numeric_profile, value_sets
from plumbline.operators import table_profile as tp
from plumbline.operators.clusters import clusters
from plumbline.plans.profile_dataset import (
    load_profile, profile_columns, profile_dataset, profile_json, read_calibration, save_profile,
)


def column_rows(spark, **tables):
    found = profile_columns(tables).columns
    return {(r["table_name"], r["column_name"]): r for r in found.collect()}


def single(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"a {kind}")


def test_table_profile(spark):
    plain = spark.range(7).selectExpr("id", "concat('city', id) city", "id / 8 share")
    copies = spark.range(10).selectExpr("id % 6 AS shop", "id % 2 AS open")
    empty = spark.createDataFrame([], "A int")
    rows = {r["table_name"]: r for r in tp.table_profile({"plain": plain, "copies": copies, "empty": empty}).collect()}
    assert tuple(rows["plain"])[1:] == (7, 3, 0, 0.0)
    assert tuple(rows["copies"])[1:] == (10, 2, 4, 0.4)
    assert tuple(rows["empty"])[1:] == (0, 1, 0, 0.0)


def test_rows_with_nulls_are_duplicates_only_when_equal(spark):
    df = spark.createDataFrame([(None, "1"), ("1", None), (None, "1")], "a string, b string")
    assert tp.table_profile({"t": df}).first()["nb_duplicated_rows"] == 1


@pytest.mark.parametrize("values,kind,expected", [
    ([40, -7], "int", "int"), ([0.25, 8.0, -1.5, 3.0], "double", "float"), (["oslo", "riga"], "string", "str"),
    ([False, False], "boolean", "bool"), (["N", "N", "Y", "N"], "string", "bool"), ([1, 0], "int", "bool"),
    (["1999-02-28", "2024-02-29"], "string", "datetime"), (["Y", "Y", "No"], "string", "str"),
    ([0, 1, None], "int", "int"), ([1, 1], "bigint", "bool"), ([], "int", "bool"), ([[1]], "array<int>", None),
    ([None, None], "string", "str"),
])
def test_column_types(spark, values, kind, expected):
    assert tp.column_types({"t": single(spark, values, kind)}).first()["datatype"] == expected


@pytest.mark.parametrize("values,expected", [
    (["1987-11-30", "2004-02-29"], True), (["north-east", "south/west"], False), (["19871130", "20040229"], False),
    (["1987-11-30", "soon", "later", "2004-02-29", "2004-03-01"], False), ([" " * 80 + "2011-09-09", "2012-10-10"], True),
    (["13/04/2020", "01/02/2021"], True), (["4/13/2020 8:05", "1/2/2021 10:15:30"], True),
    (["3-Jan-2020", "14-Feb-2021"], True), (["Jan 5, 2020 8:15", "March 12, 2021 9:00"], True), ([None, None], False),
])
def test_date_strings(spark, values, expected):
    assert tp.date_text_share(single(spark, values, "string"), "a").first()["is_datetime"] is expected


def test_month_is_read_before_day(spark):
    df = single(spark, ["03/04/2020", "13/04/2020", "2020-05-06T07:08:09"], "string")
    found = [str(r[0]) for r in df.select(parse_datetime("a")).collect()]
    assert found == ["2020-03-04 00:00:00", "2020-04-13 00:00:00", "2020-05-06 07:08:09"]
    assert df.filter(~is_date_text("a")).count() == 0


def test_date_strings_are_cast_before_profiling(spark):
    dates = [f"2020-01-{d:02d}" for d in range(1, 29)] * 4 + ["n/a"]
    typed, columns, _, _ = profile_columns({"t": single(spark, dates, "string")})
    row = columns.first()
    assert (row["datatype"], row["null_values"], row["nb_unique"]) == ("datetime", True, 29)
    assert typed["t"].schema["a"].dataType.typeName() == "timestamp"


def test_categories(spark):
    df = single(spark, ["red"] * 5 + ["blue"] * 3 + ["grey"] * 2 + [None], "string")
    found = {r["category"]: r["share"] for r in tp.category_distribution({"t": df}, {"t": ["a"]}).collect()}
    assert found == {"red": 0.5, "blue": 0.3, "grey": 0.2}


@pytest.mark.parametrize("values,key,nulls", [
    (["k7", "k1", "k3", "k9"], True, False), (["k7", "k7"], False, False), (["k7", "k1", "k3", None], True, True),
    (["k7", None, None, None], False, True), ([], True, False),
])
def test_keys_and_nulls(spark, values, key, nulls):
    row = column_rows(spark, t=single(spark, values, "string"))[("t", "a")]
    assert (row["potential_primary_key"], row["null_values"]) == (key, nulls)


def test_long_strings_and_wide_numbers_stay_apart(spark):
    texts = ["x" * 200 + str(i) for i in range(5)] + ["x" * 2000] * 2
    row = column_rows(spark, t=single(spark, texts, "string"))[("t", "a")]
    assert row["nb_unique"] == 6
    wide = [2 ** 53, 2 ** 53 + 1, 2 ** 63 - 1, -2 ** 63, 5, 5]
    assert column_rows(spark, t=single(spark, wide, "bigint"))[("t", "a")]["nb_unique"] == 5


def test_nan_is_missing(spark):
    df = nan_to_null(single(spark, [1.0, float("nan"), 2.0], "double"))
    assert tp.null_profile({"t": df}).first()["nb_nulls"] == 1


def test_string_distribution(spark):
    df = spark.createDataFrame([("b", "u" * 90), ("a", "v" * 90), ("b", "u" * 90), ("a", "w"), ("c", None)],
                               "s string, t string")
    rows = {r["column_name"]: r for r in tp.string_distribution({"t": df}).collect()}
    assert tuple(rows["s"])[2:] == (5, 3, "a", 2)
    assert tuple(rows["t"])[2:] == (4, 3, "u" * 90, 2)


SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def percentiles_of(df, columns):
    values = {c: ordered(df, c) for c in columns}
    row = df.agg(*[a for c, v in values.items() for a in (F.min(v).alias(f"l{c}"), F.max(v).alias(f"h{c}"), F.count(v).alias(f"n{c}"))]).first()
    spans = {c: Span(row[f"l{c}"], row[f"h{c}"], row[f"n{c}"]) for c in columns}
    at = values_at_ranks(df, values, {c: ranks_of(SHARES, spans[c].count) for c in columns}, spans)
    return {c: [interpolated(s, spans[c].count, at[c]) for s in SHARES] for c in columns}


def test_keys_of_doubles_keep_their_order():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=500), rng.integers(0, 2 ** 62, 2000).view("<f8"), [0.0, -0.0, np.inf, 5e-324, 1.7976931348623157e308]])
    values = np.sort(np.concatenate([values, -values]))
    found = double_keys(values)
    assert (np.diff(found) >= 0).all() and [key_double(int(k)) for k in found] == values.tolist()


@pytest.mark.parametrize("bits", [3, 16])
def test_percentiles_are_exact(spark, monkeypatch, bits):
    monkeypatch.setattr(percentiles, "DIGIT_BITS", bits)
    monkeypatch.setattr(percentiles, "FEW_VALUES", 1 << bits)
    passes = []
    monkeypatch.setattr(percentiles, "_pass", lambda *a, own=percentiles._pass: passes.append(1) or own(*a))
    rng = np.random.default_rng(3)
    n = 40_000 if bits == 16 else 3_000
    # no two of the wide values share their leading bits; one value holds a third of the other columns
    wide = rng.integers(0, 2 ** 62, n).view("<f8")
    a = np.where(rng.random(n) < 0.35, 7.5, rng.normal(size=n).round(3))
    b = rng.integers(-2 ** 62, 2 ** 62, n)
    df = spark.createDataFrame([(float(x), None if k % 5 == 0 else int(y), float(w), None) for k, (x, y, w) in enumerate(zip(a, b, wide))],
                               "a double, b bigint, w double, empty double").repartition(4)
    found = percentiles_of(df, ["a", "b", "w", "empty"])
    assert np.allclose(found["a"], np.quantile(a, SHARES), atol=1e-12)
    assert np.allclose(found["b"], np.quantile(b[np.arange(n) % 5 != 0], SHARES), rtol=1e-12)
    assert np.allclose(found["w"], np.quantile(wide, SHARES), rtol=1e-12)
    assert found["empty"] == [None] * len(SHARES)
    # the last digits of a narrow range are settled in the pass that finds it narrow
    assert len(passes) <= -(-64 // bits)


def test_a_distribution_takes_five_scans_at_most(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(percentiles, "_pass", lambda *a, own=percentiles._pass: passes.append(1) or own(*a))
    # far more equal leading bits than values a range may hold: no bracket of a sketch would narrow here
    values = np.concatenate([1.0 + np.arange(70_000) * 2.0 ** -52, [-1e300, 1e300]])
    df = spark.range(70_002).select(F.when(F.col("id") < 70_000, F.lit(1.0) + F.col("id") * F.lit(2.0 ** -52)).when(
        F.col("id") == 70_000, F.lit(-1e300)).otherwise(F.lit(1e300)).alias("a"))
    found = {r["stat"]: r["value"] for r in tp.numeric_distribution("t", df, ["a"]).collect()}
    assert found["50%"] == round(float(np.median(values)), 4) and found["max"] == 1e300 and len(passes) <= 4


def test_correlations(spark):
    df = spark.createDataFrame([(k, 3 * k - 1, 20 - k, f"n{k}", 9) for k in range(6)],
                               "A int, B int, C int, D string, E int")
    found = {(r["col_a"], r["col_b"]): r["r"] for r in association.correlations("t", df).collect()}
    assert found == {("A", "B"): 1.0, ("A", "C"): -1.0, ("B", "C"): -1.0}


def test_correlations_with_gaps(spark):
    rng = random.Random(5)
    rows = [(rng.random(), rng.random() if rng.random() < 0.8 else None, rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r["col_a"], r["col_b"]): r["r"] for r in association.correlations("t", df).collect()}
    expected = df.toPandas().corr().round(4)
    assert all(abs(found[(x, y)] - expected.loc[x, y]) < 1.1e-4 for x, y in found) and len(found) == 3
    # constant where both are present
    partial = spark.createDataFrame([(1.0, None), (2.0, 3.0), (2.0, 4.0)], "a double, b double")
    assert association.correlations("t", partial).count() == 0


def test_cramers_v(spark):
    df = spark.createDataFrame([(f"p{k % 3}", f"q{k % 3}", "same") for k in range(9)], "p string, q string, r string")
    found = {(r["col_a"], r["col_b"]): r["v"] for r in association.cramers_v("t", df, ["p", "q", "r"]).collect()}
    assert found == {("p", "q"): 1.0, ("p", "r"): 0.0, ("q", "r"): 0.0}


def test_correlation_ratio(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None), ("a", 1, 2.0, None), ("b", 5, 2.0, None), ("b", 5, 1.0, None), (None, 9, 9.0, None)],
                               "c string, split int, same double, empty double")
    found = {r["numerical"]: r["eta"] for r in association.correlation_ratio("t", df, ["c"], ["split", "same", "empty"]).collect()}
    assert found == {"split": 1.0, "same": 0.0, "empty": 0.0}


def test_key_columns(spark):
    columns = spark.createDataFrame(
        [("invoice", "number", True), ("invoice", "total", False), ("payment", "number", True), ("payment", "receipt", True)],
        "table_name string, column_name string, potential_primary_key boolean")
    found = {r[0]: r[1] for r in keys.primary_key_columns(columns).collect()}
    assert found == {"number": ["invoice", "payment"], "receipt": ["payment"]}


@pytest.mark.parametrize("child,parent,expected", [
    (["u1", "u1", "u4", "u9", "u2"], ["u1", "u2", "u3"], 0.6), (["u3", None, "u3"], ["u1", "u3"], 1.0),
    ([None], ["u1"], 0.0),
])
def test_pair_coverage(spark, child, parent, expected):
    found = keys.pair_coverage(single(spark, child, "string"), "a", single(spark, parent, "string"), "a")
    assert found.first()["coverage"] == expected


def test_numbers_never_match_text(spark):
    found = keys.pair_coverage(single(spark, ["1", "2"], "string"), "a", single(spark, [1, 2], "int"), "a")
    assert found.first()["coverage"] == 0.0
    found = keys.pair_coverage(single(spark, [1.0, 2.0, 2.5], "double"), "a", single(spark, [1, 2], "int"), "a")
    assert found.first()["coverage"] == 0.6667


def test_foreign_keys_take_first_parent_on_ties(spark):
    tables = {
        "parent": spark.createDataFrame([(i, f"n{i}") for i in range(300)], "id int, name string"),
        "twin": spark.createDataFrame([(i,) for i in range(300)], "code int"),
        "child": spark.createDataFrame([(i % 250, f"n{i % 7}") for i in range(600)], "parent_id int, label string"),
    }
    links = profile_dataset(tables, numeric=False, parts={"profile_fk"})["profile_fk"]
    found = {(r["child_table"], r["child_column"]): (r["parent_table"], r["parent_column"]) for r in links.collect()}
    assert found[("child", "parent_id")] == ("parent", "id")
    assert found[("child", "label")] == ("parent", "name")


def test_disguised_missing(spark):
    rows = [(float(i % 97), 0.0) for i in range(950)] + [(99999.0, 0.0)] * 50
    df = spark.createDataFrame(rows, "a double, flat double").withColumn("gone", F.lit(None).cast("double"))
    found = numeric_profile.disguised_missing("t", df, ["a", "flat", "gone"]).collect()
    assert [(r["column_name"], r["value"], r["frequency"]) for r in found] == [("a", 99999.0, 0.05)]
    counts = numeric_profile.row_counts("t", df.drop("gone"), ["a", "flat"], found).first()
    assert tuple(counts)[1:] == (2, 950, 50)
    assert numeric_profile.without_placeholders(df, found).count() == 950


def test_principal_components_match_svd(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 2))
    data = np.column_stack([base[:, 0], base[:, 0] * 2 + 0.1 * rng.normal(size=400), base[:, 1], np.ones(400)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double, k double")
    found = numeric_profile.principal_components("t", df, ["a", "b", "c", "k"])
    scaled = (data - data.mean(0)) / np.where(data.std(0) > 0, data.std(0), 1)
    sizes = np.linalg.svd(scaled, compute_uv=False) ** 2
    shares = [r["variance_explained"] for r in found.components.orderBy("component").collect()]
    assert np.allclose(shares, (sizes / sizes.sum()).round(4), atol=1e-4)
    assert set(found.main_columns) == {"a", "b", "c"}


def test_correlation_ratio_of_many_columns(spark):
    df = spark.range(30).selectExpr("id % 5 AS x", *[f"concat('v', id % {2 + i % 4}) AS k{i}" for i in range(70)])
    found = association.correlation_ratio("t", df, df.columns[1:], ["x"]).collect()
    assert len({r["categorical"] for r in found}) == len(found) == 70
    assert {r["categorical"] for r in found if r["eta"] == 1.0} == {f"k{i}" for i in range(70) if 2 + i % 4 == 5}


def test_clusters_find_separate_groups(spark):
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.normal(m, 0.2, (60, 2)) for m in (0, 10, 20)])
    rows = [tuple(map(float, r)) for r in data] + [(None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    found = clusters("t", df, ["x", "y"])
    assert found.best_k == 3 and found.best_score > 0.9
    shares = {r["cluster"]: r["share"] for r in found.centroids.collect()}
    assert all(abs(s - 1 / 3) < 1e-3 for s in shares.values())
    means = [data[i * 60:(i + 1) * 60].mean(0).round(4).tolist() for i in range(3)]
    rows = found.centroids.orderBy("cluster", "column_name").collect()
    assert np.allclose([r["centroid"] for r in rows], np.ravel(means), atol=1e-3)
    scaled = (data - data.mean(0)) / data.std(0)
    apart = ((scaled[:, None] - scaled[None]) ** 2).sum(2).reshape(180, 3, 60).sum(2)
    own = apart[np.arange(180), np.arange(180) // 60] / 59
    other = np.where(np.arange(3) == np.arange(180)[:, None] // 60, np.inf, apart / 60).min(1)
    assert abs(found.best_score - ((other - own) / np.maximum(own, other)).mean()) < 1e-4
    # the same for other partitions
    other = clusters("t", df.repartition(7), ["x", "y"])
    assert sorted(other.scores.collect()) == sorted(found.scores.collect())


def test_clusters_of_few_or_equal_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 40 + [(5.0, 2.0)] * 20, "x double, y double")
    found = clusters("t", df, ["x", "y"])
    assert (found.best_k, found.best_score) == (2, 1.0)
    assert sorted({r["share"] for r in found.centroids.collect()}) == [0.3333, 0.6667]
    for few in (df.limit(0), df.limit(1), df.where("x = 1")):
        found = clusters("t", few, ["x", "y"])
        assert found.best_k is None and found.scores.count() == 0 and found.centroids.count() == 0


def test_profile_is_saved_and_read(spark, tmp_path):
    tables = {
        "parent": spark.createDataFrame([(i, i * 0.123456789, "ab"[i % 2]) for i in range(200)], "id int, x double, c string"),
        "child": spark.createDataFrame([(i, i % 200, float(i % 13)) for i in range(400)], "key int, parent_id int, y double"),
    }
    save_profile(profile_dataset(tables, clusters=False), str(tmp_path))
    frames = load_profile(spark, str(tmp_path))
    found = read_calibration(frames, "child")
    assert found["profile_fk"][0]["parent_table"] == "parent"
    assert not any(name.startswith(("profile_pca", "profile_kmeans", "profile_dmv")) for name in found)
    assert "error" in read_calibration(frames, "nothing") and "nb_entries" in profile_json(frames, "parent")


def test_discovery_leaves_out_only_columns_without_parent(spark):
    tables = {
        "parent": spark.createDataFrame([(i, f"n{i}") for i in range(300)], "id int, name string"),
        "child": spark.createDataFrame([(i % 250, (i % 300) / 7.0, f"n{i % 7}", f"zz{i % 7}", i * 10) for i in range(600)],
                                       "parent_id int, share double, label string, other string, far int"),
    }
    columns = profile_columns(tables).columns
    kept, counted = keys.plausible_columns(tables, columns, 1.0)
    assert counted["child", "share"] == 600
    assert kept == {"parent": ["id", "name"], "child": ["parent_id", "label", "far"]}
    every = keys.foreign_keys(keys.coverage(tables, columns))
    assert sorted(keys.discover(tables, columns).collect()) == sorted(every.collect())


def test_flags_are_the_same_without_counting_everything(spark):
    df = spark.range(3_000).selectExpr(
        "id AS key", "concat('k', id) AS code", "IF(id = 7, NULL, id) AS one_gap", "IF(id < 2, NULL, id) AS two_gaps", "id % 100 AS hundred",
        "id % 101 AS more", "IF(id % 100 = 3, NULL, id % 100) AS with_null", "IF(id = 2999, 0, id) AS twice", "-0.0 * (id % 2) AS zeros",
        "id / 3 AS share", "concat(repeat('x', 90), id % 150) AS long", "CAST(NULL AS INT) AS empty", "id % 2 = 0 AS flag", "array(id) AS list")
    tables = {"t": df, "none": df.limit(0)}
    exact = {(r["table_name"], r["column_name"]): r for r in profile_columns(tables).columns.collect()}
    quick = {(r["table_name"], r["column_name"]): r for r in profile_columns(tables, exact=False).columns.collect()}
    for place, row in exact.items():
        assert [row[f] for f in ("potential_primary_key", "is_categorical", "nb_nulls", "datatype")] == [
            quick[place][f] for f in ("potential_primary_key", "is_categorical", "nb_nulls", "datatype")], place
        assert quick[place]["nb_unique"] in (None, row["nb_unique"])
    keys_found = {c for (t, c), r in exact.items() if r["potential_primary_key"] and t == "t"}
    assert keys_found == {"key", "code", "one_gap", "share"}
    few = {c for (t, c), r in exact.items() if r["is_categorical"] and t == "t"}
    assert few == {"hundred", "with_null", "zeros", "empty", "flag"} and exact["t", "zeros"]["nb_unique"] == 1
    categories = profile_columns(tables).categories.collect()
    assert {r["column_name"] for r in categories} == {"hundred", "with_null", "zeros", "flag"}


def test_values_are_not_counted_where_evidence_settles_the_flags(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("id % 7 AS few", "id % 5000 AS many", "id AS key", "concat('n', id % 9000) AS name")
    counted = []
    monkeypatch.setattr(tp, "value_counts", lambda tables, slices=None, own=tp.value_counts: counted.append(
        (slices, sorted(c for d in tables.values() for c in d.columns))) or own(tables, slices))
    profile_columns({"t": df}, exact=False)
    # the span rules `many` out, a repetition in one slice rules `name` out, only the key is counted whole
    assert counted == [(value_sets.SLICES, ["key", "name"]), (None, ["key"])]


def test_refuted_pairs_carry_a_witness(spark, monkeypatch):
    tables = {
        "parent": spark.range(5_000).selectExpr("id * 2 AS even", "concat('p', id) AS name"),
        "other": spark.range(9_000).selectExpr("id AS every"),
        "child": spark.range(20_000).selectExpr("id % 9000 AS number", "(id % 4000) * 2 AS fits", "concat('p', id % 7000) AS label",
                                                "id % 50 AS few", "IF(id % 1000 = 1, NULL, id % 4500) AS gaps"),
    }
    columns = profile_columns(tables, exact=False).columns
    whole = []
    monkeypatch.setattr(keys, "coverage", lambda rest, *a, own=keys.coverage: whole.append(
        {(t, c) for t, d in rest.items() for c in d.columns}) or own(rest, *a))
    found = keys.inclusion(tables, columns)
    kept = {(r["child_column"], r["parent_column"]): r["coverage"] for r in found.found.collect()}
    every = {(r["child_column"], r["parent_column"]): r["coverage"] for r in keys.foreign_keys(found.found).collect()}
    assert every == {("number", "every"): 1.0, ("fits", "even"): 1.0, ("few", "every"): 1.0, ("gaps", "every"): 1.0, ("even", "every"): 1.0} | {
        k: v for k, v in every.items() if k == ("even", "every")} or ("even", "every") not in kept
    assert kept["few", "even"] == 0.5
    refuted = {(r["child_column"], r["parent_column"]): r for r in found.refuted.collect()}
    assert {("number", "even"), ("label", "name"), ("gaps", "even")} <= set(refuted)
    assert not set(refuted) & set(kept)
    for (child, parent), r in refuted.items():
        missing = tables[r["child_table"]].where(F.col(child).cast("double").cast("string") == r["witness"]) if child != "label" else tables[
            r["child_table"]].where(F.col(child) == r["witness"])
        assert missing.count() >= 1
        assert tables[r["parent_table"]].where(F.col(parent).cast("string") == (r["witness"] if child == "label" else str(int(float(r["witness"]))))).count() == 0
    assert ("child", "label") not in whole[0] and ("parent", "name") not in whole[0]


def test_a_few_missing_rows_are_below_rounding(spark):
    """Coverage is rounded before it is compared: one row in 100,000 without a parent does not matter."""
    tables = {"parent": spark.range(99_999).selectExpr("id AS key"),
              "child": spark.range(100_000).selectExpr("id AS ref", "concat('x', id) AS text")}
    columns = profile_columns(tables, exact=False).columns
    links = {(r["child_column"], r["parent_column"]): r["coverage"] for r in keys.discover(tables, columns).collect()}
    assert links[("ref", "key")] == 1.0 and links[("key", "ref")] == 1.0


def test_many_columns_correlate_in_two_scans(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = rng.normal(size=(300, 60))
    data[:, 1] = -data[:, 0]
    data[:, 2] = 4.0
    data[rng.random((300, 60)) < 0.1] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in data], ", ".join(f"c{i} double" for i in range(60)))
    found = {(r["col_a"], r["col_b"]): r["r"] for r in association.correlations("t", df.repartition(5)).collect()}
    expected = df.toPandas().corr()
    assert found["c0", "c1"] == -1.0 and not any("c2" in pair for pair in found) and len(found) == 59 * 58 // 2
    assert all(abs(r - expected.loc[a, b]) < 6e-5 for (a, b), r in found.items())


def test_strings_with_equal_beginnings_find_their_top(spark):
    start = "s" * 40 + "é" * 30
    texts = [start + "b"] * 3 + [start + "a"] * 3 + [start + "c"] * 2 + ["t" * 90] * 3 + [None]
    top = tp.string_distribution({"t": single(spark, texts, "string")}).first()
    assert (top["count"], top["unique"], top["top"], top["freq"]) == (11, 4, start + "a", 3)
    unique = tp.string_distribution({"t": single(spark, [start + "z", start + "y", "zz"], "string")}).first()
    assert (unique["top"], unique["freq"]) == (start + "y", 1)
    mixed = tp.string_distribution({"t": single(spark, [start, "a", start, "a"], "string")}).first()
    assert (mixed["top"], mixed["freq"]) == ("a", 2)


def test_associations_of_tables_with_gaps_and_floats(spark):
    df = spark.createDataFrame([(0.0, "x", 1.0), (-0.0, "x", None), (1.5, None, 2.0), (1.5, "y", float("nan")), (None, "y", 5.0)],
                               "f double, s string, n double")
    v = association.cramers_v("t", df, ["f", "s"]).first()["v"]
    assert v == 1.0
    eta = {r["categorical"]: r["eta"] for r in association.correlation_ratio("t", df, ["f", "s"], ["n"]).collect()}
    assert eta == {"f": 1.0, "s": 1.0}


def test_clusters_of_all_rows_have_the_cost_that_sql_finds(spark):
    rng = np.random.default_rng(4)
    data = rng.integers(0, 40, (4_000, 2)) + np.repeat([[0, 0], [200, 0], [0, 300], [250, 320]], 1_000, axis=0)
    df = spark.createDataFrame([tuple(map(int, r)) for r in data], "x int, y int")
    found = clusters("t", df, ["x", "y"])
    assert found.best_k == 4
    con = duckdb.connect()
    con.register("points", df.toPandas())
    con.register("centres", found.centroids.toPandas().pivot(index="cluster", columns="column_name", values="centroid").reset_index())
    told = con.execute("""WITH near AS (SELECT p.x, p.y, arg_min(c.cluster, (p.x - c.x) ** 2 / 1.0 + (p.y - c.y) ** 2) AS cluster
        FROM (SELECT row_number() OVER () AS id, * FROM points) p, centres c GROUP BY p.id, p.x, p.y)
        SELECT cluster, round(count(*) / 4000.0, 4), avg(x), avg(y) FROM near GROUP BY cluster ORDER BY cluster""").fetchall()
    rows = found.centroids.toPandas().pivot(index="cluster", columns="column_name", values="centroid").sort_index()
    assert np.allclose([r[2:] for r in told], rows[["x", "y"]].to_numpy(), atol=1e-3)
    assert [r[1] for r in told] == [0.25] * 4
