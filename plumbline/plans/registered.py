"""Every operator as a query over the given tables: (spark, folder) -> DataFrame.

Derived inputs (missing cells, copies, placeholders, logs, reports) are made from whole tables by Spark
expressions, so the work of each query grows with the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import base_type, numeric_columns, quoted
from plumbline.functions.draws import uniform
from plumbline.operators import association, corruption, keys, numeric_profile, reconciliation
from plumbline.operators import table_profile as tp
from plumbline.operators.clusters import clusters
from plumbline.operators.detection import Context, detect
from plumbline.operators.profile_store import read_profiles
from plumbline.plans.closed_loop import detect_tables, numbered_findings
from plumbline.plans.corruption_round import run_round
from plumbline.plans.profile_dataset import (
    load_profile, profile_columns, profile_dataset, profile_lines, save_profile,
)
from plumbline.session import each, materialize, shared_dir
from plumbline.sources import tables as source

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

PLACEHOLDER, PLACEHOLDER_EVERY = 99999999.0, 20
SPLIT_SEED = "split"


def load(spark: SparkSession, folder: str, *names: str) -> tp.Tables:
    return {n: source.read_parquet(spark, f"{folder.rstrip('/')}/{n}.parquet") for n in names or TABLES}


def flat(df: DataFrame) -> DataFrame:
    """Timestamps as text."""
    return df.select(*[
        F.date_format(quoted(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name)
        if f.dataType.typeName().startswith("timestamp") else quoted(f.name) for f in df.schema])


# --- derived inputs -------------------------------------------------------------------------------------

def orders_nulls(orders: DataFrame) -> DataFrame:
    return orders.withColumn("o_totalprice", F.when(uniform("nulls", F.col("o_orderkey")) >= 0.1, F.col("o_totalprice")))


def orders_copies(orders: DataFrame) -> DataFrame:
    twice = F.when(uniform("copies", F.col("o_orderkey")) < 0.05, 2).otherwise(1)
    return orders.withColumn("copy", F.explode(F.sequence(F.lit(1), twice))).drop("copy")


def orders_placeholder(orders: DataFrame) -> DataFrame:
    marked = F.col("o_orderkey") % PLACEHOLDER_EVERY == 0
    return orders.withColumn("o_totalprice", F.when(marked, F.lit(PLACEHOLDER)).otherwise(F.col("o_totalprice")))


def orders_datestr(orders: DataFrame) -> DataFrame:
    """The order date as text in three layouts: 2 % garbage, 10 % garbage, day-first."""
    key, iso = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select(
        "o_orderkey",
        F.when(key % 50 == 0, "n/a").otherwise(iso).alias("mostly_dates"),
        F.when(key % 10 == 0, "n/a").otherwise(iso).alias("too_few_dates"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_first"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("digits_only"),
        F.col("o_orderpriority").alias("words"))


def _widened(spark: SparkSession, folder: str) -> tp.Tables:
    """All tables and the derived ones that hold what the generated data lacks."""
    tables = load(spark, folder)
    orders = tables["orders"]
    return {**tables, "orders_copies": orders_copies(orders), "orders_nulls": orders_nulls(orders)}


# --- profile ----------------------------------------------------------------------------------------------

def table_profile(spark, folder):
    return tp.table_profile(_widened(spark, folder))


def column_types(spark, folder):
    return tp.column_types(_widened(spark, folder)).drop("nb_rows", "nb_values")


def _columns(spark, folder, *names):
    """Column flags; distinct values are counted only where a flag depends on them."""
    return profile_columns(load(spark, folder, *names), exact=False)


def column_profile(spark, folder):
    return profile_columns(_widened(spark, folder)).columns


def primary_keys(spark, folder):
    return _columns(spark, folder).columns.filter("potential_primary_key").select("table_name", "column_name")


def primary_key_columns(spark, folder):
    found = keys.primary_key_columns(_columns(spark, folder).columns)
    return found.select("column_name", F.array_join("tables", ",").alias("tables"))


def null_profile(spark, folder):
    return tp.null_profile(_widened(spark, folder))


def category_distribution(spark, folder):
    return _columns(spark, folder).categories.withColumn("share", F.round("share", 4))


def numeric_distribution(spark, folder):
    tables = load(spark, folder)
    measured = [(t, numeric_columns(df)) for t, df in sorted(tables.items()) if numeric_columns(df)]
    return tp.union_all(each(measured, lambda m: tp.numeric_distribution(m[0], tables[m[0]], m[1])))


def datetime_distribution(spark, folder):
    tables = load(spark, folder)
    times = {t: [f.name for f in df.schema if base_type(f.dataType) == "datetime"] for t, df in sorted(tables.items())}
    return tp.union_all(each([s for s in times.items() if s[1]], lambda s: tp.datetime_distribution(s[0], tables[s[0]], s[1])))


def string_distribution(spark, folder):
    return tp.string_distribution(load(spark, folder))


def datetime_strings(spark, folder):
    dates = orders_datestr(load(spark, folder, "orders")["orders"])
    return tp.union_all([
        tp.date_text_share(dates, c).withColumn("column_name", F.lit(c)) for c in dates.columns if c != "o_orderkey"])


def correlations(spark, folder):
    tables = load(spark, folder)
    paired = [t for t, df in sorted(tables.items()) if len(numeric_columns(df)) > 1]
    return tp.union_all(each(paired, lambda t: association.correlations(t, tables[t])))


def _by_table(columns: DataFrame) -> dict[str, list[str]]:
    """Column names by table, in column order: schema-sized."""
    found: dict[str, list[str]] = {}
    for row in columns.orderBy("table_name", "ordinal").collect():
        found.setdefault(row["table_name"], []).append(row["column_name"])
    return found


def cramers_v(spark, folder):
    tables, columns, categories, _ = _columns(spark, folder)
    labels = association.read_labels(categories)
    paired = [(t, c) for t, c in sorted(_by_table(keys.categorical_columns(columns)).items()) if len(c) > 1]
    return tp.union_all(each(paired, lambda p: association.cramers_v(p[0], tables[p[0]], p[1], labels[p[0]])))


def correlation_ratio(spark, folder):
    tables, columns, categories, _ = _columns(spark, folder)
    labels = association.read_labels(categories)
    categorical = _by_table(keys.categorical_columns(columns))
    numerical = _by_table(keys.numerical_columns(columns, keys.discover(tables, columns, categories=categories)))
    both = sorted(set(categorical) & set(numerical))
    return tp.union_all(each(both, lambda t: association.correlation_ratio(
        t, tables[t], categorical[t], numerical[t], labels[t])))


# --- keys ---------------------------------------------------------------------------------------------------

def fk_coverage(spark, folder):
    found = _columns(spark, folder)
    return keys.coverage(found.typed, found.columns).drop("parent_rank")


def _links(spark, folder):
    tables = load(spark, folder)
    found = profile_columns(tables, exact=False)
    return found.columns, keys.discover(tables, found.columns, categories=found.categories)


def foreign_keys(spark, folder):
    return _links(spark, folder)[1]


def referenced_keys(spark, folder):
    return keys.referenced_keys(_links(spark, folder)[1])


def numerical_columns(spark, folder):
    return keys.numerical_columns(*_links(spark, folder))


def categorical_columns(spark, folder):
    return keys.categorical_columns(_columns(spark, folder).columns)


def pair_coverage(spark, folder):
    tables = load(spark, folder, "lineitem", "customer", "orders", "documents", "labels")
    pairs = [("lineitem", "l_partkey", "customer", "c_custkey"), ("orders", "o_custkey", "customer", "c_custkey"),
             ("documents", "doc_id", "labels", "doc_id"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    return tp.union_all([
        keys.pair_coverage(tables[a], b, tables[c], d).select(
            F.lit(f"{a}.{b}").alias("child"), F.lit(f"{c}.{d}").alias("parent"), "coverage")
        for a, b, c, d in pairs])


# --- numerical profile -----------------------------------------------------------------------------------

def _measured(spark, folder) -> tuple[tp.Tables, dict[str, list[str]]]:
    """All tables, orders with gaps and placeholders in place of orders, and their columns fit for statistics."""
    tables = load(spark, folder)
    tables["orders_marked"] = orders_placeholder(orders_nulls(tables.pop("orders")))
    _, columns, categories, _ = profile_columns(tables, exact=False)
    return tables, _by_table(keys.numerical_columns(columns, keys.discover(tables, columns, categories=categories)))


def _suspects(tables: tp.Tables, numerical: dict[str, list[str]]) -> DataFrame:
    wide = [t for t in sorted(numerical) if len(numerical[t]) > 1]
    return tp.union_all(each(wide, lambda t: numeric_profile.disguised_missing(t, tables[t], numerical[t])))


def disguised_missing(spark, folder):
    return _suspects(*_measured(spark, folder))


def ml_row_counts(spark, folder):
    tables, numerical = _measured(spark, folder)
    suspects: dict[str, list] = {}
    # one row per column at most
    for row in _suspects(tables, numerical).collect():
        suspects.setdefault(row["table_name"], []).append(row)
    return tp.union_all([numeric_profile.row_counts(t, df, numerical.get(t, []), suspects.get(t, []))
                         for t, df in sorted(tables.items())])


def pca_2col(spark, folder):
    part = load(spark, folder, "part")["part"]
    found = numeric_profile.principal_components("part", part, ["p_partkey", "p_retailprice"])
    loadings = found.loadings.groupBy("component").agg(*[
        F.max(F.when(F.col("column_name") == c, F.abs("loading"))).alias(c) for c in ("p_partkey", "p_retailprice")])
    return found.components.join(loadings, "component", "left").drop("table_name")


def _components(spark, folder) -> dict[str, numeric_profile.Components]:
    """Components of every table with two numeric columns or more."""
    tables, columns, categories, _ = _columns(spark, folder)
    numerical = _by_table(keys.numerical_columns(columns, keys.discover(tables, columns, categories=categories)))
    wide = [t for t in sorted(numerical) if len(numerical[t]) > 1]
    return dict(zip(wide, each(wide, lambda t: numeric_profile.principal_components(t, tables[t], numerical[t]))))


def pca_profile(spark, folder):
    return tp.union_all([found.components for found in _components(spark, folder).values()])


def pca_power_sums(spark, folder):
    """Sums of the first four powers of each table's eigenvalues, which are the traces of the powers of its correlation matrix."""
    rows = [(t, m, sum(x ** m for x in found.eigenvalues)) for t, found in _components(spark, folder).items() for m in range(1, 5)]
    return spark.createDataFrame(rows, "table_name string, power int, total double").withColumn("total", F.round("total", 4))


def kmeans_profile(spark, folder):
    lineitem = load(spark, folder, "lineitem")["lineitem"]
    found = clusters("lineitem", lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return found.scores.withColumn("is_best", F.col("k") == F.lit(found.best_k))


# --- sources ----------------------------------------------------------------------------------------------

def split_counts(spark, folder):
    def sides(t: str) -> DataFrame:
        df = source.with_row_id(spark, f"{folder.rstrip('/')}/{t}.parquet")
        clean, test = source.split(df, df.count())
        return tp.union_all([
            side.agg(F.count(F.lit(1)).alias("nb_rows"), F.min("row_id").alias("first_row"),
                     F.max("row_id").alias("last_row")).select(
                F.lit(t).alias("table_name"), F.lit(role).alias("role"), "nb_rows", "first_row", "last_row")
            for role, side in (("clean", clean), ("test", test))])

    return tp.union_all(each(TABLES, sides))


def split_keys(spark, folder):
    """Sum of the keys on either side of the positional split of orders."""
    df = source.with_row_id(spark, f"{folder.rstrip('/')}/orders.parquet")
    clean, test = source.split(df, df.count())
    return tp.union_all([
        side.agg(F.sum("o_orderkey").alias("key_sum"), F.round(F.sum("o_totalprice"), 2).alias("price_sum"))
        .withColumn("role", F.lit(role)) for role, side in (("clean", clean), ("test", test))])


def view_join(spark, folder):
    t = load(spark, folder, "orders", "customer")
    return source.joined_view(
        t["orders"], t["customer"], [("o_custkey", "c_custkey")],
        ["o_orderkey", "o_custkey", "o_orderstatus", "c_name", "c_mktsegment"],
        F.col("c_mktsegment") == "BUILDING", 50, ["o_orderkey"])


def bounded_sql(spark, folder):
    source.publish(load(spark, folder, "orders", "customer"), {})
    return source.bounded_query(spark, """
        SELECT c_nationkey, c_mktsegment, count(*) AS nb_orders, round(sum(o_totalprice), 2) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY c_nationkey, c_mktsegment ORDER BY c_nationkey, c_mktsegment;""", max_rows=1_000_000)


def whole_column(spark, folder):
    df = source.with_row_id(spark, f"{folder.rstrip('/')}/customer.parquet")
    clean, test = source.split(df, df.count())
    return source.whole_column(clean, test, "c_name")


# --- corruption --------------------------------------------------------------------------------------------

def _inject(table: str, key: str, change: Callable[[DataFrame], DataFrame]):
    def run(spark, folder):
        return flat(change(load(spark, folder, table)[table]))

    return run


def _stats(df: DataFrame, column: str) -> dict:
    value = quoted(column).cast("double")
    return df.agg(F.round(F.stddev_samp(value), 4).alias("std"), F.round(F.min(value), 4).alias("low"),
                  F.round(F.max(value), 4).alias("high")).first().asDict()


def _shift(df: DataFrame, column: str, sizes: float, mode: str, direction: int | None, whole: bool) -> DataFrame:
    known = _stats(df, column)
    return corruption.distribution_shift(df, column, sizes * known["std"], mode, direction, known["low"],
                                         known["high"], 0.4, "shift", whole, "p_partkey")


def _beyond(df: DataFrame, column: str, whole: bool) -> DataFrame:
    known = _stats(df, column)
    return corruption.out_of_range(df, column, known["low"], known["high"],
                                   0.25 * (known["high"] - known["low"]), "both", 0.04, "range", whole, "p_partkey")


def inject_orphan_fk(spark, folder):
    t = load(spark, folder, "orders", "customer")
    return flat(corruption.orphan_foreign_key(
        t["orders"], "o_custkey", t["customer"].select("c_custkey"), 0.2, "orphan", "o_orderkey"))


INJECTIONS = {
    "inject_wrong_datatype": _inject("part", "p_partkey", lambda df: corruption.wrong_datatype(
        df, "p_size", "int", "float", 0.3, "type", "p_partkey")),
    "inject_wrong_datatype_dates": _inject("orders", "o_orderkey", lambda df: corruption.wrong_datatype(
        df, "o_orderstatus", "str", "datetime", 0.3, "type", "o_orderkey")),
    "inject_null": _inject("orders", "o_orderkey", lambda df: corruption.insert_null(
        df, "o_totalprice", 0.3, "null", "o_orderkey")),
    "inject_duplicate_rows": _inject("orders", "o_orderkey", lambda df: corruption.duplicate_rows(
        df, 0.15, "copy", "o_orderkey")),
    "inject_new_column": _inject("customer", "c_custkey", lambda df: corruption.insert_column(df, "c_mktsegment")),
    "inject_orphan_fk": inject_orphan_fk,
    "inject_new_category": _inject("customer", "c_custkey", lambda df: corruption.new_category(
        df, "c_mktsegment", "UNKNOWN", 0.25, "label", "c_custkey")),
    "inject_correlation_break": _inject("part", "p_partkey", lambda df: corruption.correlation_break(
        df, "p_retailprice", 0.6, "pair", "p_partkey")),
    "inject_distribution_shift": _inject("part", "p_partkey", lambda df: _shift(
        df, "p_retailprice", 1.5, "spread", None, False)),
    "inject_distribution_shift_int": _inject("part", "p_partkey", lambda df: _shift(
        df, "p_size", 0.5, "shift", 1, True)),
    "inject_duplicate_pk": _inject("orders", "o_orderkey", lambda df: corruption.duplicate_primary_key(
        df.withColumn("row_id", F.col("o_orderkey")), "o_orderkey", 0.2, "donor")),
    "inject_out_of_range": _inject("part", "p_partkey", lambda df: _beyond(df, "p_retailprice", False)),
    "inject_out_of_range_int": _inject("part", "p_partkey", lambda df: _beyond(df, "p_size", True)),
}


# --- detection -----------------------------------------------------------------------------------------------

def _sides(spark, folder, table: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Clean and new rows of a table, drawn by key; `row_id` is the key."""
    df = load(spark, folder, table)[table].withColumn("row_id", F.col(key))
    return source.split(df, 0, how="hash", seed=SPLIT_SEED)


def _found(spark, table: str, clean: DataFrame, batch: DataFrame, anomaly: str, parts: set[str],
           extra: tp.Tables | None = None) -> DataFrame:
    """Findings of one detector, against a profile of the clean rows."""
    tables = {table: clean, **(extra or {})}
    frames = profile_dataset(tables, numeric=False, key="row_id", parts=parts)
    profile = read_profiles(frames)[table]
    return detect(batch, profile, Context(clean=tables, batch={table: batch}), {anomaly})


def detect_wrong_datatype(spark, folder):
    clean, batch = _sides(spark, folder, "part", "p_partkey")
    batch = corruption.wrong_datatype(batch, "p_size", "int", "str", 0.3, "type").drop("hit")
    return _found(spark, "part", clean, batch, "wrong_datatype", {"profile_column"})


def detect_insert_null(spark, folder):
    clean, batch = _sides(spark, folder, "orders", "o_orderkey")
    batch = corruption.insert_null(batch, "o_totalprice", 0.3, "null").drop("hit")
    return _found(spark, "orders", clean, batch, "insert_null", {"profile_column"})


def detect_duplicate_rows(spark, folder):
    clean, batch = _sides(spark, folder, "orders", "o_orderkey")
    batch = corruption.duplicate_rows(batch, 0.15, "copy").drop("hit")
    return _found(spark, "orders", clean, batch, "duplicate_rows", {"profile_table", "profile_column"})


def detect_insert_column(spark, folder):
    clean, batch = _sides(spark, folder, "customer", "c_custkey")
    batch = corruption.insert_column(batch, "c_mktsegment").drop("hit")
    return _found(spark, "customer", clean, batch, "insert_column", {"profile_column"})


def detect_orphan_foreign_key(spark, folder):
    clean, batch = _sides(spark, folder, "orders", "o_orderkey")
    customer = load(spark, folder, "customer")["customer"]
    batch = batch.withColumn("o_custkey", F.when(uniform("orphan", F.col("row_id")) < 0.2, F.col("o_custkey") + 1000000)
                             .otherwise(F.col("o_custkey")))
    return _found(spark, "orders", clean, batch, "orphan_foreign_key", {"profile_column", "profile_fk"},
                  {"customer": customer})


def detect_new_category(spark, folder):
    clean, batch = _sides(spark, folder, "customer", "c_custkey")
    batch = corruption.new_category(batch, "c_mktsegment", "UNKNOWN", 0.25, "label").drop("hit")
    return _found(spark, "customer", clean, batch, "new_category", {"profile_column", "profile_category"})


def detect_correlation_break(spark, folder):
    clean, batch = _sides(spark, folder, "part", "p_partkey")
    batch = corruption.correlation_break(batch, "p_retailprice", 0.9, "pair").drop("hit")
    return _found(spark, "part", clean, batch, "correlation_break", {"profile_column", "profile_correlation"})


def detect_duplicate_primary_key(spark, folder):
    clean, batch = _sides(spark, folder, "orders", "o_orderkey")
    batch = corruption.duplicate_primary_key(batch, "o_orderkey", 0.2, "donor").drop("hit")
    # some rows take the key of their clean neighbour
    batch = batch.withColumn("o_orderkey", F.when(uniform("reuse", F.col("row_id")) < 0.1, F.col("o_orderkey") - 1)
                             .otherwise(F.col("o_orderkey")))
    return _found(spark, "orders", clean, batch, "duplicate_primary_key", {"profile_column"})


def detect_distribution_shift(spark, folder):
    clean, batch = _sides(spark, folder, "orders", "o_orderkey")
    known = _stats(clean, "o_totalprice")
    batch = corruption.distribution_shift(batch, "o_totalprice", 1.5 * known["std"], "shift", 1, known["low"],
                                          known["high"], 0.6, "shift").drop("hit", "hit_clamped")
    return _found(spark, "orders", clean, batch, "distribution_shift", {"profile_column", "profile_distribution"})


def detect_out_of_range(spark, folder):
    clean, batch = _sides(spark, folder, "orders", "o_orderkey")
    known = _stats(clean, "o_totalprice")
    batch = corruption.out_of_range(batch, "o_totalprice", known["low"], known["high"],
                                    0.25 * (known["high"] - known["low"]), "both", 0.05, "range").drop("hit", "hit_below")
    return _found(spark, "orders", clean, batch, "out_of_range", {"profile_column", "profile_distribution"})


# --- whole rounds ---------------------------------------------------------------------------------------------

#: Profile frames that a round and the detectors read.
_ROUND_PARTS = {"profile_table", "profile_column", "profile_category", "profile_distribution", "profile_correlation", "profile_fk"}


def _round_inputs(spark, folder, how: str):
    def sides(table: str):
        df = source.with_row_id(spark, f"{folder.rstrip('/')}/{table}.parquet")
        # written once, as ingest does: a round passes over its tables dozens of times, over the few new rows most often
        return [materialize(side, f"side-{table}") for side in source.split(df, df.count(), how=how, seed=SPLIT_SEED)]

    found = dict(zip(TABLES, each(TABLES, sides)))
    clean, test = {t: c for t, (c, _) in found.items()}, {t: b for t, (_, b) in found.items()}
    frames = profile_dataset(clean, test, numeric=False, key="row_id", parts=_ROUND_PARTS)
    return clean, test, read_profiles(frames)


#: A run whose random choice takes many tables and all kinds of anomalies.
RUN_NUMBER = 3


def corruption_round_log(spark, folder):
    """What a round of its own choice does to the tables."""
    clean, test, profiles = _round_inputs(spark, folder, "hash")
    done = run_round(RUN_NUMBER, clean, test, profiles, seed="log")
    return done.injection_log(spark).drop("logged_at", "params")


def clean_batch_findings(spark, folder):
    """Findings on batches nobody corrupted, cut by position: what ordered tables alone give."""
    clean, test, profiles = _round_inputs(spark, folder, "position")
    return numbered_findings(detect_tables(test, clean, profiles), 1)


def saved_profile(spark, folder):
    """Profile of all tables, clusters included, saved, read again and turned into JSON lines."""
    target = f"{shared_dir(spark).rstrip('/')}/plumbline/profile-{uuid.uuid4().hex}"
    save_profile(profile_dataset(load(spark, folder)), target)
    return profile_lines(load_profile(spark, target))


# --- reconciliation ---------------------------------------------------------------------------------------------

def injected_log(events: DataFrame) -> DataFrame:
    """A log with a row per event: few tables and columns, so groups are large; some columns blank."""
    e, u = F.col("event_id"), F.col("user_id")
    return events.select(
        (u % 5).cast("int").alias("run_number"), (e + 1).alias("id"),
        F.concat(F.lit("t"), (u % 23).cast("string")).alias("table"),
        F.when(e % 11 == 0, "").otherwise(F.concat(F.lit("c"), (e % 37).cast("string"))).alias("column"),
        F.concat(F.lit("a"), (e % 10).cast("string")).alias("anomaly"),
        (F.floor(F.abs("value") * 10) % 50).cast("bigint").alias("nb_rows_affected"))


def found_log(orders: DataFrame) -> DataFrame:
    """A finding per order, over the same tables, columns and anomalies."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        (c % 5).cast("int").alias("run_number"), (o + 1).alias("id"),
        F.concat(F.lit("t"), (c % 23).cast("string")).alias("table"),
        F.when(o % 13 == 0, "").otherwise(F.concat(F.lit("c"), (o % 41).cast("string"))).alias("column"),
        F.concat(F.lit("a"), (o % 10).cast("string")).alias("anomaly"),
        (F.floor(F.col("o_totalprice")) % 50).cast("bigint").cast("string").alias("nb_rows_affected"))


def _logs(spark, folder):
    t = load(spark, folder, "events", "orders")
    return injected_log(t["events"]), found_log(t["orders"])


def reconcile_matches(spark, folder):
    return reconciliation.matches(*_logs(spark, folder))


def reconcile_claims(spark, folder):
    injected, found = _logs(spark, folder)
    return reconciliation.matches(found, injected)


def reconcile_scores(spark, folder):
    return reconciliation.scores(*_logs(spark, folder))


def reconcile_strict(spark, folder):
    return reconciliation.strict_matches(*_logs(spark, folder))


def reports(orders: DataFrame) -> DataFrame:
    """A report text per order, with one or two findings, sometimes a short line and feedback."""
    key = F.col("o_orderkey")
    line = F.concat(
        F.lit("orders_new_data | o_custkey | insert_null | 0 | "), F.col("o_custkey").cast("string"), F.lit(" | "),
        key.cast("string"), F.lit(" | "), F.col("o_orderpriority"), F.lit(" "))
    second = F.when(key % 3 == 0, F.concat(
        F.lit("\ncustomer |  | duplicate_rows | 0 | "), F.col("o_orderstatus"), F.lit(" | 4 | High"))).otherwise("")
    short = F.when(key % 17 == 0, "\nno anomaly | here").otherwise("")
    feedback = F.when(key % 5 == 0, F.concat(
        F.lit("\n\n### **FEEDBACK**\nmore tools\n\n  run "), key.cast("string"), F.lit(" "))).otherwise("")
    heading = F.when(key % 29 == 0, "no section\n").otherwise("### **OUTPUT**\n")
    return orders.select(
        (key % 7).cast("int").alias("run_number"), key.alias("report"),
        F.concat(F.lit("Looked at all tables.\n"), heading, line, second, short, feedback).alias("text"))


def _reports(spark, folder):
    return reports(load(spark, folder, "orders")["orders"])


def parse_reports(spark, folder):
    return reconciliation.with_ids(reconciliation.parse_reports(_reports(spark, folder)))


def rejected_lines(spark, folder):
    return reconciliation.rejected_lines(_reports(spark, folder))


def feedback_lines(spark, folder):
    return reconciliation.feedback_lines(_reports(spark, folder))


def usage(events: DataFrame) -> DataFrame:
    """Token counts per event."""
    e = F.col("event_id")
    return events.select(
        F.concat(F.lit("tier_"), (e % 3 + 1).cast("string")).alias("model"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        (F.col("user_id") * 10 + 500).alias("total_input_tokens"), (e % 700).alias("total_output_tokens"),
        (e % 90 * 40).alias("total_cache_read"), (e % 45 * 20).alias("total_cache_written"))


def usage_cost(spark, folder):
    return reconciliation.usage_cost(usage(load(spark, folder, "events")["events"]), by=("model", "day"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        split_counts, split_keys, view_join, bounded_sql, whole_column, table_profile, column_types,
        column_profile, null_profile, primary_keys, primary_key_columns, category_distribution,
        numeric_distribution, datetime_distribution, string_distribution, datetime_strings, correlations,
        cramers_v, correlation_ratio, fk_coverage, pair_coverage, foreign_keys, referenced_keys,
        numerical_columns, categorical_columns, disguised_missing, ml_row_counts, pca_2col, pca_profile, pca_power_sums,
        kmeans_profile, saved_profile,
        detect_wrong_datatype, detect_insert_null, detect_duplicate_rows, detect_insert_column,
        detect_orphan_foreign_key, detect_new_category, detect_correlation_break,
        detect_duplicate_primary_key, detect_distribution_shift, detect_out_of_range,
        corruption_round_log, clean_batch_findings, reconcile_matches, reconcile_claims, reconcile_scores,
        reconcile_strict, parse_reports, rejected_lines, feedback_lines, usage_cost,
    )
}
QUERIES.update(INJECTIONS)
