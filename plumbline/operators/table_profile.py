"""Per-table profile: sizes, duplicates, column types, nulls, keys, categories, distributions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    KEY_PREFIX, LONG_TEXT, MIN_DATE_SHARE, SHORT_TEXT, YES_NO, as_double, base_type, cell_key, cell_sql, date_text_sql,
    epoch_micros, is_date_text, name_sql, parse_datetime, quoted, row_fingerprint,
)
from plumbline.functions.percentiles import Span, interpolated, ordered, ranks_of, values_at_ranks
from plumbline.operators.value_sets import SLICES, Evidence, evidence_counts, in_slice, read_evidence, with_buckets
from plumbline.session import each, materialize, narrow_rows

# Category limit and the percentiles of a distribution.
MAX_CATEGORIES = 100
PERCENTILES = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
PERCENTILE_NAMES = ["1%", "5%", "10%", "25%", "50%", "75%", "90%", "95%", "99%"]

# Columns whose cells are unfolded together.
COLUMNS_PER_BRANCH = 6
# Columns whose types and evidence are found by one aggregate.
COLUMNS_PER_SCAN = 3

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

Tables = dict[str, DataFrame]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def columns_frame(spark: SparkSession, tables: Tables) -> DataFrame:
    """One row per column: the schema as a table. `attr` numbers columns over all tables."""
    rows, attr = [], 0
    for table, df in sorted(tables.items()):
        for ordinal, field in enumerate(df.schema):
            rows.append((attr, table, field.name, ordinal, base_type(field.dataType)))
            attr += 1
    return spark.createDataFrame(
        rows, "attr int, table_name string, column_name string, ordinal int, storage string")


def tables_frame(spark: SparkSession, tables: Tables) -> DataFrame:
    """One row per table; a table's rows are counted under a negative `attr`."""
    rows = [(-1 - n, table, len(df.columns)) for n, (table, df) in enumerate(sorted(tables.items()))]
    return spark.createDataFrame(rows, "attr int, table_name string, nb_columns int")


# --- column types -------------------------------------------------------------------------------

def _type_counts(df: DataFrame) -> list[str]:
    """What one scan has to count to name every column's type, as SQL."""
    counts = ["count(1) AS n"]
    for i, field in enumerate(df.schema):
        column, kind = name_sql(field.name), base_type(field.dataType)
        counts.append(f"count({column}) AS v{i}")
        if kind in ("int", "float"):
            counts.append(f"count_if({column} NOT IN (0, 1)) AS x{i}")
        elif kind == "str":
            labels = ", ".join(f"'{label}'" for label in YES_NO)
            counts += [f"count_if({column} NOT IN ({labels})) AS x{i}", f"count_if({date_text_sql(field.name)}) AS d{i}"]
    return counts


def _type_name(df: DataFrame, i: int) -> str:
    kind = base_type(df.schema[i].dataType)
    if kind is None:
        return "CAST(NULL AS STRING)"
    tests = ["WHEN n = 0 THEN 'bool'"]
    if kind in ("int", "float", "str"):
        # a missing value is one more distinct value, so it rules the two-label types out
        tests.append(f"WHEN v{i} = n AND x{i} = 0 THEN 'bool'")
    if kind == "str":
        tests.append(f"WHEN v{i} > 0 AND d{i} / v{i} >= {MIN_DATE_SHARE}D THEN 'datetime'")
    return f"CASE {' '.join(tests)} ELSE '{kind}' END"


def column_types(tables: Tables) -> DataFrame:
    """One row per column: datatype, rows and non-null values. One scan per table, no shuffle of its rows."""
    frames = []
    for table, df in sorted(tables.items()):
        rows = [f"named_struct('table_name', {_text(table)}, 'column_name', {_text(field.name)}, 'ordinal', {i}, "
                f"'datatype', {_type_name(df, i)}, 'nb_rows', n, 'nb_values', v{i})" for i, field in enumerate(df.schema)]
        frames.append(df.selectExpr(*_type_counts(df)).selectExpr(f"inline(array({', '.join(rows)}))"))
    return union_all(frames)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def date_text_share(df: DataFrame, name: str) -> DataFrame:
    """Share of a string column's non-null values that read as dates, and the verdict."""
    column = quoted(name)
    values = F.count(column)
    share = F.count_if(is_date_text(name)) / F.when(values > 0, values)
    return df.agg(values.alias("nb_values"), F.round(share, 4).alias("date_share"),
                  F.coalesce(share >= MIN_DATE_SHARE, F.lit(False)).alias("is_datetime"))


def cast_date_texts(df: DataFrame, date_columns: list[str]) -> DataFrame:
    """Date-like string columns as timestamps; values that are no dates become NULL."""
    wanted = {c for c in date_columns if base_type(df.schema[c].dataType) == "str"}
    if not wanted:
        return df
    return df.select(*[
        parse_datetime(c).alias(c) if c in wanted else quoted(c) for c in df.columns])


# --- value counts and what follows from them ------------------------------------------------------

def cells(tables: Tables, slices: int | None = None) -> DataFrame:
    """attr, family, num, txt: every cell of every column under the key by which equal values meet; with `slices` only the cells of one
    slice of the hash space, without missing ones."""
    frames, attr = [], 0
    for _, df in sorted(tables.items()):
        keyed, drawn = [], []
        for name in df.columns:
            family, num, txt = cell_sql(df, name)
            cell = f"named_struct('attr', {attr}, 'family', {family}, 'num', {num}, 'txt', {txt})"
            if slices is not None:
                drawn.append(in_slice(df, name, slices))
            keyed.append(cell if slices is None else f"CASE WHEN {drawn[-1]} THEN {cell} END")
            attr += 1
        # a few columns per branch: each reads only its own columns, and its code stays small enough to compile
        for start in range(0, len(keyed), COLUMNS_PER_BRANCH):
            stop = start + COLUMNS_PER_BRANCH
            part = f"array({', '.join(keyed[start:stop])})"
            if slices is None:
                frames.append(df.selectExpr(f"inline({part})"))
            else:
                # most rows have no cell in the slice and are not unfolded
                some = df.where(" OR ".join(f"({d})" for d in drawn[start:stop]))
                frames.append(some.selectExpr(f"inline(array_compact({part}))"))
    return union_all(frames)


def value_counts(tables: Tables, slices: int | None = None) -> DataFrame:
    """attr, family, num, txt, cnt: how often each value occurs in each column of each table.

    All columns of all tables go through one aggregation with map-side combine, so a value filling a
    third of a table is one partial count per task. With `slices` only one slice of the hash space is counted,
    without missing cells.
    """
    # every NULL cell falls in one group per column, whatever its family
    missing = F.col("num").isNull() & F.col("txt").isNull()
    return (cells(tables, slices).withColumn("family", F.when(missing, F.lit(-1)).otherwise(F.col("family")).cast("tinyint"))
            .groupBy("attr", "family", "num", "txt").agg(F.count(F.lit(1)).alias("cnt")))


def table_profile(tables: Tables, distinct: dict[str, int] | None = None) -> DataFrame:
    """table_name, nb_entries, nb_columns, nb_duplicated_rows, duplicates_distribution.

    Rows are counted under a 128-bit fingerprint, so no row is shuffled. `distinct` holds the number of rows of tables known to repeat
    none, as where a column is a key: those are not read.
    """
    spark = next(iter(tables.values())).sparkSession
    known = distinct or {}
    prints = [df.select(F.lit(-1 - n).alias("attr"), row_fingerprint(df).alias("print"))
              for n, (t, df) in enumerate(sorted(tables.items())) if t not in known]
    rows = spark.createDataFrame([(-1 - n, known[t], known[t]) for n, t in enumerate(sorted(tables)) if t in known],
                                 "attr int, n long, u long")
    if prints:
        rows = rows.unionByName(union_all(prints).groupBy("attr", "print").agg(F.count(F.lit(1)).alias("cnt")).groupBy("attr").agg(
            F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("u")))
    entries = F.coalesce(F.col("n"), F.lit(0))
    duplicates = entries - F.coalesce(F.col("u"), F.lit(0))
    return tables_frame(spark, tables).join(rows, "attr", "left").select(
        "table_name", entries.alias("nb_entries"), "nb_columns", duplicates.alias("nb_duplicated_rows"),
        F.when(entries > 0, F.round(duplicates / entries, 4)).otherwise(F.lit(0.0))
        .alias("duplicates_distribution"))


@dataclass
class Scanned:
    """What one scan of a table tells of its columns."""

    types: dict[str, str | None]
    evidence: dict[str, Evidence]
    rows: int
    values: dict[str, int]


def scan_columns(df: DataFrame) -> Scanned:
    """Types and evidence of all columns: an aggregate for every few columns, which reads those alone.

    The code of one aggregate over a wide table is too long for the JVM's compiler and runs interpreted.
    """
    def scan(names: list[str]) -> Scanned:
        part = df.select(*[quoted(c) for c in names])
        counted = with_buckets(part).selectExpr(*_type_counts(part), *evidence_counts(part))
        row = counted.selectExpr("*", *[f"{_type_name(part, i)} AS t{i}" for i in range(len(names))]).first()
        return Scanned({f.name: row[f"t{i}"] for i, f in enumerate(part.schema)}, read_evidence(part, row), int(row["n"]),
                       {f.name: int(row[f"v{i}"]) for i, f in enumerate(part.schema)})

    # a table without columns has rows all the same
    found = each([df.columns[i:i + COLUMNS_PER_SCAN] for i in range(0, max(len(df.columns), 1), COLUMNS_PER_SCAN)], scan)
    return Scanned({c: t for s in found for c, t in s.types.items()}, {c: e for s in found for c, e in s.evidence.items()},
                   found[0].rows, {c: n for s in found for c, n in s.values.items()})


def _distinct(tables: Tables, wanted: dict[str, list[str]], slices: int | None = None) -> dict[tuple[str, str], tuple[int, int]]:
    """(different values, greatest count of one) of the wanted columns, a missing value being one more; one row per column
    reaches the driver."""
    subset = {t: tables[t].select(*[quoted(c) for c in names]) for t, names in wanted.items() if names}
    if not subset:
        return {}
    places = [(t, c) for t, df in sorted(subset.items()) for c in df.columns]
    found = value_counts(subset, slices).groupBy("attr").agg(
        F.count(F.lit(1)).alias("u"), F.max("cnt").alias("most")).collect()
    return {places[r["attr"]]: (int(r["u"]), int(r["most"])) for r in found}


def _row_bytes(df: DataFrame, names: list[str]) -> int:
    """How wide a row of these columns can be: a scan of the texts among them."""
    texts = [c for c in names if base_type(df.schema[c].dataType) not in ("int", "float", "bool")]
    longest = df.agg(*[F.max(F.octet_length(label_text(df, c))).alias(f"w{i}") for i, c in enumerate(texts)]).first() if texts else ()
    return 8 * len(names) + sum(n or 0 for n in longest)


def column_profile(tables: Tables, types: dict[str, dict[str, str | None]], scans: dict[str, Scanned],
                   exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(columns, categories): type, distinct values (NULL is one), nulls, key and category flags of each column, and the categories
    of those that have few.

    `scans` hold what is known of the tables as they are now, `types` the types they had before date strings were cast. With `exact` the
    number of distinct values is known for all columns; without, only where a flag had to be settled by counting.
    """
    spark = next(iter(tables.values())).sparkSession
    evidence = {(t, c): e for t, scan in scans.items() for c, e in scan.evidence.items()}

    def of(test) -> dict[str, list[str]]:
        return {t: [c for c in df.columns if (t, c) in evidence and test((t, c))] for t, df in tables.items()}

    maybe_few = of(lambda k: evidence[k].may_be_few(MAX_CATEGORIES))
    with narrow_rows(spark, max(each(sorted(maybe_few), lambda t: _row_bytes(tables[t], maybe_few[t])), default=0)):
        categories = materialize(category_distribution(tables, maybe_few), "categories")
    labels = {(r["table_name"], r["column_name"]): int(r["n"]) for r in categories.groupBy(
        "table_name", "column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    unique = {(t, c): labels.get((t, c), 0) + int(evidence[t, c].nulls > 0) for t, names in maybe_few.items() for c in names}
    if exact:
        rest = of(lambda k: k not in unique)
        unique.update({k: u for k, (u, _) in _distinct(tables, rest).items()})
    else:
        maybe_key = of(lambda k: k not in unique and evidence[k].may_be_key)
        repeated = {k for k, (_, most) in _distinct(tables, maybe_key, SLICES).items() if most > 1}
        rest = of(lambda k: k not in unique and evidence[k].may_be_key and k not in repeated)
        unique.update({k: u for k, (u, _) in _distinct(tables, rest).items()})

    rows = []
    for t, df in sorted(tables.items()):
        for ordinal, c in enumerate(df.columns):
            scan, known = scans[t], unique.get((t, c))
            nulls = scan.rows - scan.values[c]
            rows.append((t, c, ordinal, types[t][c], known, nulls > 0, nulls, known is not None and known == scan.rows,
                         known is not None and known <= MAX_CATEGORIES))
    columns = spark.createDataFrame(
        rows, "table_name string, column_name string, ordinal int, datatype string, nb_unique long, null_values boolean, "
              "nb_nulls long, potential_primary_key boolean, is_categorical boolean")
    few = [(t, c) for t, c, *_, is_few in rows if is_few]
    return columns, categories.join(F.broadcast(spark.createDataFrame(few, "table_name string, column_name string")),
                                    ["table_name", "column_name"], "left_semi")


def null_profile(tables: Tables) -> DataFrame:
    """table_name, column_name, nb_nulls, null_values — a scan, no shuffle of rows."""
    frames = []
    for table, df in sorted(tables.items()):
        counted = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"v{i}") for i, c in enumerate(df.columns)])
        frames.append(counted.select(F.inline(F.array(*[
            F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                     F.col(f"v{i}").alias("nb_nulls"), (F.col(f"v{i}") > 0).alias("null_values"))
            for i, c in enumerate(df.columns)]))))
    return union_all(frames)


# --- categories and string distribution -----------------------------------------------------------

def label_text(df: DataFrame, name: str) -> Column:
    """A category as text; negative zero reads as zero."""
    column = quoted(name)
    if base_type(df.schema[name].dataType) == "float":
        return (column + F.lit(0).cast(df.schema[name].dataType)).cast("string")
    return column.cast("string")


#: Labels of a column that a task holds before it hands them on.
HELD_LABELS = 10_000


def _label_counts(table: str, df: DataFrame, names: list[str]) -> DataFrame:
    """Counts per task of the labels of some columns: a task holds a bounded set of labels per column and hands on a row per label.

    Numbers are counted as they are stored; only their counts are turned into text.
    """
    def value(name: str) -> Column:
        kind = df.schema[name].dataType
        if base_type(kind) == "float":
            return quoted(name) + F.lit(0).cast(kind)
        return quoted(name) if base_type(kind) in ("int", "bool") else label_text(df, name)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = [{} for _ in names]
        types: list[pa.DataType] = []

        def rows(i: int) -> pa.RecordBatch:
            own, held[i] = held[i], {}
            columns = [pa.array(list(own), t) if j == i else pa.nulls(len(own), t) for j, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(
                [pa.array([i] * len(own), pa.int32()), *columns, pa.array(list(own.values()), pa.int64())],
                names=["place", *[f"c{j}" for j in range(len(names))], "cnt"])

        for batch in batches:
            types = [c.type for c in batch.columns]
            for i, own in enumerate(held):
                for entry in batch.column(i).drop_null().value_counts().to_pylist():
                    own[entry["values"]] = own.get(entry["values"], 0) + entry["counts"]
                if len(own) > HELD_LABELS:
                    yield rows(i)
        for i in range(len(types)):
            yield rows(i)

    labels = df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(names)])
    counted = labels.mapInArrow(count, T.StructType([
        T.StructField("place", T.IntegerType()), *[T.StructField(f.name, f.dataType) for f in labels.schema],
        T.StructField("cnt", T.LongType())]))
    # each row has one label
    return counted.select(F.lit(table).alias("table_name"), F.element_at(F.array(*[F.lit(c) for c in names]), F.col("place") + 1)
                          .alias("column_name"), F.coalesce(*[F.col(f"c{i}").cast("string") for i in range(len(names))])
                          .alias("category"), "cnt")


def category_distribution(tables: Tables, categorical: dict[str, list[str]]) -> DataFrame:
    """table_name, column_name, category, cnt, share among non-null rows, for the named columns.

    The columns hold at most 100 values each, so a task sends at most so many counts a column and no cell is shuffled.
    """
    spark = next(iter(tables.values())).sparkSession
    frames = [_label_counts(t, tables[t], names) for t, names in sorted(categorical.items()) if names]
    if not frames:
        return spark.createDataFrame(
            [], "table_name string, column_name string, category string, cnt long, share double")
    found = union_all(frames).groupBy("table_name", "column_name", "category").agg(F.sum("cnt").alias("cnt"))
    # a window, not a join, which would count every column twice
    total = F.sum("cnt").over(Window.partitionBy("table_name", "column_name"))
    return found.select("table_name", "column_name", "category", "cnt", (F.col("cnt") / total).alias("share"))


def string_distribution(tables: Tables) -> DataFrame:
    """count, unique, top and freq of every string column; the smallest value wins a tie for top.

    Counting runs on short keys, which for a long string begin with its first characters. Of the most frequent keys only those with
    the smallest beginning can be the top, and only rows that begin so are looked at again for the whole text.
    """
    spark = next(iter(tables.values())).sparkSession
    text = {t: [f.name for f in df.schema if base_type(f.dataType) == "str"] for t, df in tables.items()}
    text = {t: names for t, names in text.items() if names}
    subset = {t: tables[t].select(*[quoted(c) for c in names]) for t, names in text.items()}
    attributes = columns_frame(spark, subset).select("attr", "table_name", "column_name")
    filled = materialize(value_counts(subset).filter("family >= 0"), "texts")
    stats = filled.groupBy("attr").agg(
        F.sum("cnt").alias("count"), F.count(F.lit(1)).alias("unique"), F.max("cnt").alias("freq"))
    # one row per column: schema-sized
    stats = materialize(stats, "text-stats")
    most = filled.join(F.broadcast(stats.select("attr", F.col("freq").alias("cnt"))), ["attr", "cnt"])
    beginning = F.substring("txt", 1, KEY_PREFIX)
    ends = materialize(most.groupBy("attr").agg(
        F.min(F.when(F.col("family") == SHORT_TEXT, F.col("txt"))).alias("short"),
        F.min(F.when(F.col("family") == LONG_TEXT, beginning)).alias("beginning")), "text-tops")
    first = ends.select("attr", "beginning")
    long = most.filter(F.col("family") == LONG_TEXT).withColumn("beginning", beginning).join(
        F.broadcast(first), ["attr", "beginning"]).select("attr", "txt")

    texts, attr = [], 0
    for table, names in sorted(text.items()):
        keyed = []
        for c in names:
            family, _, txt = cell_key(subset[table], c)
            keyed.append(F.struct(F.lit(attr).alias("attr"), family.alias("family"), txt.alias("txt"), quoted(c).alias("value"),
                                  F.substring(quoted(c), 1, KEY_PREFIX).alias("beginning")))
            attr += 1
        texts.append(subset[table].select(F.inline(F.array(*keyed))).filter(F.col("family") == LONG_TEXT))
    whole = union_all(texts).join(F.broadcast(first), ["attr", "beginning"]).join(long, ["attr", "txt"], "left_semi")
    whole = whole.groupBy("attr").agg(F.min("value").alias("long"))
    return (
        attributes.join(stats, "attr", "left").join(ends, "attr", "left").join(whole, "attr", "left")
        .select("table_name", "column_name", F.coalesce("count", F.lit(0)).alias("count"),
                F.coalesce("unique", F.lit(0)).alias("unique"), F.least("short", "long").alias("top"),
                F.col("freq")))


# --- numeric and datetime distribution ------------------------------------------------------------

def _distribution(table: str, df: DataFrame, columns: list[str], mean, spread: bool) -> list[tuple]:
    """(table, column, stat, value) of all columns: one scan for counts and ends, then radix selection."""
    values = {c: ordered(df, c) for c in columns}
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(values[c]).alias(f"n{i}"), mean(c).alias(f"m{i}"), F.min(values[c]).alias(f"l{i}"), F.max(values[c]).alias(f"h{i}")]
        if spread:
            aggs.append(F.stddev_samp(as_double(df, c)).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    spans = {c: Span(row[f"l{i}"], row[f"h{i}"], int(row[f"n{i}"])) for i, c in enumerate(columns)}
    at = values_at_ranks(df, values, {c: ranks_of(PERCENTILES, spans[c].count) for c in columns}, spans)
    rows = []
    for i, c in enumerate(columns):
        span = spans[c]
        stats = [("count", float(span.count)), ("mean", None if row[f"m{i}"] is None else float(row[f"m{i}"]))]
        stats += [("std", row[f"s{i}"])] if spread else []
        stats += [("min", span.low)] + [(n, interpolated(p, span.count, at[c])) for n, p in zip(PERCENTILE_NAMES, PERCENTILES)]
        rows += [(table, c, stat, None if value is None else float(value)) for stat, value in stats + [("max", span.high)]]
    return rows


def numeric_distribution(table: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """Long rows (stat, value): count, mean, std, min, percentiles, max of numeric columns."""
    rows = _distribution(table, df, columns, lambda c: F.avg(as_double(df, c)), True)
    return df.sparkSession.createDataFrame(
        rows, "table_name string, column_name string, stat string, value double").withColumn("value", F.round("value", 4))


def datetime_distribution(table: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """Long rows (stat, value as text): count, mean, min, percentiles, max of time columns."""
    # whole microseconds are summed as decimals, which a double sum would round
    rows = _distribution(table, df, columns, lambda c: F.floor(F.avg(epoch_micros(quoted(c)).cast("decimal(20,0)"))), False)
    found = df.sparkSession.createDataFrame(rows, "table_name string, column_name string, stat string, number double")
    number = F.round("number").cast("bigint")
    shown = F.when(F.col("stat") == "count", number.cast("string")).otherwise(
        F.date_format(F.timestamp_micros(number), TIME_FORMAT))
    return found.select("table_name", "column_name", "stat", shown.alias("value"))
