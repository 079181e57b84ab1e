"""Associations between the columns of one table."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_double, numeric_columns
from plumbline.functions.moments import gram
from plumbline.operators.table_profile import category_distribution, label_text
from plumbline.session import materialize, narrow_rows

_CORRELATION = "table_name string, col_a string, col_b string, r double"
_CRAMER = "table_name string, col_a string, col_b string, v double"
_RATIO = "table_name string, categorical string, numerical string, eta double"

#: Labels of a column, in the order of their codes.
Labels = dict[str, list[str]]


def correlations(table: str, df: DataFrame) -> DataFrame:
    """Pearson's r of every pair of numeric columns, undefined pairs left out."""
    names, spark = numeric_columns(df), df.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], _CORRELATION)
    r = gram(df, {c: as_double(df, c) for c in names}).correlation()
    rows = [(table, names[i], names[j], float(r[i, j])) for i, j in combinations(range(len(names)), 2) if not np.isnan(r[i, j])]
    return spark.createDataFrame(rows, _CORRELATION).withColumn("r", F.round("r", 4))


def labels_of(table: str, df: DataFrame, categorical: list[str]) -> Labels:
    """The labels of each column, at most 100 a column."""
    return read_labels(category_distribution({table: df}, {table: categorical})).get(table, {c: [] for c in categorical})


def read_labels(categories: DataFrame) -> dict[str, Labels]:
    """By table and column, from a frame of categories: schema-sized, since a column has at most 100."""
    found: dict[str, Labels] = {}
    for r in categories.select("table_name", "column_name", "category").collect():
        found.setdefault(r["table_name"], {}).setdefault(r["column_name"], []).append(r["category"])
    return {t: {c: sorted(labels) for c, labels in columns.items()} for t, columns in found.items()}


def _codes(column: pa.Array, labels: list[str]) -> np.ndarray:
    """The place of each label, -1 where missing."""
    return pc.fill_null(pc.index_in(column, pa.array(labels, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _width(known: list[list[str]]) -> int:
    """Bytes of the longest labels of all columns."""
    return sum(max((len(label.encode()) for label in labels), default=0) for labels in known)


def cramers_v(table: str, df: DataFrame, categorical: list[str], labels: Labels | None = None) -> DataFrame:
    """Cramér's V of every pair of categorical columns, 0 when a side has a single category.

    A row is coded once per column. Each task adds up the contingency tables of all pairs, at most 100 x 100 numbers a pair, and sends
    the cells that are not empty; those add up to the tables of the whole.
    """
    spark, pairs = df.sparkSession, list(combinations(range(len(categorical)), 2))
    if not pairs:
        return spark.createDataFrame([], _CRAMER)
    labels = labels_of(table, df, categorical) if labels is None else labels
    known = [labels.get(c, []) for c in categorical]
    schema = pa.schema([("pair", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(known[i]) * len(known[j]), np.int64) for i, j in pairs]
        for batch in batches:
            codes = [_codes(column, own) for column, own in zip(batch.columns, known)]
            for table_of, (i, j) in zip(total, pairs):
                cell = codes[i] * len(known[j]) + codes[j]
                table_of += np.bincount(cell[(codes[i] >= 0) & (codes[j] >= 0)], minlength=len(table_of))
        for number, (table_of, (_, j)) in enumerate(zip(total, pairs)):
            at = np.flatnonzero(table_of)
            if len(at):
                a, b = np.divmod(at, len(known[j]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), number, np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                    pa.array(table_of[at])], schema=schema)

    coded = df.select(*[label_text(df, c).alias(f"c{i}") for i, c in enumerate(categorical)])
    # at most 100 x 100 rows a pair, written once: both sides' sums come from them
    with narrow_rows(spark, _width(known)):
        cells = materialize(coded.mapInArrow(add_up, "pair int, a int, b int, n long").groupBy("pair", "a", "b").agg(
            F.sum("n").alias("n")), "contingency")
    sides = cells.groupBy("pair", "a").agg(F.sum("n").alias("n_a")), cells.groupBy("pair", "b").agg(F.sum("n").alias("n_b"))
    phi = (
        cells.join(sides[0], ["pair", "a"]).join(sides[1], ["pair", "b"])
        .groupBy("pair").agg(
            (F.sum(F.col("n") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))) - 1).alias("phi2"),
            F.countDistinct("a").alias("r"), F.countDistinct("b").alias("c")))
    names = spark.createDataFrame(
        [(n, categorical[i], categorical[j]) for n, (i, j) in enumerate(pairs)], "pair int, col_a string, col_b string")
    side = F.least("r", "c") - 1
    value = F.when(side >= 1, F.sqrt(F.greatest(F.col("phi2"), F.lit(0.0)) / side)).otherwise(F.lit(0.0))
    return names.join(phi, "pair", "left").select(
        F.lit(table).alias("table_name"), "col_a", "col_b",
        F.round(F.coalesce(value, F.lit(0.0)), 4).alias("v"))


def _ratio_parts(codes: np.ndarray, n_labels: int, x: np.ndarray) -> np.ndarray:
    """Number, sum and sum of squares of x by label."""
    there = (codes >= 0) & ~np.isnan(x)
    code, value = codes[there], x[there]
    return np.stack([np.bincount(code, w, n_labels) for w in (None, value, value * value)]).astype(np.float64)


def correlation_ratio(table: str, df: DataFrame, categorical: list[str], numerical: list[str],
                      labels: Labels | None = None) -> DataFrame:
    """Correlation ratio of each (categorical, numerical) pair of different columns.

    One scan for the means, one for all pairs: each task adds up number, sum and sum of squares of every numeric column, relative to
    its mean, by label. Both sums of squares follow from those.
    """
    spark = df.sparkSession
    pairs = [(i, j) for i, c in enumerate(categorical) for j, n in enumerate(numerical) if c != n]
    if not pairs:
        return spark.createDataFrame([], _RATIO)
    labels = labels_of(table, df, categorical) if labels is None else labels
    known = [labels.get(c, []) for c in categorical]
    means = df.agg(*[F.avg(_finite(as_double(df, n))).alias(f"m{j}") for j, n in enumerate(numerical)]).first()
    kept = df.select(
        *[label_text(df, c).alias(f"c{i}") for i, c in enumerate(categorical)],
        *[(_finite(as_double(df, n)) - F.lit(means[f"m{j}"] or 0.0)).alias(f"x{j}") for j, n in enumerate(numerical)])
    schema = pa.schema([("pair", pa.int32()), ("label", pa.int32()), *[(p, pa.float64()) for p in "nsq"]])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((3, len(known[i]))) for i, _ in pairs]
        for batch in batches:
            codes = [_codes(column, own) for column, own in zip(batch.columns, known)]
            xs = [column.to_numpy(zero_copy_only=False).astype(np.float64) for column in batch.columns[len(known):]]
            for part, (i, j) in zip(total, pairs):
                part += _ratio_parts(codes[i], len(known[i]), xs[j])
        for number, part in enumerate(total):
            at = np.flatnonzero(part[0])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), pa.array(at.astype(np.int32)),
                                                  *[pa.array(p[at]) for p in part]], schema=schema)

    # at most 100 rows a pair, written once; a label's values vary by what their squares exceed the square of their sum
    with narrow_rows(spark, _width(known) + 8 * len(numerical)):
        cells = materialize(kept.mapInArrow(add_up, "pair int, label int, n double, s double, q double").groupBy("pair", "label").agg(
            *[F.sum(p).alias(p) for p in "nsq"]), "ratio-parts")
    totals = cells.groupBy("pair").agg((F.sum("s") / F.sum("n")).alias("mean"))
    within = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
    squares = cells.join(totals, "pair").groupBy("pair").agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("mean"), 2)).alias("between"), F.sum(within).alias("within"))
    names = spark.createDataFrame(
        [(k, categorical[i], numerical[j]) for k, (i, j) in enumerate(pairs)], "pair int, categorical string, numerical string")
    between, total = F.col("between"), F.col("between") + F.col("within")
    eta = F.when(between > 0, F.sqrt(between / total)).otherwise(F.lit(0.0))
    return names.join(squares, "pair", "left").select(
        F.lit(table).alias("table_name"), "categorical", "numerical",
        F.round(F.coalesce(eta, F.lit(0.0)), 4).alias("eta"))


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
