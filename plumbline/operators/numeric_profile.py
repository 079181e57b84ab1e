"""Numerical profile of one table: disguised missing values, principal components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_double, quoted
from plumbline.functions.moments import gram
from plumbline.functions.percentiles import Span, interpolated, ordered, ranks_of, values_at_ranks
from plumbline.operators.table_profile import union_all

# Fixed values of the numerical profile.
MIN_FREQUENCY = 0.01
FENCE_MULTIPLIER = 10
VARIANCE_KEPT = 0.95
MIN_LOADING = 0.3

ROWS = "table_name string, nb_numerical int, nb_entries_profiled long, nb_entries_dropped long"

_BUCKETS = 4096
_SUSPECTS = "table_name string, column_name string, value double, frequency double, gap_to_fence_iqr double"


# --- disguised missing values -----------------------------------------------------------------------

def frequent_values(df: DataFrame, columns: list[str], share: float = MIN_FREQUENCY) -> DataFrame:
    """column_name, value, cnt: each column's most frequent value if it fills more than `share` of rows.

    A value cannot be more frequent than the hash bucket it falls in. Bucket counts, a few thousand per
    column, therefore rule out nearly every value before any value is shuffled.
    """
    rows = df.count()

    def counted(name: str, key: str, kept: list[int] | None = None) -> DataFrame:
        # a column by itself: its scan reads nothing else, and its cells meet by number without its name
        value = as_double(df, name)
        cells = df.select(value.alias("value"), F.pmod(F.xxhash64(value), F.lit(_BUCKETS)).alias("bucket")).filter("value IS NOT NULL")
        if kept is not None:
            cells = cells.filter(F.col("bucket").isin(kept))
        return cells.groupBy(key).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(name).alias("column_name"), key, "cnt")

    # at most 1 / share buckets per column can pass, so few rows reach the driver
    heavy: dict[str, list[int]] = {}
    for r in union_all([counted(c, "bucket") for c in columns]).filter(F.col("cnt") > share * rows).collect():
        heavy.setdefault(r["column_name"], []).append(r["bucket"])
    if not heavy:
        return df.sparkSession.createDataFrame([], "column_name string, value double, cnt long, frequency double")
    found = union_all([counted(c, "value", sorted(kept)) for c, kept in sorted(heavy.items())])
    top = F.min_by(F.struct("value", "cnt"), F.struct(-F.col("cnt"), F.col("value")))
    return (found.groupBy("column_name").agg(top.alias("top")).select("column_name", "top.*")
            .filter(F.col("cnt") > share * rows).withColumn("frequency", F.col("cnt") / F.lit(max(rows, 1))))


def disguised_missing(table: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """Placeholders: the most frequent value, above 1 % of rows, far outside the fences of the others."""
    spark = df.sparkSession
    tops = {r["column_name"]: r for r in frequent_values(df, columns).collect()} if columns else {}
    if not tops:
        return spark.createDataFrame([], _SUSPECTS)
    others = {c: F.when(as_double(df, c) != F.lit(r["value"]), ordered(df, c)) for c, r in tops.items()}
    row = df.agg(*[a for i, v in enumerate(others.values()) for a in (
        F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"), F.count(v).alias(f"n{i}"))]).first()
    spans = {c: Span(row[f"l{i}"], row[f"h{i}"], int(row[f"n{i}"])) for i, c in enumerate(others)}
    at = values_at_ranks(df, others, {c: ranks_of([0.25, 0.75], spans[c].count) for c in others}, spans)
    found = []
    for c, r in tops.items():
        first, third = (interpolated(share, spans[c].count, at[c]) for share in (0.25, 0.75))
        value = float(r["value"])
        if first is None or third == first:
            continue
        iqr = third - first
        low, high = first - FENCE_MULTIPLIER * iqr, third + FENCE_MULTIPLIER * iqr
        gap = value - high if value > high else low - value if value < low else None
        if gap is not None:
            found.append((table, c, value, float(r["frequency"]), gap / iqr))
    return spark.createDataFrame(found, _SUSPECTS).withColumn("frequency", F.round("frequency", 4)).withColumn(
        "gap_to_fence_iqr", F.round("gap_to_fence_iqr", 2))


def without_placeholders(df: DataFrame, suspects: list) -> DataFrame:
    """Rows holding a disguised missing value removed; NULLs stay."""
    for row in suspects:
        df = df.filter(~as_double(df, row["column_name"]).eqNullSafe(F.lit(row["value"])))
    return df


def row_counts(table: str, df: DataFrame, columns: list[str], suspects: list) -> DataFrame:
    """How many rows the component and cluster profiles rest on, and how many were dropped.

    A table with fewer than two numeric columns has no such profile: its row only tells how many there are.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([(table, len(columns), None, None)], ROWS)
    clean = F.lit(True)
    for row in suspects:
        clean = clean & ~as_double(df, row["column_name"]).eqNullSafe(F.lit(row["value"]))
    for c in columns:
        clean = clean & quoted(c).isNotNull()
    return df.agg(F.count_if(clean).alias("nb_entries_profiled"),
                  F.count_if(~clean).alias("nb_entries_dropped")).select(
        F.lit(table).alias("table_name"), F.lit(len(columns)).alias("nb_numerical"), "nb_entries_profiled", "nb_entries_dropped")


# --- principal components -----------------------------------------------------------------------------

@dataclass
class Components:
    """Components and loadings, the columns that drive them, and all eigenvalues of the correlation matrix."""

    components: DataFrame
    loadings: DataFrame
    main_columns: list[str]
    eigenvalues: list[float]


def principal_components(table: str, df: DataFrame, columns: list[str]) -> Components:
    """PCA of the standardised complete rows.

    Two scans give the correlation matrix; its eigenvalues (k x k, k columns) are found on the driver.
    """
    spark = df.sparkSession
    complete = df.select(*[as_double(df, c).alias(c) for c in columns]).dropna()
    schema = ("table_name string, component int, variance_explained double, cumulative_variance double, "
              "dimension_kept boolean")
    loading_schema = "table_name string, component int, column_name string, loading double"
    sums = gram(complete, {c: quoted(c) for c in columns})
    n, k = int(sums.rows[0, 0]) if columns else 0, len(columns)
    if n < 2:
        return Components(spark.createDataFrame([], schema), spark.createDataFrame([], loading_schema), [], [])
    matrix = np.nan_to_num(sums.correlation())
    np.fill_diagonal(matrix, (np.diag(sums.low) < np.diag(sums.high)).astype(float))
    found, vectors = np.linalg.eigh(matrix)
    everything = found
    order = np.argsort(found)[::-1][:min(n, k)]
    found, vectors = np.maximum(found[order], 0.0), vectors[:, order]
    # the largest weight of each component is made positive
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    vectors = vectors * np.where(signs == 0, 1, signs)
    total = np.trace(matrix)
    shares = found / total if total > 0 else np.full(len(found), np.nan)
    reached = np.cumsum(shares)
    kept = int(np.argmax(reached >= VARIANCE_KEPT)) + 1
    loadings = vectors * np.sqrt(found * n / (n - 1))

    def number(x: float) -> float | None:
        return None if np.isnan(x) else round(float(x), 4)

    rows = [(table, i + 1, number(shares[i]), number(reached[i]), i < kept) for i in range(len(found))]
    weights = [(table, i + 1, c, number(loadings[j, i])) for i in range(kept) for j, c in enumerate(columns)
               if abs(loadings[j, i]) >= MIN_LOADING]
    main = list(dict.fromkeys(c for _, _, c, _ in weights))
    return Components(spark.createDataFrame(rows, schema), spark.createDataFrame(weights, loading_schema), main, [float(x) for x in everything])
