"""Profile of a whole dataset: types, then counts, then keys, then what depends on keys."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import numeric_columns, quoted
from plumbline.operators import association, keys, numeric_profile
from plumbline.operators.clusters import clusters as find_clusters
from plumbline.operators import table_profile as tp
from plumbline.operators.profile_store import Frames
from plumbline.session import each, materialize

# Fixed value: decimals kept when a profile is saved.
DECIMALS = 4

PROFILE_FRAMES = (
    "profile_table", "profile_column", "profile_category", "profile_distribution", "profile_text",
    "profile_correlation", "profile_cramers_v", "profile_corr_ratio", "profile_fk", "profile_dmv",
    "profile_pca", "profile_pca_loading", "profile_main_columns", "profile_kmeans", "profile_kmeans_score", "profile_best_k",
    "profile_rows",
)

_EMPTY = {
    "profile_distribution": "table_name string, column_name string, stat string, value double",
    "profile_text": "table_name string, column_name string, stat string, value string",
    "profile_correlation": "table_name string, col_a string, col_b string, r double",
    "profile_cramers_v": "table_name string, col_a string, col_b string, v double",
    "profile_corr_ratio": "table_name string, categorical string, numerical string, eta double",
    "profile_fk": "child_table string, child_column string, parent_table string, parent_column string, "
                  "coverage double",
    "profile_dmv": "table_name string, column_name string, value double, frequency double, "
                   "gap_to_fence_iqr double",
    "profile_pca": "table_name string, component int, variance_explained double, cumulative_variance double, "
                   "dimension_kept boolean",
    "profile_pca_loading": "table_name string, component int, column_name string, loading double",
    "profile_kmeans": "table_name string, cluster int, share double, column_name string, centroid double",
    "profile_kmeans_score": "table_name string, k int, score double",
    "profile_rows": numeric_profile.ROWS,
    "profile_main_columns": "table_name string, column_name string, place int",
    "profile_best_k": "table_name string, best_k int, best_score double",
}


def _gather(spark: SparkSession, name: str, frames: list[DataFrame]) -> DataFrame:
    return tp.union_all(frames) if frames else spark.createDataFrame([], _EMPTY[name])


class Columns(NamedTuple):
    """Tables with date strings cast, the column profile, and the categories of the columns that have few."""

    typed: tp.Tables
    columns: DataFrame
    categories: DataFrame
    rows: dict[str, int]


def profile_columns(tables: tp.Tables, exact: bool = True) -> Columns:
    """Column profile of a set of tables. Without `exact`, distinct values are only counted where a flag depends on it."""
    names = sorted(tables)
    scans = dict(zip(names, each(names, lambda t: tp.scan_columns(tables[t]))))
    types = {t: scan.types for t, scan in scans.items()}
    dates = {t: [c for c, kind in types[t].items() if kind == "datetime"] for t in names}
    typed = {t: tp.cast_date_texts(tables[t], dates[t]) for t in names}
    # values that are no dates became NULL, which counts as missing from here on
    again = [t for t in names if typed[t] is not tables[t]]
    scans.update(zip(again, each(again, lambda t: tp.scan_columns(typed[t]))))
    columns, categories = tp.column_profile(typed, types, scans, exact)
    return Columns(typed, columns, categories, {t: scan.rows for t, scan in scans.items()})


def profile_dataset(tables: tp.Tables, test: tp.Tables | None = None, views: tuple[str, ...] = (),
                    numeric: bool = True, clusters: bool = True, key: str | None = None,
                    parts: set[str] | None = None) -> Frames:
    """The wanted profile frames of a set of tables, all by default.

    `test` holds the other side of the split: keys are looked up over both. Tables named in `views` are
    profiled but take no part in foreign keys. `key` names a row identity column to leave out. Where only some `parts` are wanted,
    duplicate rows are counted for `profile_table` alone, and distinct values only where a flag depends on them.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = {name: df for name, df in tables.items()}
    if key is not None:
        tables = {name: df.drop(key) for name, df in tables.items()}
    typed, columns, found_categories, nb_rows = profile_columns(tables, exact=parts is None)
    details: dict[str, dict] = {}
    for row in columns.orderBy("table_name", "ordinal").collect():
        details.setdefault(row["table_name"], {})[row["column_name"]] = row
    if parts is None or "profile_table" in parts:
        # a key tells all rows apart
        table_frame = tp.table_profile(typed, {
            t: nb_rows[t] for t in typed if any(r["potential_primary_key"] for r in details.get(t, {}).values())})
    else:
        table_frame = spark.createDataFrame(
            [(t, nb_rows[t], len(df.columns), None, None) for t, df in sorted(typed.items())],
            "table_name string, nb_entries long, nb_columns int, nb_duplicated_rows long, duplicates_distribution double")
    frames: Frames = {"profile_table": table_frame, "profile_column": columns}

    def wanted(name: str) -> bool:
        return parts is None or name in parts

    def names(table: str, test) -> list[str]:
        return [c for c, row in details[table].items() if test(row)]

    categorical = {t: names(t, lambda r: r["is_categorical"] and not r["potential_primary_key"]) for t in tables}
    labels = association.read_labels(found_categories) if numeric or wanted("profile_cramers_v") else {}
    if wanted("profile_category"):
        frames["profile_category"] = found_categories
    if wanted("profile_distribution"):
        stored = [(t, numeric_columns(df)) for t, df in sorted(typed.items()) if numeric_columns(df)]
        frames["profile_distribution"] = _gather(spark, "profile_distribution", each(
            stored, lambda s: tp.numeric_distribution(s[0], typed[s[0]], s[1])))
    if wanted("profile_text"):
        times = {t: [f.name for f in df.schema if tp.base_type(f.dataType) == "datetime"] for t, df in typed.items()}
        texts = each([s for s in sorted(times.items()) if s[1]],
                     lambda s: tp.datetime_distribution(s[0], typed[s[0]], s[1]))
        strings = {t: df for t, df in typed.items() if any(tp.base_type(f.dataType) == "str" for f in df.schema)}
        if strings:
            texts.append(tp.string_distribution(strings).select("table_name", "column_name", F.inline(F.array(*[
                F.struct(F.lit(stat).alias("stat"), F.col(stat).cast("string").alias("value"))
                for stat in ("count", "unique", "top", "freq")]))))
        frames["profile_text"] = _gather(spark, "profile_text", texts)
    if wanted("profile_correlation"):
        paired = [t for t, df in sorted(typed.items()) if len(numeric_columns(df)) > 1]
        frames["profile_correlation"] = _gather(spark, "profile_correlation", each(
            paired, lambda t: association.correlations(t, typed[t])))
    if wanted("profile_cramers_v"):
        frames["profile_cramers_v"] = _gather(spark, "profile_cramers_v", each(
            [t for t in sorted(typed) if len(categorical[t]) > 1],
            lambda t: association.cramers_v(t, typed[t], categorical[t], labels.get(t, {}))))
    if numeric or wanted("profile_fk"):
        linked = {t: df for t, df in tables.items() if t not in views}
        if test is not None:
            linked = {t: df.unionByName(test[t].select(*df.columns)) if t in test else df
                      for t, df in linked.items()}
        own = columns.filter(~F.col("table_name").isin(*views)) if views else columns
        # categories of the tables as they are looked up: not those of clean rows alone, nor of cast dates
        known = found_categories if test is None and all(typed[t] is tables[t] for t in linked) else None
        links = materialize(keys.discover(linked, own, categories=known), "links")
        frames["profile_fk"] = links
        if numeric:
            plain = {t: own for t, own in labels.items() if typed[t] is tables[t]}
            frames.update(_numeric_frames(spark, tables, rows, columns, links, categorical, plain, clusters))
    return frames


def _numeric_frames(spark: SparkSession, tables: tp.Tables, rows: tp.Tables, columns: DataFrame,
                    links: DataFrame, categorical: dict[str, list[str]], labels: dict[str, association.Labels],
                    with_clusters: bool) -> Frames:
    """What runs on numeric columns once it is known which keys other tables point at.

    `labels` hold the labels of tables whose date strings needed no cast; those of others are looked up as they stand.
    """
    numerical: dict[str, list[str]] = {}
    for row in keys.numerical_columns(columns, links).orderBy("table_name", "ordinal").collect():
        numerical.setdefault(row["table_name"], []).append(row["column_name"])

    def profile(t: str) -> dict[str, DataFrame]:
        df, own, found = tables[t], numerical.get(t, []), {}
        if categorical[t] and own:
            found["profile_corr_ratio"] = association.correlation_ratio(t, df, categorical[t], own, labels.get(t))
        # a single numeric column has nothing to be profiled against: only their number is told
        if len(own) < 2:
            found["profile_rows"] = numeric_profile.row_counts(t, df, own, [])
            return found
        suspects = numeric_profile.disguised_missing(t, df, own)
        placeholders = suspects.collect()
        clean = numeric_profile.without_placeholders(rows[t], placeholders)
        found["profile_dmv"] = spark.createDataFrame(placeholders, suspects.schema)
        found["profile_rows"] = numeric_profile.row_counts(t, df, own, placeholders)
        pca = numeric_profile.principal_components(t, clean, own)
        found["profile_pca"], found["profile_pca_loading"] = pca.components, pca.loadings
        found["profile_main_columns"] = spark.createDataFrame(
            [(t, c, place + 1) for place, c in enumerate(pca.main_columns)], _EMPTY["profile_main_columns"])
        if with_clusters:
            grouped = find_clusters(t, clean, own)
            found["profile_kmeans"], found["profile_kmeans_score"] = grouped.centroids, grouped.scores
            found["profile_best_k"] = spark.createDataFrame(
                [(t, grouped.best_k, grouped.best_score)] if grouped.best_k else [], _EMPTY["profile_best_k"])
        return found

    parts = each(sorted(tables), profile)
    wanted = ("profile_corr_ratio", *_ML_FRAMES)
    return {name: _gather(spark, name, [p[name] for p in parts if name in p]) for name in wanted}


# --- saving and reading --------------------------------------------------------------------------------

def save_profile(frames: Frames, folder: str) -> None:
    """Every frame as parquet, floats rounded; replaces an earlier profile."""
    def save(name: str) -> None:
        df = frames[name]
        rounded = df.select(*[
            F.round(quoted(f.name), DECIMALS).alias(f.name) if f.dataType.typeName() == "double"
            else quoted(f.name) for f in df.schema])
        rounded.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")

    each(frames, save)


def load_profile(spark: SparkSession, folder: str, names: tuple[str, ...] = PROFILE_FRAMES) -> Frames:
    """The saved frames; those never written are empty."""
    frames: Frames = {}
    for name in names:
        try:
            frames[name] = spark.read.parquet(f"{folder.rstrip('/')}/{name}")
        except AnalysisException as error:
            # only a frame that was never written is empty; anything else is an error
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            if name in _EMPTY:
                frames[name] = spark.createDataFrame([], _EMPTY[name])
    return frames


# Frames of the machine-learning part, which a reader of one table's profile does not get.
_ML_FRAMES = ("profile_dmv", "profile_pca", "profile_pca_loading", "profile_main_columns", "profile_kmeans",
              "profile_kmeans_score", "profile_best_k", "profile_rows")


def read_calibration(frames: Frames, table: str) -> dict:
    """One table's profile as plain data, without the machine-learning part.

    An unknown name returns the list of known tables.
    """
    known = sorted(r["table_name"] for r in frames["profile_table"].select("table_name").collect())
    if table not in known:
        return {"error": f"{table} has no profile", "calibrated_tables": known}
    found = {}
    for name, df in frames.items():
        if name not in _ML_FRAMES:
            owner = "child_table" if name == "profile_fk" else "table_name"
            found[name] = [r.asDict() for r in df.filter(F.col(owner) == table).collect()]
    return found


def profile_json(frames: Frames, table: str) -> str:
    return json.dumps(read_calibration(frames, table), default=str)


def profile_lines(frames: Frames) -> DataFrame:
    """The whole profile as JSON lines (table_name, frame, row), written without passing the driver."""
    parts = []
    for name, df in sorted(frames.items()):
        owner = "child_table" if name == "profile_fk" else "table_name"
        parts.append(df.select(F.col(owner).alias("table_name"), F.lit(name).alias("frame"),
                               F.to_json(F.struct(*[quoted(c) for c in df.columns])).alias("row")))
    return tp.union_all(parts)
