"""Ten detectors: a batch of new rows against the profile of its table.

Checks that read the batch row by row share one aggregate over it, whatever their number. Duplicate
rows, duplicate keys and orphans group by a key first. Everything returns the same finding columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import base_type, cell_key, parse_datetime, quoted, row_fingerprint
from plumbline.functions.moments import safe_corr
from plumbline.operators.corruption import type_column
from plumbline.operators.profile_store import TableProfile

# Our thresholds; the definitions of the anomalies leave them open.
MIN_CORRELATION = 0.3
MAX_FISHER_DISTANCE = 3.0
MIN_ROWS_FOR_SHIFT = 30
MAX_Z = 4.0
MIN_EFFECT = 0.25
STD_RATIO = (0.75, 1.33)
SEVERITY = ((0.01, "Medium"), (0.10, "High"))

FINDINGS = ("table string, column string, anomaly string, calibration string, current string, "
            "nb_rows_affected long, severity string")
_CHECKS_PER_SCAN = 200


@dataclass
class Check:
    """One test of the batch: aggregates it needs, when it fires, and what it then reports."""

    column: str
    anomaly: str
    aggs: dict[str, Column]
    found: Column
    affected: Column
    calibration: Column
    current: Column


def _number(value: Column | float) -> Column:
    value = F.lit(float(value)) if isinstance(value, (int, float)) else value
    return F.format_string("%.4f", F.round(value, 4))


def severity(affected: Column, rows: Column) -> Column:
    share = F.try_divide(affected, rows)
    (low, medium), (high, serious) = SEVERITY
    return F.when(share < low, medium).when(share < high, serious).otherwise("Critical")


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDINGS)


def run_checks(table: str, batch: DataFrame, checks: list[Check]) -> DataFrame:
    """All checks in one scan of the batch (further scans above 200)."""
    frames = []
    for start in range(0, len(checks), _CHECKS_PER_SCAN):
        part = checks[start:start + _CHECKS_PER_SCAN]
        aggs = {"rows": F.count(F.lit(1))}
        for check in part:
            aggs.update(check.aggs)
        rows = F.array(*[
            F.struct(
                F.lit(table).alias("table"), F.lit(c.column).alias("column"), F.lit(c.anomaly).alias("anomaly"),
                c.calibration.alias("calibration"), c.current.alias("current"),
                c.affected.cast("long").alias("nb_rows_affected"),
                severity(c.affected, F.col("rows")).alias("severity"), c.found.alias("found"))
            for c in part])
        frames.append(batch.agg(*[a.alias(n) for n, a in aggs.items()]).select(F.inline(rows))
                      .filter("found").drop("found"))
    return reduce(DataFrame.unionByName, frames) if frames else empty_findings(batch.sparkSession)


def data_columns(batch: DataFrame, key: str = "row_id") -> list[str]:
    """The batch's own columns: row identity and type companions left out."""
    names = set(batch.columns)
    return [c for c in batch.columns if c != key
            and not (c.endswith("__type") and c[:-len("__type")] in names)]


def _as_number(batch: DataFrame, name: str) -> Column:
    column = quoted(name)
    if base_type(batch.schema[name].dataType) == "str":
        number = column.try_cast("double")
        if type_column(name) in batch.columns:
            number = F.when(quoted(type_column(name)).isin("int", "float"), number)
        return number
    return column.cast("double")


def _is_number(batch: DataFrame, name: str) -> bool:
    return base_type(batch.schema[name].dataType) in ("int", "float", "str", "bool")


# --- checks of single rows ---------------------------------------------------------------------------

def wrong_datatype_checks(batch: DataFrame, profile: TableProfile) -> list[Check]:
    """Values whose type is not the profiled one."""
    checks = []
    for i, (name, known) in enumerate(profile.columns.items()):
        if name not in batch.columns or known.datatype is None:
            continue
        column, stored = quoted(name), base_type(batch.schema[name].dataType)
        if type_column(name) in batch.columns:
            kind = quoted(type_column(name))
            wrong = column.isNotNull() & (kind != known.datatype)
        elif stored == "str":
            fits = {
                "str": F.lit(True),
                "int": column.try_cast("double") == F.floor(column.try_cast("double")),
                "float": column.try_cast("double").isNotNull(),
                "bool": column.isin("Y", "N", "0", "1", "true", "false"),
                "datetime": parse_datetime(name).isNotNull(),
            }[known.datatype]
            wrong = column.isNotNull() & ~F.coalesce(fits, F.lit(False))
        elif {stored, known.datatype} <= {"int", "float", "bool"}:
            number = column.cast("double")
            fits = {"int": number == F.floor(number), "float": F.lit(True),
                    "bool": number.isin(0.0, 1.0)}[known.datatype]
            wrong = column.isNotNull() & ~fits
        else:
            wrong = column.isNotNull() & F.lit(stored != known.datatype)
        alias = f"type_{i}"
        found = F.col(alias)
        checks.append(Check(name, "wrong_datatype", {alias: F.count_if(wrong)}, found > 0, found,
                            F.lit(known.datatype), F.lit("other types")))
    return checks


def insert_null_checks(batch: DataFrame, profile: TableProfile) -> list[Check]:
    """NULLs in a column that never held any."""
    checks = []
    for i, (name, known) in enumerate(profile.columns.items()):
        if name in batch.columns and not known.null_values:
            alias = f"null_{i}"
            found = F.col(alias)
            checks.append(Check(name, "insert_null", {alias: F.count_if(quoted(name).isNull())}, found > 0,
                                found, F.lit("0"), found.cast("string")))
    return checks


def insert_column_checks(batch: DataFrame, profile: TableProfile, key: str = "row_id") -> list[Check]:
    """Columns the profile never saw, reported under the column they copy when there is one."""
    checks = []
    for i, name in enumerate(c for c in data_columns(batch, key) if c not in profile.columns):
        same = [c for c in profile.columns if c in batch.columns
                and batch.schema[c].dataType == batch.schema[name].dataType
                and base_type(batch.schema[c].dataType) is not None]
        # the column whose name the new one carries is looked at first
        same.sort(key=lambda c: (not name.endswith(c), list(profile.columns).index(c)))
        aggs = {f"new_{i}_{j}": F.count_if(~quoted(name).eqNullSafe(quoted(c))) for j, c in enumerate(same)}
        earlier = F.lit(False)
        for j, c in enumerate(same):
            equal = F.col(f"new_{i}_{j}") == 0
            checks.append(Check(c, "insert_column", aggs, equal & ~earlier,
                                F.col("rows"), F.lit(""), F.lit(name)))
            earlier = earlier | equal
        checks.append(Check(name, "insert_column", aggs, ~earlier, F.col("rows"), F.lit(""), F.lit(name)))
    return checks


def new_category_checks(batch: DataFrame, profile: TableProfile) -> list[Check]:
    """Labels unknown to the profile in a categorical text column (at most 100 known labels)."""
    checks = []
    for i, (name, known) in enumerate(profile.columns.items()):
        if (name not in batch.columns or known.datatype != "str" or not known.is_categorical
                or known.potential_primary_key or not known.categories):
            continue
        column = quoted(name).cast("string")
        unknown = column.isNotNull() & ~column.isin(*sorted(known.categories))
        if type_column(name) in batch.columns:
            unknown = unknown & (quoted(type_column(name)) == "str")
        alias = f"label_{i}"
        found = F.col(alias)
        checks.append(Check(name, "new_category", {alias: F.count_if(unknown)}, found > 0, found,
                            F.lit(f"{len(known.categories)} labels"), F.lit("unknown labels")))
    return checks


def correlation_break_checks(batch: DataFrame, profile: TableProfile) -> list[Check]:
    """Correlated pairs whose r in the batch lies too far from the profile's, on Fisher's z scale.

    Nothing tells which side was shuffled, so the column stays blank and the pair is named in the values.
    """
    checks = []
    for i, (a, b, r) in enumerate(profile.correlations):
        if abs(r) < MIN_CORRELATION or not {a, b} <= set(batch.columns):
            continue
        if not (_is_number(batch, a) and _is_number(batch, b)):
            continue
        x, y = _as_number(batch, a), _as_number(batch, b)
        aggs = {f"r_{i}": safe_corr(x, y), f"rn_{i}": F.count_if(x.isNotNull() & y.isNotNull())}
        now, n = F.col(f"r_{i}"), F.col(f"rn_{i}")

        def z(value: Column) -> Column:
            bounded = F.least(F.greatest(value, F.lit(-0.999999)), F.lit(0.999999))
            return F.atanh(F.when(value.isNotNull(), bounded))

        error = F.sqrt(1 / F.when(n > 3, n - 3) + F.lit(1.0 / max(profile.nb_entries - 3, 1)))
        distance = F.abs(z(now) - z(F.lit(float(r)))) / error
        checks.append(Check("", "correlation_break", aggs,
                            F.coalesce(distance > MAX_FISHER_DISTANCE, F.lit(False)), n,
                            F.concat(F.lit(f"{a} & {b}: "), _number(r)),
                            F.concat(F.lit(f"{a} & {b}: "), _number(now))))
    return checks


def distribution_shift_checks(batch: DataFrame, profile: TableProfile) -> list[Check]:
    """Mean or spread of the in-range values moved further than their number explains."""
    checks = []
    for i, (name, known) in enumerate(profile.columns.items()):
        if (name not in batch.columns or not known.is_numeric_value or not _is_number(batch, name)
                or not known.has("mean", "std", "min", "max") or known.distribution["std"] <= 0):
            continue
        stats = known.distribution
        value = _as_number(batch, name)
        value = F.when(value.between(F.lit(stats["min"]), F.lit(stats["max"])), value)
        aggs = {f"sn_{i}": F.count(value), f"sm_{i}": F.avg(value), f"ss_{i}": F.stddev_samp(value)}
        n, mean, std = F.col(f"sn_{i}"), F.col(f"sm_{i}"), F.col(f"ss_{i}")
        effect = F.abs(mean - stats["mean"]) / stats["std"]
        moved = (effect * F.sqrt(n) > MAX_Z) & (effect >= MIN_EFFECT)
        ratio = std / stats["std"]
        # a spread of zero is as far as a ratio can be
        drift = F.when(ratio > 0, F.abs(F.ln(F.when(ratio > 0, ratio))) * F.sqrt(2 * (n - 1)) > MAX_Z).otherwise(
            F.lit(True))
        spread = ~ratio.between(*STD_RATIO) & drift
        found = (n >= MIN_ROWS_FOR_SHIFT) & F.coalesce(moved | spread, F.lit(False))
        checks.append(Check(name, "distribution_shift", aggs, found, n,
                            F.concat(F.lit("mean "), _number(stats["mean"]), F.lit(" std "), _number(stats["std"])),
                            F.concat(F.lit("mean "), _number(mean), F.lit(" std "), _number(std))))
    return checks


def out_of_range_checks(batch: DataFrame, profile: TableProfile) -> list[Check]:
    """More values past the profiled bounds than new extremes that chance alone would give."""
    checks = []
    for i, (name, known) in enumerate(profile.columns.items()):
        if (name not in batch.columns or not known.is_numeric_value or not _is_number(batch, name)
                or not known.has("min", "max")):
            continue
        low, high = known.distribution["min"], known.distribution["max"]
        value = _as_number(batch, name)
        aggs = {f"o_{i}": F.count_if((value < low) | (value > high)), f"on_{i}": F.count(value),
                f"ol_{i}": F.min(value), f"oh_{i}": F.max(value)}
        expected = 2 * F.col(f"on_{i}") / F.lit(profile.nb_entries + 1)
        found = F.col(f"o_{i}")
        checks.append(Check(
            name, "out_of_range", aggs, found > expected + 3 * F.sqrt(expected) + 1, found,
            F.concat(F.lit("["), _number(low), F.lit(", "), _number(high), F.lit("]")),
            F.concat(F.lit("["), _number(F.col(f"ol_{i}")), F.lit(", "), _number(F.col(f"oh_{i}")), F.lit("]"))))
    return checks


ROW_CHECKS = {
    "wrong_datatype": wrong_datatype_checks,
    "insert_null": insert_null_checks,
    "insert_column": insert_column_checks,
    "new_category": new_category_checks,
    "correlation_break": correlation_break_checks,
    "distribution_shift": distribution_shift_checks,
    "out_of_range": out_of_range_checks,
}


class CleanKeys(Protocol):
    """Clean keys that are stored once and looked up by each batch."""

    def name(self, table: str, column: str) -> str: ...

    def holds(self, table: str, column: str) -> bool: ...

    def marked(self, keys: DataFrame, mark: str) -> DataFrame: ...


@dataclass
class Context:
    """Tables a batch is checked against: clean tables and the other batches, by table name; and a store of the clean keys, if any."""

    clean: dict[str, DataFrame] = field(default_factory=dict)
    batch: dict[str, DataFrame] = field(default_factory=dict)
    keys: CleanKeys | None = None

    def holders(self, table: str) -> list[DataFrame]:
        return [side[table] for side in (self.clean, self.batch) if table in side]


# --- checks that group ---------------------------------------------------------------------------------

def _finding(table: str, column: str, anomaly: str, frame: DataFrame, calibration: Column,
             current: Column) -> DataFrame:
    """`frame` holds one row with `affected` and `rows`."""
    return frame.filter("affected > 0").select(
        F.lit(table).alias("table"), F.lit(column).alias("column"), F.lit(anomaly).alias("anomaly"),
        calibration.alias("calibration"), current.alias("current"),
        F.col("affected").cast("long").alias("nb_rows_affected"),
        severity(F.col("affected"), F.col("rows")).alias("severity"))


def duplicate_rows(batch: DataFrame, profile: TableProfile, key: str = "row_id") -> DataFrame:
    """Whole rows held several times by a table that had no duplicate."""
    if profile.nb_duplicated_rows > 0:
        return empty_findings(batch.sparkSession)
    groups = batch.groupBy(row_fingerprint(batch, data_columns(batch, key)).alias("f")).agg(
        F.count(F.lit(1)).alias("n"))
    counted = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                         (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("affected"))
    return _finding(profile.name, "", "duplicate_rows", counted, F.lit("0"), F.col("affected").cast("string"))


def key_text(df: DataFrame, name: str) -> Column:
    """A key as text: 1 and 1.0 are one key, a number and a string never; NULL for a missing key."""
    family, num, txt = cell_key(df, name)
    # adding zero makes -0.0 and 0.0 one
    return F.when(quoted(name).isNotNull(), F.concat_ws("|", family.cast("string"), (num + F.lit(0.0)).cast("string"), txt))


def _keyed(df: DataFrame, named: dict[int, Column], *more: Column) -> DataFrame:
    """place, k and `more` for each key of each row: all keys of a table in one scan."""
    cells = F.array(*[F.struct(F.lit(place).alias("place"), k.alias("k")) for place, k in named.items()])
    return df.select(F.explode(cells).alias("cell"), *more).select(
        "cell.place", "cell.k", *[c for c in df.select(*more).columns] if more else []).filter("k IS NOT NULL")


def orphan_foreign_keys(batch: DataFrame, profile: TableProfile, context: Context) -> DataFrame:
    """Child rows whose key no parent row holds, clean or new: all foreign keys of a batch in one grouping.

    Child rows and parent keys meet by (link, key) with map-side combine, so a key filling a third of the batch is one partial count per
    task. With a key store the clean keys stay where they are.
    """
    spark = batch.sparkSession
    links = [(column, link) for column, link in profile.foreign_keys.items()
             if column in batch.columns and context.holders(link.parent_table)]
    if not links:
        return empty_findings(spark)

    def child(column: str) -> Column:
        known = profile.columns[column]
        if base_type(batch.schema[column].dataType) == "str" and known.datatype in ("int", "float", "bool"):
            # a column that took other types is compared by the values that still are numbers
            return _number_text(batch, column)
        return key_text(batch, column)

    children = _keyed(batch, {i: child(column) for i, (column, _) in enumerate(links)}).groupBy("place", "k").agg(
        F.count(F.lit(1)).alias("cnt"))
    parents = []
    stored = context.keys is not None and all(context.keys.holds(link.parent_table, link.parent_column) for _, link in links)
    sides = [context.batch] if stored else [context.clean, context.batch]
    for side in sides:
        for table in {link.parent_table for _, link in links} & set(side):
            df = side[table]
            own = {i: key_text(df, link.parent_column) for i, (_, link) in enumerate(links)
                   if link.parent_table == table and link.parent_column in df.columns}
            if own:
                parents.append(_keyed(df, own))
    per_key = children.withColumn("held", F.lit(False))
    if parents:
        held = reduce(DataFrame.unionByName, parents).select("place", "k", F.lit(0).cast("long").alias("cnt"), F.lit(True).alias("held"))
        per_key = per_key.unionByName(held)
    per_key = per_key.groupBy("place", "k").agg(F.sum("cnt").alias("cnt"), F.max("held").alias("held")).filter("cnt > 0")
    if stored:
        named = spark.createDataFrame([(i, context.keys.name(link.parent_table, link.parent_column)) for i, (_, link) in enumerate(links)],
                                      "place int, attr string")
        per_key = context.keys.marked(per_key.join(F.broadcast(named), "place"), "in_clean").withColumn(
            "held", F.col("held") | F.col("in_clean"))
    counted = per_key.groupBy("place").agg(
        F.sum(F.when(~F.col("held"), F.col("cnt")).otherwise(F.lit(0))).alias("affected"), F.sum("cnt").alias("filled"))
    names = spark.createDataFrame([(i, column, float(link.coverage)) for i, (column, link) in enumerate(links)],
                                  "place int, column string, coverage double")
    # one row per foreign key
    found = counted.join(F.broadcast(names), "place").filter("affected > 0")
    return found.select(
        F.lit(profile.name).alias("table"), "column", F.lit("orphan_foreign_key").alias("anomaly"),
        _number(F.col("coverage")).alias("calibration"), _number(1 - F.try_divide("affected", "filled")).alias("current"),
        F.col("affected").cast("long").alias("nb_rows_affected"), severity(F.col("affected"), F.col("filled")).alias("severity"))


def _number_text(batch: DataFrame, column: str) -> Column:
    """The key of a text that still is a number, as `key_text` gives it for a double; a whole number a double cannot hold stays digits."""
    number = _as_number(batch, column)
    size = F.abs(number)
    wide = (size >= float(2 ** 53)) & (size < float(2 ** 63))
    return F.when(wide, F.concat_ws("|", F.lit("2"), F.when(wide, number).try_cast("bigint").cast("string"))).when(
        number.isNotNull(), F.concat_ws("|", F.lit("0"), (number + F.lit(0.0)).cast("string")))


def duplicate_primary_keys(batch: DataFrame, profile: TableProfile, context: Context, key: str = "row_id") -> DataFrame:
    """Rows reusing a key: beyond the first holder in the batch, or any holder of a clean key; all keys of a batch in one grouping.

    Repeated whole rows count once. The batch is reduced to one row per (key, row) and then per key; the
    clean table gives only the keys the batch also holds, from the key store where there is one.
    """
    spark = batch.sparkSession
    columns = [c for c, known in profile.columns.items() if known.potential_primary_key and c in batch.columns]
    if not columns:
        return empty_findings(spark)
    fingerprint = row_fingerprint(batch, data_columns(batch, key)).alias("f")
    holders = _keyed(batch, {i: key_text(batch, c) for i, c in enumerate(columns)}, fingerprint).groupBy("place", "k", "f").agg(
        F.count(F.lit(1)).alias("n"))
    per_key = holders.groupBy("place", "k").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("n"))
    clean = context.clean.get(profile.name)
    if context.keys is not None and all(context.keys.holds(profile.name, c) for c in columns):
        named = spark.createDataFrame([(i, context.keys.name(profile.name, c)) for i, c in enumerate(columns)], "place int, attr string")
        per_key = context.keys.marked(per_key.join(F.broadcast(named), "place"), "in_clean")
    elif clean is not None:
        own = {i: key_text(clean, c) for i, c in enumerate(columns) if c in clean.columns}
        seen = _keyed(clean, own).join(per_key.select("place", "k"), ["place", "k"], "left_semi").distinct().withColumn(
            "in_clean", F.lit(True))
        per_key = per_key.join(seen, ["place", "k"], "left").withColumn("in_clean", F.coalesce("in_clean", F.lit(False)))
    else:
        per_key = per_key.withColumn("in_clean", F.lit(False))
    beyond = F.when(F.col("in_clean"), F.col("held")).otherwise(F.col("held") - 1)
    counted = per_key.groupBy("place").agg(F.sum(beyond).alias("affected"), F.sum("n").alias("filled"))
    names = spark.createDataFrame(list(enumerate(columns)), "place int, column string")
    # one row per key column
    found = counted.join(F.broadcast(names), "place").filter("affected > 0")
    return found.select(
        F.lit(profile.name).alias("table"), "column", F.lit("duplicate_primary_key").alias("anomaly"), F.lit("unique").alias("calibration"),
        F.col("affected").cast("string").alias("current"), F.col("affected").cast("long").alias("nb_rows_affected"),
        severity(F.col("affected"), F.col("filled")).alias("severity"))


# --- everything ------------------------------------------------------------------------------------------

def detect(batch: DataFrame, profile: TableProfile, context: Context | None = None,
           anomalies: set[str] | None = None, key: str = "row_id") -> DataFrame:
    """Findings of the wanted detectors (all by default) on one batch."""
    context = context or Context()

    def wanted(name: str) -> bool:
        return anomalies is None or name in anomalies

    checks = []
    for name, build in ROW_CHECKS.items():
        if wanted(name):
            checks += build(batch, profile, key) if name == "insert_column" else build(batch, profile)
    frames = [run_checks(profile.name, batch, checks)]
    if wanted("duplicate_rows"):
        frames.append(duplicate_rows(batch, profile, key))
    if wanted("orphan_foreign_key"):
        frames.append(orphan_foreign_keys(batch, profile, context))
    if wanted("duplicate_primary_key"):
        frames.append(duplicate_primary_keys(batch, profile, context, key))
    return reduce(DataFrame.unionByName, frames)
