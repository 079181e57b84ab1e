"""Matching found against injected anomalies, report parsing and cost rollup.

Logs carry run_number, id, table, column, anomaly and nb_rows_affected. A blank column matches any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbering import BUCKET_ROWS, number_rows
from plumbline.session import materialize

# Section headings and fields of a report, suffix of the tables holding new rows.
OUTPUT_HEADING = "**OUTPUT**"
FEEDBACK_HEADING = "### **FEEDBACK**"
REPORT_FIELDS = ("table", "column", "anomaly", "calibration", "current", "nb_rows_affected", "severity")
NEW_DATA_SUFFIX = "_new_data"
BLANKS = " \t\r\n"

# USD per million tokens of each kind, three price tiers.
TOKEN_KINDS = ("total_input_tokens", "total_output_tokens", "total_cache_read", "total_cache_written")
PRICE_TIERS = {
    "tier_1": (1.0, 5.0, 0.1, 1.25),
    "tier_2": (2.0, 10.0, 0.2, 2.5),
    "tier_3": (5.0, 25.0, 0.5, 6.25),
}

_GROUP = ["run_number", "table", "anomaly"]


def _join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on shared names, keeping the left side's columns and what the right side adds."""
    renamed = right.select(*[F.col(n).alias(f"__{n}") if n in names else F.col(n) for n in right.columns])
    condition = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]
    return left.join(renamed, condition, how).drop(*[f"__{n}" for n in names])


def matches(first: DataFrame, second: DataFrame) -> DataFrame:
    """run_number, id1, id2, nb_rows_affected: each item of `second` goes to the first item that fits.

    An item fits when table and anomaly are equal and the columns are equal or one is blank. Only the
    smallest id per (table, anomaly, column) can ever be taken, and the smallest per (table, anomaly) for
    a blank column, so the first log is reduced to those before the join and no group is multiplied out.
    The flag tells whether the row counts agree as text.
    """
    item = F.struct(F.col("id").alias("id"), F.col("nb_rows_affected").cast("string").alias("rows"))
    per_column = first.groupBy(*_GROUP, "column").agg(F.min_by(item, "id").alias("own"))
    per_group = per_column.groupBy(*_GROUP).agg(
        F.min_by("own", F.col("own.id")).alias("any_column"),
        F.min_by(F.when(F.col("column") == "", F.col("own")), F.when(F.col("column") == "", F.col("own.id")))
        .alias("blank"))
    exact = per_column.filter("column <> ''")
    joined = _join(_join(second, per_group, _GROUP), exact, [*_GROUP, "column"], "left")
    either = F.when(F.col("blank.id") < F.col("own.id"), F.col("blank")).otherwise(
        F.coalesce("own", "blank"))
    taken = F.when(F.col("column") == "", F.col("any_column")).otherwise(either)
    return (
        joined.withColumn("taken", taken).filter("taken IS NOT NULL")
        .select("run_number", F.col("taken.id").alias("id1"), F.col("id").alias("id2"),
                F.col("taken.rows").eqNullSafe(F.col("nb_rows_affected").cast("string"))
                .alias("nb_rows_affected")))


def scores(injected: DataFrame, found: DataFrame) -> DataFrame:
    """Per run: matched, false positives and errors not found."""
    def per_run(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("run_number").agg(F.count(F.lit(1)).alias(name))

    parts = [per_run(matches(injected, found), "matched"), per_run(matches(found, injected), "claimed"),
             per_run(found, "nb_found"), per_run(injected, "nb_injected")]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "run_number", "full")
    filled = joined.na.fill(0)
    return filled.select(
        "run_number", "matched", (F.col("nb_found") - F.col("claimed")).alias("false_positives"),
        (F.col("nb_injected") - F.col("matched")).alias("not_found"))


def strict_matches(first: DataFrame, second: DataFrame) -> DataFrame:
    """One-to-one variant: an item is used once on either side.

    Items with equal column are paired by their position; those left over on both sides are then paired
    by position when one of them has a blank column. Positions come from bucketed numbering, so a large
    group is spread over many tasks.
    """
    def numbered(df: DataFrame, group: list[str], name: str) -> DataFrame:
        kept = df.select(*group, F.col("id").alias(name), F.col("nb_rows_affected").cast("string").alias(
            f"{name}_rows"))
        return number_rows(kept, [name], "place", group)

    def paired(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
        a, b = numbered(left, group, "id1"), numbered(right, group, "id2")
        return _join(a, b, [*group, "place"]).select(
            "run_number", "id1", "id2", F.col("id1_rows").eqNullSafe(F.col("id2_rows"))
            .alias("nb_rows_affected"))

    def left_over(df: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        used = pairs.select("run_number", F.col(name).alias("id"))
        return df.join(used, ["run_number", "id"], "left_anti")

    # each of these is used several times below
    same_column = materialize(paired(first, second, [*_GROUP, "column"]), "strict-same")
    first_rest = materialize(left_over(first, same_column, "id1"), "strict-first")
    second_rest = materialize(left_over(second, same_column, "id2"), "strict-second")
    # equal columns were paired already, so in a group at most one side has blanks left
    blank_first = paired(first_rest.filter("column = ''"), second_rest.filter("column <> ''"), _GROUP)
    blank_second = paired(first_rest.filter("column <> ''"), second_rest.filter("column = ''"), _GROUP)
    return same_column.unionByName(blank_first).unionByName(blank_second)


# --- reports -----------------------------------------------------------------------------------------

def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _sections(reports: DataFrame) -> DataFrame:
    """Reports with an output section, cut into findings and feedback text."""
    body = F.split(F.col("text"), "### \\*\\*FEEDBACK\\*\\*")
    return reports.filter(F.contains("text", F.lit(OUTPUT_HEADING))).select(
        "run_number", "report",
        F.get(F.split(F.get(body, F.lit(0)), "\\*\\*OUTPUT\\*\\*"), F.lit(1)).alias("output"),
        F.get(body, F.lit(1)).alias("feedback"))


def report_lines(reports: DataFrame) -> DataFrame:
    """run_number, report, line_no, line, fields of every output line; `report` numbers a run's texts."""
    sections = _sections(reports).select(
        "run_number", "report", F.posexplode(F.split(_trimmed("output"), "\n")).alias("line_no", "line"))
    fields = F.transform(F.split("line", "\\|"), lambda f: F.btrim(f, F.lit(BLANKS)))
    return sections.withColumn("fields", fields)


def parse_reports(reports: DataFrame) -> DataFrame:
    """Findings read from report texts; the table loses the suffix of its new rows.

    `line_no` keeps the position within the report, from which `with_ids` numbers the findings.
    """
    lines = report_lines(reports).filter(F.size("fields") >= len(REPORT_FIELDS))
    columns = [F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(REPORT_FIELDS)]
    return lines.select("run_number", "report", "line_no", *columns).withColumn(
        "table", F.replace(F.col("table"), F.lit(NEW_DATA_SUFFIX), F.lit("")))


def rejected_lines(reports: DataFrame) -> DataFrame:
    """Output lines with too few fields."""
    return report_lines(reports).filter(F.size("fields") < len(REPORT_FIELDS)).select(
        "run_number", "report", "line_no", "line")


def feedback_lines(reports: DataFrame) -> DataFrame:
    """Non-empty feedback lines, in report order."""
    lines = _sections(reports).filter("feedback IS NOT NULL").select(
        "run_number", "report", F.posexplode(F.split("feedback", "\n")).alias("line_no", "line"))
    return lines.filter("line <> ''").withColumn("line", _trimmed(F.col("line")))


def with_ids(findings: DataFrame, start: int = 1) -> DataFrame:
    """Consecutive ids per run in report and line order."""
    numbered = number_rows(findings, ["report", "line_no"], "id", ["run_number"],
                           bucket=F.floor(F.col("report") / F.lit(BUCKET_ROWS // 64)))
    return numbered.withColumn("id", F.col("id") + F.lit(start))


# --- cost --------------------------------------------------------------------------------------------

def price_table(df: DataFrame) -> DataFrame:
    """model and USD per million tokens for each kind; the default tiers, three rows."""
    names = ", ".join(f"price_{kind} double" for kind in TOKEN_KINDS)
    rows = [(model, *prices) for model, prices in PRICE_TIERS.items()]
    return df.sparkSession.createDataFrame(rows, f"model string, {names}")


def usage_cost(usage: DataFrame, prices: DataFrame | None = None,
               by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Token totals and cost in USD per group: sums first, so prices meet one row per group and model."""
    prices = price_table(usage) if prices is None else prices
    keys = list(dict.fromkeys([*by, "model"]))
    totals = usage.groupBy(*keys).agg(*[F.sum(kind).alias(kind) for kind in TOKEN_KINDS])
    cost = sum((F.col(kind) * F.col(f"price_{kind}") for kind in TOKEN_KINDS), F.lit(0.0)) / 1_000_000
    priced = totals.join(prices, "model", "left").withColumn("cost", cost)
    return priced.groupBy(*by).agg(
        *[F.sum(kind).alias(kind) for kind in TOKEN_KINDS],
        F.round(F.sum("cost"), 4).alias("total_cost_usd"))
