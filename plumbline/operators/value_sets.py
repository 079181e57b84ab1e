"""What is known of a column's number of different values before any value is counted.

One scan per table gives, for each column, the set of hash buckets its values fall in, the number of missing cells and the span of
whole numbers. The sets are a few 64-bit words that merge by OR, so no cell is shuffled. They prove most of what a profile asks:

* values in more than 100 buckets are more than 100 values, so the column is not categorical;
* whole numbers within a span shorter than the table, or two missing cells, cannot all be different, so the column is no key.

Columns that may be categorical are counted by value, which is at most a few hundred groups per task. Columns that may still be keys are
searched for a repeated value among those of one slice of the hash space: repeated values stay together in a slice, so one
repetition refutes the key at a fraction of the cells. Only what passes is counted whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from plumbline.functions.columns import base_type, cell_sql, name_sql

# 64-bit words of a set of buckets: enough to see more than 100 values fall in more than 100 buckets.
WORDS = 4
# A slice holds this share of the hash space.
SLICES = 64


@dataclass
class Evidence:
    """Bounds on the number of different values of a column, a missing one included."""

    rows: int
    values: int
    least: int
    most: int

    @property
    def nulls(self) -> int:
        return self.rows - self.values

    def may_be_few(self, limit: int) -> bool:
        return self.least <= limit

    @property
    def may_be_key(self) -> bool:
        return self.most >= self.rows


def _plain(df: DataFrame, name: str) -> str:
    """The column with -0.0 and 0.0 as one value."""
    column, kind = name_sql(name), df.schema[name].dataType
    return f"({column} + CAST(0 AS {kind.simpleString()}))" if base_type(kind) == "float" else column


def with_buckets(df: DataFrame) -> DataFrame:
    """The table and, as `__bucket_{i}`, the hash bucket of each cell: hashed once a cell, not once a word of its set."""
    buckets = []
    for i, field in enumerate(df.schema):
        if base_type(field.dataType) is not None:
            value = _plain(df, field.name)
            buckets.append(f"CASE WHEN {value} IS NOT NULL THEN CAST(xxhash64({value}) & {WORDS * 64 - 1} AS INT) END AS __bucket_{i}")
    return df.selectExpr("*", *buckets)


def evidence_counts(df: DataFrame) -> list[str]:
    """The aggregates over `with_buckets(df)` as SQL; `v{i}` holds the number of values."""
    counts = []
    for i, field in enumerate(df.schema):
        kind = base_type(field.dataType)
        if kind is None:
            continue
        value = _plain(df, field.name)
        counts += [f"bit_or(CASE WHEN __bucket_{i} BETWEEN {64 * word} AND {64 * word + 63} THEN shiftleft(1L, __bucket_{i}) END) "
                   f"AS b{i}_{word}" for word in range(WORDS)]
        if kind == "int":
            counts += [f"min({value}) AS l{i}", f"max({value}) AS h{i}"]
    return counts


def read_evidence(df: DataFrame, row) -> dict[str, Evidence]:
    """By column, from a collected row of the counts `n`, `v{i}` and evidence_counts."""
    found = {}
    for i, field in enumerate(df.schema):
        kind = base_type(field.dataType)
        if kind is None:
            continue
        rows, values = int(row["n"]), int(row[f"v{i}"])
        missing = int(rows > values)
        most = values
        if kind == "int" and values:
            most = min(most, int(row[f"h{i}"]) - int(row[f"l{i}"]) + 1)
        elif kind == "bool":
            most = min(most, 2)
        buckets = sum((int(row[f"b{i}_{word}"] or 0) & (1 << 64) - 1).bit_count() for word in range(WORDS))
        found[field.name] = Evidence(rows, values, buckets + missing, most + missing)
    return found


def in_slice(df: DataFrame, name: str, slices: int = SLICES) -> str:
    """Whether a cell's value falls in the first slice of the hash space, as SQL: equal values of any two columns fall together,
    missing ones nowhere."""
    column = name_sql(name)
    if base_type(df.schema[name].dataType) == "str":
        drawn = f"xxhash64({column})"
    else:
        _, num, txt = cell_sql(df, name)
        drawn = f"xxhash64({num}, {txt})"
    return f"{column} IS NOT NULL AND pmod({drawn}, {slices}) = 0"
