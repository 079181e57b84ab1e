"""Keys across tables: key columns, foreign key coverage and discovery, referenced keys."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.columns import base_type, cell_key, double_sql, name_sql, quoted
from plumbline.operators.table_profile import Tables, category_distribution, cells, columns_frame, value_counts
from plumbline.operators.value_sets import SLICES
from plumbline.session import each, materialize

# Fixed value: coverage wanted.
FULL_COVERAGE = 1.0


def primary_key_columns(columns: DataFrame) -> DataFrame:
    """column_name, tables: the tables in which each column name is a key."""
    return columns.filter("potential_primary_key").groupBy("column_name").agg(
        F.sort_array(F.collect_list("table_name")).alias("tables"))


def ranked_parents(columns: DataFrame) -> DataFrame:
    """Key columns in the order candidates are tried: first-seen column name, then table."""
    keys = columns.filter("potential_primary_key").select("table_name", "column_name", "ordinal")
    first = keys.groupBy("column_name").agg(F.min(F.struct("table_name", "ordinal")).alias("seen"))
    # one row per key column of the dataset: schema-sized
    order = W.orderBy("seen", "table_name")
    return keys.join(first, "column_name").select(
        "table_name", "column_name", F.row_number().over(order).alias("parent_rank"))


def _numbered_parents(tables: Tables, columns: DataFrame) -> DataFrame:
    """parent (attr), parent_table, parent_column, parent_rank: one row per key column."""
    attributes = columns_frame(next(iter(tables.values())).sparkSession, tables)
    return ranked_parents(columns).join(attributes, ["table_name", "column_name"]).select(
        F.col("attr").alias("parent"), F.col("table_name").alias("parent_table"),
        F.col("column_name").alias("parent_column"), "parent_rank")


def _holder_words(parents: DataFrame) -> list[str]:
    """Names of the words whose bits stand for the keys, by rank."""
    ranks = parents.agg(F.max("parent_rank")).first()[0] or 0
    return [f"held_{word}" for word in range(-(-ranks // 64))]


def _holds(words: list[str]) -> Column:
    """Whether the key of `parent_rank` is among the holders."""
    place = "(parent_rank - 1)"
    tests = [f"({place} DIV 64 = {n} AND ({w} & shiftleft(1L, {place} % 64)) <> 0)" for n, w in enumerate(words)]
    return F.expr(" OR ".join(tests) or "false")


def _by_value(counts: DataFrame, parents: DataFrame, words: list[str]) -> DataFrame:
    """`counts` and, as bits of `words`, the keys that hold each value.

    A value's group holds one entry per column in which it occurs, never more than the dataset has columns; no list is built of them.
    """
    # schema-sized, hence safe to broadcast
    ranked = parents.select(F.col("parent").alias("attr"), (F.col("parent_rank") - 1).alias("place"))
    bits = [F.expr(f"coalesce(bit_or(CASE WHEN place DIV 64 = {n} THEN shiftleft(1L, place % 64) END) "
                   f"OVER (PARTITION BY family, num, txt), 0L)").alias(w) for n, w in enumerate(words)]
    return counts.join(F.broadcast(ranked), "attr", "left").select("*", *bits).drop("place")


def _comparable(counts: DataFrame) -> DataFrame:
    return counts.filter("attr >= 0 AND family BETWEEN 0 AND 4")


def _named_coverage(tables: Tables, hits: DataFrame, totals: DataFrame, parents: DataFrame) -> DataFrame:
    """Coverage by names from (child, parent, hits) and (child, total); a table's own keys are left out."""
    attributes = columns_frame(next(iter(tables.values())).sparkSession, tables)
    child = attributes.select(F.col("attr").alias("child"), F.col("table_name").alias("child_table"),
                              F.col("column_name").alias("child_column"))
    return (
        hits.join(totals, "child").join(child, "child").join(parents, "parent").filter("child_table <> parent_table")
        .select("child_table", "child_column", "parent_table", "parent_column", "parent_rank",
                F.round(F.col("hits") / F.col("total"), 4).alias("coverage")))


def coverage(tables: Tables, columns: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Share of each column's non-null rows found in each key of another table, where any is found.

    All pairs come out of one grouping by value, which gives each child's values the set of keys that hold them;
    rows are summed per distinct set before a set is ever unfolded.
    """
    filled = _comparable(materialize(value_counts(tables), "coverage") if counts is None else counts)
    parents = _numbered_parents(tables, columns)
    totals = filled.groupBy(F.col("attr").alias("child")).agg(F.sum("cnt").alias("total"))
    words = _holder_words(parents)
    hits = (
        _by_value(filled, parents, words).groupBy("attr", *words).agg(F.sum("cnt").alias("cnt"))
        .join(F.broadcast(parents.select("parent", "parent_rank")), _holds(words))
        .groupBy(F.col("attr").alias("child"), "parent").agg(F.sum("cnt").alias("hits")))
    return _named_coverage(tables, hits, totals, parents)


def _ordered_value(df: DataFrame, name: str) -> tuple[str, str] | None:
    """(kind, value as SQL) by which columns that may match are compared; numbers and booleans are one kind."""
    kind = base_type(df.schema[name].dataType)
    if kind in ("int", "float", "bool"):
        return "num", double_sql(df, name)
    if kind == "str":
        return "str", name_sql(name)
    return ("time", f"unix_micros(CAST({name_sql(name)} AS TIMESTAMP))") if kind == "datetime" else None


def plausible_columns(tables: Tables, columns: DataFrame, threshold: float) -> tuple[dict[str, list[str]], dict[tuple[str, str], int]]:
    """Keys, and the columns enough of whose rows lie within the span of all keys of their kind; and how many values each column
    that was looked at has.

    A row outside that span (or a fraction, where all numeric keys are whole) can have no parent, so a
    column left out cannot reach the threshold. Two scans, without a shuffle of rows.
    """
    key_names: dict[str, list[str]] = {}
    for row in columns.filter("potential_primary_key").collect():
        if row["table_name"] in tables:
            key_names.setdefault(row["table_name"], []).append(row["column_name"])

    def span(table: str) -> list[tuple]:
        compared = [v for v in (_ordered_value(tables[table], c) for c in key_names[table]) if v is not None]
        if not compared:
            return []
        aggs = []
        for i, (kind, value) in enumerate(compared):
            fraction = f"max({value} <> floor({value}))" if kind == "num" else "false"
            aggs += [f"min({value}) AS l{i}", f"max({value}) AS h{i}", f"{fraction} AS f{i}"]
        found = tables[table].selectExpr(*aggs, "count(1) AS n").first()
        return [(kind, found[f"l{i}"], found[f"h{i}"], bool(found[f"f{i}"]))
                for i, (kind, _) in enumerate(compared) if found[f"l{i}"] is not None]

    spans: dict[str, list] = {}
    for kind, *limits in (s for found in each(sorted(key_names), span) for s in found):
        spans.setdefault(kind, []).append(limits)

    def plausible(table: str) -> dict[str, tuple[float, int]]:
        df, tested, aggs = tables[table], [], []
        for name in df.columns:
            compared = _ordered_value(df, name)
            if compared is None or compared[0] not in spans:
                continue
            kind, value = compared
            value = F.expr(value)
            within = value.between(F.lit(min(s[0] for s in spans[kind])), F.lit(max(s[1] for s in spans[kind])))
            if kind == "num" and not any(s[2] for s in spans[kind]):
                within = within & F.expr(f"{compared[1]} = floor({compared[1]})")
            aggs += [F.round(F.count_if(within) / F.when(F.count(value) > 0, F.count(value)), 4).alias(f"s{len(tested)}"),
                     F.count(value).alias(f"n{len(tested)}")]
            tested.append(name)
        found = df.agg(*aggs).first() if aggs else None
        return {c: (found[f"s{i}"] or 0.0, int(found[f"n{i}"])) for i, c in enumerate(tested)}

    kept: dict[str, list[str]] = {}
    counted: dict[tuple[str, str], int] = {}
    for table, shares in zip(sorted(tables), each(sorted(tables), plausible)):
        names = {c for c, (share, _) in shares.items() if share >= threshold} | set(key_names.get(table, []))
        counted.update({(table, c): n for c, (_, n) in shares.items()})
        if names:
            kept[table] = [c for c in tables[table].columns if c in names]
    return kept, counted


def _selected(tables: Tables, wanted: set[tuple[str, str]]) -> Tables:
    return {t: tables[t].select(*[quoted(c) for c in tables[t].columns if (t, c) in wanted])
            for t in sorted({t for t, _ in wanted})}


@dataclass
class Inclusion:
    """Coverage of the pairs that may reach the threshold, and the pairs that cannot.

    `refuted` has a row per pair: (child_table, child_column, parent_table, parent_column, missing, witness), rows of the child that were
    seen without a parent, and one value of theirs.
    """

    found: DataFrame
    refuted: DataFrame


_COVERAGE = ("child_table string, child_column string, parent_table string, parent_column string, parent_rank int, "
             "coverage double")
_REFUTED = ("child_table string, child_column string, parent_table string, parent_column string, missing long, "
            "witness string")


def _few_counts(tables: Tables, few: set[tuple[str, str]], categories: DataFrame) -> DataFrame:
    """attr, family, num, txt, cnt of columns with few values, from their categories: the tables are not read again.

    `attr` counts the columns of `tables`. At most 100 rows a column.
    """
    spark = categories.sparkSession
    places = {(t, c): a for a, (t, c) in enumerate((t, c) for t, df in sorted(tables.items()) for c in df.columns)}
    by_type: dict = {}
    for r in categories.collect():
        place = r["table_name"], r["column_name"]
        if place in few:
            by_type.setdefault(tables[place[0]].schema[place[1]].dataType, []).append((places[place], r["category"], r["cnt"]))
    frames = []
    for kind, rows in by_type.items():
        values = spark.createDataFrame(rows, "attr int, label string, cnt long").select("attr", F.col("label").cast(kind).alias("v"), "cnt")
        family, num, txt = cell_key(values, "v")
        frames.append(values.select("attr", family.alias("family"), num.alias("num"), txt.alias("txt"), "cnt"))
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame(
        [], "attr int, family tinyint, num double, txt string, cnt long")


def _few_valued(tables: Tables, columns: DataFrame, few: set[tuple[str, str]], keys: set[tuple[str, str]],
                categories: DataFrame) -> DataFrame:
    """Coverage of columns with few values: their values go to the keys, not the keys to them.

    At most 100 values a column are broadcast, so keys are scanned and not shuffled.
    """
    subset, held = _selected(tables, few), _selected(tables, keys)
    counts = materialize(_comparable(_few_counts(subset, few, categories)), "few-values")
    parents = _numbered_parents(held, columns)
    asked = counts.select("family", "num", "txt").distinct()
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"v.{c}")) for c in ("family", "num", "txt")]
    there = cells(held).alias("k").join(F.broadcast(asked.alias("v")), reduce(lambda a, b: a & b, same), "left_semi").distinct()
    there = there.select(F.col("attr").alias("parent"), "family", "num", "txt")
    # as many rows as few-valued columns have values, times keys
    hits = counts.alias("v").join(there.alias("k"), reduce(lambda a, b: a & b, same)).groupBy(
        F.col("v.attr").alias("child"), "parent").agg(F.sum("cnt").alias("hits"))
    totals = counts.groupBy(F.col("attr").alias("child")).agg(F.sum("cnt").alias("total"))
    return _named_coverage(subset, hits, totals, parents)


def _missing_in_slice(tables: Tables, columns: DataFrame, slices: int = SLICES) -> DataFrame:
    """child, parent, missing, witness: rows of one slice of the hash space whose value the key does not hold.

    Equal values fall in one slice whatever their column, so what is missing there is missing altogether.
    """
    parents = _numbered_parents(tables, columns)
    words = _holder_words(parents)
    value = F.coalesce(F.col("txt"), F.col("num").cast("string"))
    seen = (
        _by_value(_comparable(value_counts(tables, slices)), parents, words)
        .select("attr", "cnt", *words, value.alias("witness"))
        .groupBy("attr", *words).agg(F.sum("cnt").alias("cnt"), F.min(F.struct(F.length("witness"), "witness")).alias("witness")))
    absent = seen.join(F.broadcast(parents.select("parent", "parent_rank")), ~_holds(words))
    return absent.groupBy(F.col("attr").alias("child"), "parent").agg(
        F.sum("cnt").alias("missing"), F.min("witness.witness").alias("witness"))


def inclusion(tables: Tables, columns: DataFrame, threshold: float = FULL_COVERAGE, slices: int = SLICES,
              categories: DataFrame | None = None) -> Inclusion:
    """Which columns are covered by which keys of other tables, as far as the threshold may be reached. `categories` are those of the
    columns that have few, where they are known for these very tables.

    1. Spans of the keys leave out columns that lie elsewhere.
    2. Columns of few values are answered by a scan of the keys.
    3. For the others one slice of the hash space is grouped by value. Rows that have no parent there are missing for sure; a pair with
       too many of them is refuted. Only columns and keys with a pair left are grouped whole.
    """
    spark = next(iter(tables.values())).sparkSession
    kept, counted = plausible_columns(tables, columns, threshold)
    if len(kept) < 2:
        return Inclusion(spark.createDataFrame([], _COVERAGE), spark.createDataFrame([], _REFUTED))
    flags = {(r["table_name"], r["column_name"]): r for r in columns.collect()}
    names = {(t, c) for t, own in kept.items() for c in own}
    keys = {k for k in names if flags[k]["potential_primary_key"]}
    few = {k for k in names if flags[k]["is_categorical"]}
    many = {k for k in names - few if counted.get(k)}
    frames = []
    if few and keys:
        if categories is None:
            categories = category_distribution(tables, {t: [c for c in df.columns if (t, c) in few] for t, df in tables.items()})
        frames.append(_few_valued(tables, columns, few, keys, categories))
    refuted: list[tuple] = []
    if many and keys:
        subset = _selected(tables, many | keys)
        named = {a: (t, c) for a, (t, c) in enumerate((t, c) for t, df in sorted(subset.items()) for c in df.columns)}
        kind = {k: _ordered_value(tables[k[0]], k[1])[0] for k in many | keys if _ordered_value(tables[k[0]], k[1])}
        open_pairs = {(child, parent) for child in many for parent in keys
                      if child[0] != parent[0] and kind.get(child) == kind.get(parent)}
        # one row per pair of columns: schema-sized
        for r in _missing_in_slice(subset, columns, slices).collect():
            child, parent = named[r["child"]], named[r["parent"]]
            if (child, parent) in open_pairs and round_half_up(1 - r["missing"] / counted[child]) < threshold:
                open_pairs.discard((child, parent))
                refuted.append((*child, *parent, r["missing"], r["witness"]))
        if open_pairs:
            rest = _selected(tables, {side for pair in open_pairs for side in pair})
            pairs = spark.createDataFrame([(*child, *parent) for child, parent in open_pairs],
                                          "child_table string, child_column string, parent_table string, parent_column string")
            frames.append(coverage(rest, columns).join(F.broadcast(pairs), pairs.columns, "left_semi"))
    found = reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], _COVERAGE)
    return Inclusion(found, spark.createDataFrame(refuted, _REFUTED))


def round_half_up(share: float, digits: int = 4) -> float:
    """As a profile rounds; a share is never negative."""
    return math.floor(share * 10 ** digits + 0.5 + 1e-9) / 10 ** digits


def discover(tables: Tables, columns: DataFrame, threshold: float = FULL_COVERAGE, categories: DataFrame | None = None) -> DataFrame:
    """Foreign keys of a set of tables; only columns that can matter are counted."""
    return foreign_keys(inclusion(tables, columns, threshold, categories=categories).found, threshold)


def pair_coverage(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Coverage of one child column by one key; 0 when the child holds no value."""
    tables = {"child": child.select(quoted(child_column)), "parent": parent.select(quoted(parent_column))}
    counts = value_counts(tables).filter("family >= 0")
    by_value = counts.groupBy("family", "num", "txt").agg(
        F.sum(F.when(F.col("attr") == 0, F.col("cnt"))).alias("rows"),
        F.max(F.col("attr") == 1).alias("found"))
    total = F.sum("rows")
    hits = F.sum(F.when(F.col("found"), F.col("rows")).otherwise(F.lit(0)))
    return by_value.agg(
        F.coalesce(F.round(hits / F.when(total > 0, total), 4), F.lit(0.0)).alias("coverage"))


def foreign_keys(found: DataFrame, threshold: float = FULL_COVERAGE) -> DataFrame:
    """Best parent of each column whose coverage reaches the threshold; the first parent wins a tie."""
    best = F.min_by(F.struct("parent_table", "parent_column", "coverage"),
                    F.struct(-F.col("coverage"), F.col("parent_rank")))
    return found.filter(F.col("coverage") >= threshold).groupBy("child_table", "child_column").agg(
        best.alias("best")).select("child_table", "child_column", "best.*")


def referenced_keys(links: DataFrame) -> DataFrame:
    """Keys some other table points at."""
    return links.select("parent_table", "parent_column").distinct()


def numerical_columns(columns: DataFrame, links: DataFrame) -> DataFrame:
    """Numeric columns fit for statistics: keys stay in unless another table refers to them."""
    referenced = referenced_keys(links).select(
        F.col("parent_table").alias("table_name"), F.col("parent_column").alias("column_name"))
    return columns.filter("datatype IN ('int', 'float')").join(
        referenced, ["table_name", "column_name"], "left_anti").select(
        "table_name", "column_name", "ordinal")


def categorical_columns(columns: DataFrame) -> DataFrame:
    """Columns with few values that are not keys."""
    return columns.filter("is_categorical AND NOT potential_primary_key").select(
        "table_name", "column_name", "ordinal")
