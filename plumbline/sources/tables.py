"""Reading, splitting, publishing and querying sets of tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.columns import nan_to_null, quoted
from plumbline.functions.draws import uniform
from plumbline.session import materialize, shared_dir

# Share of clean rows, suffix of new data, rows returned to an ad-hoc query.
CLEAN_SHARE = 0.97
NEW_DATA_SUFFIX = "_new_data"
MAX_ROWS_RETURNED = 100

# Files numbered together, and files whose offsets are sent to every task.
FILES_PER_BUCKET, MAX_FILES_BROADCAST = 10_000, 100_000

ROLES = ("clean", "test", "batch")


def table_name(path: str) -> str:
    """File name before its first dot."""
    return path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Paths in a folder with the given ending, through the Hadoop file system of the folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [str(status.getPath().toString()) for status in system.listStatus(path)]
    return sorted(p for p in found if p.rstrip("/").endswith(suffix))


# Words that mean a missing cell in a CSV file.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and inferred types; quoted fields may hold line breaks.

    A record spread over lines leaves a line with an odd number of quotes. Only files holding one are
    read record by record in one task; all others are split.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    broken = not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()
    text = spark.read.csv(path, header=True, multiLine=broken, quote='"', escape='"')
    if columns:
        text = text.select(*[quoted(c) for c in columns])
    known = text.select(*[
        F.when(~quoted(c).isin(*MISSING_WORDS), quoted(c)).alias(c) for c in text.columns])
    return nan_to_null(_typed(known))


def _typed(text: DataFrame) -> DataFrame:
    """Text columns cast to the narrowest of bigint, double and boolean that fits all their values."""
    tests = {"bigint": "^[+-]?[0-9]+$", "boolean": "^(True|False|TRUE|FALSE|true|false)$"}
    counts = []
    for i, c in enumerate(text.columns):
        counts.append(F.count(quoted(c)).alias(f"n{i}"))
        for kind, pattern in tests.items():
            fits = F.trim(quoted(c)).rlike(pattern) & quoted(c).try_cast(kind).isNotNull()
            counts.append(F.count_if(fits).alias(f"{kind}{i}"))
        counts.append(F.count_if(quoted(c).try_cast("double").isNotNull()).alias(f"double{i}"))
    found = text.agg(*counts).first()
    columns = []
    for i, c in enumerate(text.columns):
        kind = next((k for k in ("bigint", "double", "boolean") if found[f"{k}{i}"] == found[f"n{i}"]), None)
        # a column without a value is a float one
        kind = "double" if found[f"n{i}"] == 0 else kind
        columns.append(quoted(c).try_cast(kind).alias(c) if kind else quoted(c))
    return text.select(*columns)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*[quoted(c) for c in columns]) if columns else df)


def file_offsets(sizes: DataFrame, bucket_files: int = FILES_PER_BUCKET) -> DataFrame:
    """__file, __before: the rows of all files before each file, in the order of their paths, from (__file, __n).

    Files are dealt out by path in stretches of a bounded number; only one sum per stretch is added up across them.
    """
    n = -(-sizes.count() // bucket_files)
    dealt = materialize(sizes.repartitionByRange(max(n, 1), "__file").withColumn("__part", F.spark_partition_id()), "files")
    within = F.coalesce(F.sum("__n").over(
        W.partitionBy("__part").orderBy("__file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row per stretch
    parts = dealt.groupBy("__part").agg(F.sum("__n").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(
        W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return dealt.withColumn("__within", within).join(parts, "__part").select(
        "__file", (F.col("__start") + F.col("__within")).alias("__before"))


def with_row_id(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table with its position as `row_id`: file order, then row order in the file.

    Positions come from the files themselves, so every pass and every retry sees the same ids. A file's number of rows stands in
    its footer: counting by file reads no column. The offsets of up to MAX_FILES_BROADCAST files, a path and a number each, go to
    the rows; of more, rows and offsets are joined by a shuffle.
    """
    raw = spark.read.parquet(path)
    rows = nan_to_null(raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos")))
    sizes = materialize(raw.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count(F.lit(1)).alias("__n")), "file-sizes")
    offsets = materialize(file_offsets(sizes), "file-offsets")
    small = sizes.count() <= MAX_FILES_BROADCAST
    numbered = rows.join(F.broadcast(offsets) if small else offsets, "__file").withColumn("row_id", F.col("__before") + F.col("__pos"))
    return numbered.select(*[quoted(c) for c in raw.columns], "row_id")


def split(df: DataFrame, rows: int, share: float = CLEAN_SHARE, how: str = "position",
          seed: str = "split", key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(clean, test): the first int(rows * share) rows by position, or the rows drawn below the share."""
    if how == "hash":
        first = uniform(seed, quoted(key)) < share
    elif how == "position":
        first = quoted(key) < int(rows * share)
    else:
        raise ValueError(f"unknown split: {how}")
    return df.filter(first), df.filter(~first)


def ingest(spark: SparkSession, source: str, target: str, fmt: str = "csv",
           columns: dict[str, list[str]] | None = None, how: str = "position") -> list[str]:
    """Every file of a folder becomes a table: clean and test copies below `target`, replaced if present.

    The source is converted to parquet first, in the shared folder; row ids and the split then rest on
    those files.
    """
    columns, names = columns or {}, []
    for path in list_files(spark, source, f".{fmt}"):
        name = table_name(path)
        read = read_csv if fmt == "csv" else read_parquet
        staged = f"{shared_dir(spark).rstrip('/')}/plumbline/ingest-{uuid.uuid4().hex}/{name}"
        read(spark, path, columns.get(name)).write.parquet(staged)
        df = with_row_id(spark, staged)
        clean, test = split(df, df.count(), how=how)
        write_table(clean, target, "clean", name)
        write_table(test, target, "test", name)
        names.append(name)
    return names


def write_table(df: DataFrame, target: str, role: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{role}/{name}")


def load_tables(spark: SparkSession, target: str, role: str = "clean") -> dict[str, DataFrame]:
    """All tables of one role."""
    folder = f"{target.rstrip('/')}/{role}"
    return {table_name(p): spark.read.parquet(p) for p in list_files(spark, folder, "")}


def publish(clean: dict[str, DataFrame], batch: dict[str, DataFrame]) -> list[str]:
    """Temp views for an investigation: each table under its name, its new rows as `<name>_new_data`."""
    for name, df in clean.items():
        df.createOrReplaceTempView(name)
    for name, df in batch.items():
        df.createOrReplaceTempView(f"{name}{NEW_DATA_SUFFIX}")
    return sorted(clean) + sorted(f"{n}{NEW_DATA_SUFFIX}" for n in batch)


def catalog(spark: SparkSession, tables_only: bool = False) -> list[tuple[str, str]]:
    """(name, type) of the tables and views in the session's catalog."""
    found = []
    for entry in spark.catalog.listTables():
        kind = "view" if entry.tableType in ("VIEW", "TEMPORARY") else "table"
        if kind == "table" or not tables_only:
            found.append((entry.name, kind))
    return sorted(found)


def whole_column(clean: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """One column over clean and test rows: a key may sit on the other side of the split."""
    return clean.select(quoted(column)).unionByName(test.select(quoted(column)))


def joined_view(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], columns: list[str],
                where: Column, limit: int, order: list[str]) -> DataFrame:
    """Left join, filter, first rows in key order — a top-k, so no full sort takes place."""
    condition = [left[a] == right[b] for a, b in on]
    return left.join(right, condition, "left").filter(where).select(*columns).orderBy(*order).limit(limit)


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


# What a SELECT may hold beside names: strings and comments.
_SPOKEN = re.compile(r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|--[^\n]*|/\*.*?\*/""", re.S)
# Functions that call any static method of the JVM, and relations that are files named in the statement.
_CALLS = re.compile(r"(?i)\b(java_method|reflect|try_reflect)\b`?\s*\(")
_FILES = re.compile(r"(?i)\b(parquet|json|csv|orc|text|avro|xml|binaryfile)`?\s*\.\s*`")


def bounded_query(spark: SparkSession, query: str, max_rows: int) -> DataFrame:
    """The first `max_rows` rows of one SELECT statement over the catalog's tables and views; anything else is refused."""
    text = query.strip().rstrip(";").strip()
    if not re.match(r"(?i)select\b", text):
        raise ValueError("a statement must be a SELECT")
    spoken = _SPOKEN.sub(" ", text)
    if _CALLS.search(spoken):
        raise ValueError("a statement must not call methods of the JVM")
    if _FILES.search(spoken):
        raise ValueError("a statement must not name files")
    return spark.sql(f"SELECT * FROM ({text}) LIMIT {int(max_rows)}")


def run_query(spark: SparkSession, query: str, max_rows: int = MAX_ROWS_RETURNED) -> dict:
    """Rows, their number and whether there were more, or the error as data so that a caller can mend the query."""
    try:
        rows = [r.asDict() for r in bounded_query(spark, query, max_rows + 1).collect()]
    except Exception as error:  # noqa: BLE001 - handed back to the caller
        prefix = "" if isinstance(error, ValueError) else "not executed: "
        return {"error": f"{prefix}{error}"}
    kept = rows[:max_rows]
    return {"nb_rows_returned": len(kept), "truncated": len(rows) > max_rows, "rows": kept}
