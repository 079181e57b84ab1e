"""Column types, date strings, canonical cell keys and row fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Labels of a yes / no column, separators of a date string, share of values that must parse.
YES_NO = ("Y", "N")
DATE_SEPARATOR = "[-/:]"
MIN_DATE_SHARE = 0.95

# Layouts tried in this order after the ISO cast, with dashes read as slashes; month-first is read before
# day-first, and a time of day may follow. A layout is only tried on a string of its shape: a failed
# parse is slow.
NUMERIC_SHAPE = "^[0-9]{1,4}/[0-9]{1,2}/[0-9]{1,4}( |$)"
NUMERIC_LAYOUTS = ("M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "M/d/yy", "d/M/yy")
MONTH_NAME_SHAPE = "^([0-9]{1,2}[/ ][A-Za-z]{3}[/ ]|[A-Za-z]{3,9} [0-9]{1,2}, )[0-9]{4}( |$)"
MONTH_NAME_LAYOUTS = ("d/MMM/yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")
TIME_OF_DAY = "[ H:mm[:ss]]"

# No accepted date layout is longer than this many bytes.
MAX_DATE_BYTES = 64
# Longer strings are counted under their first characters and their SHA-256, so a shuffle never carries whole documents.
MAX_KEY_BYTES = 64
KEY_PREFIX = 32
# Families of cell keys that hold strings.
SHORT_TEXT, LONG_TEXT = 1, 4

_TWO_53 = float(2 ** 53)
_TWO_63 = float(2 ** 63)


def name_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(name_sql(name))


def base_type(data_type: T.DataType) -> str | None:
    """int, float, str, bool or datetime; None for anything else (arrays, maps, structs, binary)."""
    if isinstance(data_type, INT_TYPES):
        return "int"
    if isinstance(data_type, FLOAT_TYPES):
        return "float"
    if isinstance(data_type, T.StringType):
        return "str"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, TIME_TYPES):
        return "datetime"
    return None


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: turned into NULL once, at the scan."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floats else quoted(c) for c in df.columns
    ])


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns stored as numbers or booleans, in table order."""
    return [f.name for f in df.schema if base_type(f.dataType) in ("int", "float", "bool")]


def double_sql(df: DataFrame, name: str) -> str:
    """A number or boolean as a double; one text, since every part of a composed column is a call into the JVM."""
    column = name_sql(name)
    return f"CAST(CAST({column} AS INT) AS DOUBLE)" if isinstance(df.schema[name].dataType, T.BooleanType) else f"CAST({column} AS DOUBLE)"


def as_double(df: DataFrame, name: str) -> Column:
    return F.expr(double_sql(df, name))


def _parse_sql(name: str) -> str:
    text = name_sql(name)
    slashed = f"translate(trim({text}), '-', '/')"

    def first_fit(layouts: tuple[str, ...]) -> str:
        return "coalesce(" + ", ".join(
            f"try_to_timestamp({slashed}, '{day}{TIME_OF_DAY}')" for day in layouts) + ")"

    return f"""CASE WHEN octet_length(trim({text})) <= {MAX_DATE_BYTES} THEN coalesce(
        try_cast(trim({text}) AS timestamp),
        CASE WHEN {slashed} RLIKE '{NUMERIC_SHAPE}' THEN {first_fit(NUMERIC_LAYOUTS)}
             WHEN {slashed} RLIKE '{MONTH_NAME_SHAPE}' THEN {first_fit(MONTH_NAME_LAYOUTS)} END) END"""


def parse_datetime(name: str) -> Column:
    """Timestamp read from a string column in any accepted layout, NULL when none fits."""
    return F.expr(_parse_sql(name))


def date_text_sql(name: str) -> str:
    text = name_sql(name)
    return f"""CASE WHEN octet_length(trim({text})) <= {MAX_DATE_BYTES} AND {text} RLIKE '{DATE_SEPARATOR}'
        AND {text} RLIKE '[0-9]' THEN ({_parse_sql(name)}) IS NOT NULL ELSE false END"""


def is_date_text(name: str) -> Column:
    """True when the column's string parses as a date and holds a date separator."""
    return F.expr(date_text_sql(name))


def epoch_micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def cell_sql(df: DataFrame, name: str) -> tuple[str, str, str]:
    """(family, num, txt) under which equal values of any two columns meet.

    Numbers meet numbers (1 = 1.0), strings meet strings, and a number never meets a string. Whole
    numbers a double cannot hold exactly are kept as digits. Both keys are NULL for a NULL cell.
    """
    column, data_type = name_sql(name), df.schema[name].dataType
    kind = base_type(data_type)
    no_num, no_txt = "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)"
    if kind == "bool" or isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType)):
        return "0Y", double_sql(df, name), no_txt
    if isinstance(data_type, T.DecimalType):
        as_num = double_sql(df, name)
        exact = f"CAST({as_num} AS {data_type.simpleString()}) = {column}"
        return (f"CASE WHEN {exact} THEN 0Y ELSE 2Y END", f"CASE WHEN {exact} THEN {as_num} END",
                f"CASE WHEN NOT ({exact}) THEN CAST({column} AS STRING) END")
    if kind in ("int", "float"):
        # compared against both ends: abs() of the smallest long would overflow
        if kind == "int":
            wide, digits = f"({column} >= {2 ** 53}L OR {column} <= {-(2 ** 53)}L)", f"CAST({column} AS STRING)"
        else:
            size = f"abs({double_sql(df, name)})"
            wide = f"({size} >= {_TWO_53!r}D AND {size} < {_TWO_63!r}D)"
            digits = f"CAST(try_cast(CASE WHEN {wide} THEN {column} END AS BIGINT) AS STRING)"
        return (f"CASE WHEN {wide} THEN 2Y ELSE 0Y END", f"CASE WHEN NOT {wide} THEN CAST({column} AS DOUBLE) END",
                f"CASE WHEN {wide} THEN {digits} END")
    if kind == "str":
        short = f"octet_length({column}) <= {MAX_KEY_BYTES}"
        return (f"CASE WHEN {short} THEN {SHORT_TEXT}Y ELSE {LONG_TEXT}Y END", no_num,
                f"CASE WHEN {short} THEN {column} ELSE concat(substring({column}, 1, {KEY_PREFIX}), sha2({column}, 256)) END")
    if kind == "datetime":
        return "3Y", no_num, f"CAST(unix_micros(CAST({column} AS TIMESTAMP)) AS STRING)"
    # value metrics do not apply: only presence is recorded
    return "5Y", no_num, f"CASE WHEN {column} IS NOT NULL THEN '' END"


def cell_key(df: DataFrame, name: str) -> tuple[Column, Column, Column]:
    """`cell_sql` as columns."""
    family, num, txt = cell_sql(df, name)
    return F.expr(family), F.expr(num), F.expr(txt)


def row_fingerprint(df: DataFrame, columns: list[str] | None = None) -> Column:
    """128-bit fingerprint of a row as two numbers; NULL positions are part of it."""
    names = columns or df.columns
    parts = []
    for name in names:
        column = quoted(name)
        if isinstance(df.schema[name].dataType, T.MapType):
            column = F.array_sort(F.map_entries(column))
        parts.append(column)
    nulls = F.concat(*[F.when(quoted(n).isNull(), "1").otherwise("0") for n in names])
    return F.struct(F.xxhash64(nulls, *parts).alias("a"), F.xxhash64(F.lit(1), nulls, *parts).alias("b"))
