"""Ten labelled corruptions, DataFrame to DataFrame.

Each function marks the rows it changed in a boolean column (`hit`), so that the pass that writes the
table can count them, and picks rows and values by draws on the row's own key. Changes that need only
the row stay one projection; those that need other rows move just the rows that were picked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import base_type, quoted
from plumbline.functions.draws import digest, pick, uniform
from plumbline.functions.numbering import BUCKET_ROWS, number_rows
from plumbline.session import materialize

# Labels written as new categories, range of the dates written into other columns.
NEW_LABELS = ["UNKNOWN", "N/A", "-99999", "TO_BE_DEFINED", "OTHER", "Not available", "Not applicable"]
FIRST_DATE, DATE_SPAN_DAYS = "2000-01-01 00:00:00", 18627
KEY_CHARACTERS = "0123456789abcdefghijklmnopqrstuvwxyz"
DATA_TYPES = ("int", "float", "bool", "str", "datetime")

# Characters changed by each candidate key; a key none of them frees is lengthened past every parent.
CANDIDATE_EDITS = (1, 1, 1, 2, 2, 3, 5, 8)
# Keys whose candidates a task makes: a key is a few bytes, its candidates are work.
KEYS_PER_TASK = 10_000


def picked(rate: float, seed: str, key: str = "row_id") -> Column:
    return uniform(seed, quoted(key)) < F.lit(float(rate))


def _replace(df: DataFrame, changes: dict[str, Column], hit: str, mask: Column,
             extra: dict[str, Column] | None = None) -> DataFrame:
    columns = [changes[c].alias(c) if c in changes else quoted(c) for c in df.columns]
    columns += [c.alias(name) for name, c in (extra or {}).items()]
    return df.select(*columns, mask.alias(hit))


def _split(df: DataFrame, mask: Column, hit: str) -> tuple[DataFrame, DataFrame]:
    return df.filter(mask).withColumn(hit, F.lit(True)), df.filter(~mask).withColumn(hit, F.lit(False))


# --- changes within the row ---------------------------------------------------------------------------

def insert_null(df: DataFrame, column: str, rate: float, seed: str, key: str = "row_id",
                hit: str = "hit") -> DataFrame:
    mask = picked(rate, seed, key) & quoted(column).isNotNull()
    return _replace(df, {column: F.when(~mask, quoted(column))}, hit, mask)


def new_category(df: DataFrame, column: str, label: str, rate: float, seed: str, key: str = "row_id",
                 hit: str = "hit") -> DataFrame:
    mask = picked(rate, seed, key)
    return _replace(df, {column: F.when(mask, F.lit(label)).otherwise(quoted(column))}, hit, mask)


def insert_column(df: DataFrame, column: str, hit: str = "hit") -> DataFrame:
    """A copy of a column under a new name; the caller checks that the name is free."""
    return _replace(df, {}, hit, F.lit(True), {f"NEW_{column}": quoted(column)})


def duplicate_rows(df: DataFrame, rate: float, seed: str, key: str = "row_id", hit: str = "hit",
                   earlier_hits: tuple[str, ...] = ()) -> DataFrame:
    """Each picked row appears twice. The copy takes the key -1 - key, and counts for this change only."""
    copies = F.explode(F.sequence(F.lit(0), F.when(picked(rate, seed, key), 1).otherwise(0)))
    expanded = df.withColumn("__copy", copies)
    is_copy = F.col("__copy") == 1
    columns = []
    for c in df.columns:
        if c == key:
            columns.append(F.when(is_copy, F.lit(-1) - quoted(c)).otherwise(quoted(c)).alias(c))
        elif c in earlier_hits:
            columns.append((quoted(c) & ~is_copy).alias(c))
        else:
            columns.append(quoted(c))
    return expanded.select(*columns, is_copy.alias(hit))


def in_row_order(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows in table order, each copy after its original."""
    k = quoted(key)
    return df.orderBy(F.when(k < 0, F.lit(-1) - k).otherwise(k), k.desc())


def distribution_shift(df: DataFrame, column: str, amount: float, mode: str, direction: int | None,
                       low: float, high: float, rate: float, seed: str, whole: bool = False,
                       key: str = "row_id", hit: str = "hit") -> DataFrame:
    """Values moved by `amount`, all one way ("shift") or each its own way ("spread"), within [low, high].

    Adds `<hit>_clamped`, true where the bound stopped the move.
    """
    value = quoted(column).cast("double")
    mask = picked(rate, seed, key) & quoted(column).isNotNull()
    sign = F.lit(float(direction)) if mode == "shift" else (
        F.when(uniform(seed, quoted(key), slot=1) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0)))
    moved = value + sign * F.lit(float(amount))
    kept = F.least(F.greatest(moved, F.lit(float(low))), F.lit(float(high)))
    data_type = df.schema[column].dataType
    final = F.bround(kept).cast("bigint") if whole else kept
    changed = F.when(mask, final.cast(data_type)).otherwise(quoted(column))
    return _replace(df, {column: changed}, hit, mask, {f"{hit}_clamped": mask & (kept != moved)})


def out_of_range(df: DataFrame, column: str, low: float, high: float, reach: float, direction: str,
                 rate: float, seed: str, whole: bool = False, key: str = "row_id",
                 hit: str = "hit") -> DataFrame:
    """Values pushed past a bound by 5 % to 100 % of `reach`; whole numbers round away from the bound.

    Adds `<hit>_below`, true where the lower bound was breached. Whole columns widen to bigint.
    """
    mask = picked(rate, seed, key) & quoted(column).isNotNull()
    below = {"below_min": F.lit(True), "above_max": F.lit(False)}.get(
        direction, uniform(seed, quoted(key), slot=1) < 0.5)
    distance = (F.lit(0.05) + F.lit(0.95) * uniform(seed, quoted(key), slot=2)) * F.lit(float(reach))
    lower, upper = F.lit(float(low)) - distance, F.lit(float(high)) + distance
    if whole:
        target = "bigint"
        value = F.when(below, F.floor(lower)).otherwise(F.ceil(upper)).cast(target)
    else:
        data_type = df.schema[column].dataType
        target = "double" if isinstance(data_type, T.DecimalType) else data_type
        value = F.when(below, lower).otherwise(upper).cast(target)
    changed = F.when(mask, value).otherwise(quoted(column).cast(target))
    return _replace(df, {column: changed}, hit, mask, {f"{hit}_below": mask & below})


def type_column(column: str) -> str:
    """Name of the companion holding the type of each value of a mixed column."""
    return f"{column}__type"


def wrong_datatype(df: DataFrame, column: str, current: str | None, new: str, rate: float, seed: str,
                   key: str = "row_id", hit: str = "hit") -> DataFrame:
    """Values of another type in a column, which becomes text with a companion naming each value's type.

    A number turned into text keeps its digits, so only the companion tells it apart.
    """
    mask = picked(rate, seed, key)
    own_type = F.when(quoted(column).isNotNull(), F.lit(current))
    draw = uniform(seed, quoted(key), slot=1)
    if new == "datetime":
        return _dates_into(df, column, own_type, mask, key, hit)
    if new == "str" and current in ("int", "float"):
        value = F.coalesce(quoted(column).cast("string"), F.lit("nan"))
    elif new in ("int", "str"):
        value = F.floor(draw * 101).cast("bigint").cast("string")
    elif new == "bool":
        value = F.floor(draw * 2).cast("bigint").cast("string")
    else:
        value = F.format_string("%.5f", F.round(draw, 5))
    text = F.when(mask, value).otherwise(quoted(column).cast("string"))
    companion = F.when(mask, F.lit(new)).otherwise(own_type)
    return _replace(df, {column: text}, hit, mask, {type_column(column): companion})


def _dates_into(df: DataFrame, column: str, own_type: Column, mask: Column, key: str,
                hit: str) -> DataFrame:
    """Evenly spaced dates over the picked rows, in row order."""
    hits, rest = _split(df, mask, hit)
    order = F.when(quoted(key) < 0, F.lit(-1) - quoted(key)).otherwise(quoted(key))
    numbered = number_rows(hits.withColumn("__order", order), ["__order", key], "__n",
                           bucket=F.floor(F.col("__order") / F.lit(BUCKET_ROWS)))
    last = max(hits.count() - 1, 1)
    seconds = F.floor(F.col("__n") * F.lit(DATE_SPAN_DAYS * 86400) / F.lit(last)).cast("bigint")
    start = F.unix_seconds(F.lit(FIRST_DATE).cast("timestamp"))
    date = F.date_format(F.timestamp_seconds(start + seconds), "yyyy-MM-dd HH:mm:ss")
    companion = type_column(column)
    hits = numbered.withColumn(column, date).withColumn(companion, F.lit("datetime"))
    rest = rest.withColumn(companion, own_type).withColumn(column, quoted(column).cast("string"))
    return rest.unionByName(hits.drop("__n", "__order")).select(
        *[quoted(c) for c in df.columns], companion, hit)


# --- changes that need other rows -----------------------------------------------------------------------

def correlation_break(df: DataFrame, column: str, rate: float, seed: str, key: str = "row_id",
                      hit: str = "hit", buckets: int | None = None) -> DataFrame:
    """Values of a column permuted among the picked rows.

    Picked rows fall into random buckets of bounded size, are put in random order within their bucket,
    and each takes its successor's value (the last takes the first's): the values are kept, the pairing
    with other columns is not, and no join is needed.
    """
    hits, rest = _split(df, picked(rate, seed, key), hit)
    if buckets is None:
        buckets = -(-hits.count() // BUCKET_ROWS)
    place = pick(seed, max(buckets, 1), quoted(key), slot=1)
    keyed = hits.withColumn("__bucket", place).withColumn("__order", digest(seed, quoted(key)))
    window = W.partitionBy("__bucket").orderBy("__order", key)
    whole = W.partitionBy("__bucket").orderBy("__order", key).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    # the successor's value wrapped in a struct, so that a NULL value differs from "no successor"
    following = F.lead(F.struct(quoted(column).alias("v"))).over(window)
    first = F.first(F.struct(quoted(column).alias("v"))).over(whole)
    moved = keyed.withColumn("__next", F.coalesce(following, first)["v"])
    moved = moved.withColumn(column, F.col("__next")).drop("__next", "__bucket", "__order")
    return rest.unionByName(moved).select(*[quoted(c) for c in df.columns], hit)


def duplicate_primary_key(df: DataFrame, column: str, rate: float, seed: str, key: str = "row_id",
                          hit: str = "hit") -> DataFrame:
    """Picked rows take a key drawn, with replacement, from the distinct keys of the other rows.

    Donor keys are numbered 0..n-1 in their order, sorted range by range; a row draws a number and finds its key
    by an equi-join on it. No donor, no change.
    """
    mask = picked(rate, seed, key)
    donors = df.filter(~mask & quoted(column).isNotNull()).select(quoted(column).alias("__donor")).distinct()
    total = donors.count()
    if total == 0:
        return df.withColumn(hit, F.lit(False))
    buckets = -(-total // BUCKET_ROWS)
    place = F.lit(0)
    if buckets > 1:
        # ranges are drawn anew by every pass over the keys: written once, each key stays in its range
        donors = materialize(donors.repartitionByRange(buckets, "__donor").withColumn("__range", F.spark_partition_id()), "donors")
        place = F.col("__range")
    numbered = number_rows(donors, ["__donor"], "__n", bucket=place).drop("__range")
    hits, rest = _split(df, mask, hit)
    drawn = hits.withColumn("__n", pick(seed, total, quoted(key), slot=1))
    moved = drawn.join(numbered, "__n").withColumn(column, F.col("__donor")).drop("__n", "__donor")
    return rest.unionByName(moved).select(*[quoted(c) for c in df.columns], hit)


def _candidates(keys: DataFrame, digits_only: bool, seed: str) -> DataFrame:
    """old_key, number, form: edited forms of each key, two characters swapped or some inserted."""
    text, number = F.col("text"), F.col("number")
    edits = F.element_at(F.array(*[F.lit(e) for e in CANDIDATE_EDITS]), number + 1)
    spots = F.sequence(F.lit(1), F.length(text))
    if digits_only:
        spots = F.filter(spots, lambda p: text.substr(p, F.lit(1)).between("0", "9"))
    tried = (
        keys.select("old_key", F.col("old_key").cast("string").alias("text")).filter("length(text) > 0")
        .withColumn("spots", spots).withColumn("room", F.size("spots")).filter("room > 0")
        .withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(len(CANDIDATE_EDITS) - 1))))
        .withColumn("edits", edits)
        .select("*", *[uniform(seed, text, number, slot=slot).alias(f"u{slot}") for slot in range(3)])
        .withColumn("first", F.floor(F.col("u1") * F.col("room")).cast("int"))
        .withColumn("second", F.expr("(first + 1 + cast(floor(u2 * (room - 1)) as int)) % room"))
        .withColumn("a", F.expr("get(spots, least(first, second))"))
        .withColumn("b", F.expr("get(spots, greatest(first, second))"))
        .withColumn("spot", F.expr("get(spots, first)")))
    if digits_only:
        added = F.expr("lpad(cast(cast(floor(u2 * power(10, edits)) as bigint) as string), edits, '0')")
    else:
        letter = F.expr(f"substr('{KEY_CHARACTERS}', cast(floor(u2 * 36) as int) + 1, 1)")
        added = F.when(F.col("edits") > 1, digest(seed, text, number).substr(F.lit(1), F.col("edits"))).otherwise(
            F.when(F.col("u0") >= 0.75, F.upper(letter)).otherwise(letter))
    swapped = F.expr("concat(substr(text, 1, a - 1), substr(text, b, 1), substr(text, a + 1, b - a - 1), "
                     "substr(text, a, 1), substr(text, b + 1))")
    longer = F.concat(F.expr("substr(text, 1, spot - 1)"), F.col("added"), F.expr("substr(text, spot)"))
    swap = (F.col("edits") == 1) & (F.col("u0") < 0.5) & (F.col("room") > 1)
    return tried.withColumn("added", added).select(
        "old_key", "number", F.when(swap, swapped).otherwise(longer).alias("form"))


def orphan_key_type(data_type: T.DataType) -> str | None:
    """Type a changed key is stored as; None when a key of this type cannot be rebuilt from its text."""
    return {"str": "string", "int": "bigint", "float": "double"}.get(base_type(data_type))


def orphan_key_map(keys: DataFrame, parents: DataFrame, seed: str) -> DataFrame:
    """old_key, new_key: for each distinct key one edited key that is no parent key.

    Every candidate is checked by one anti-join and the first free one is taken. Dense parents can hold
    all candidates of a short key; such a key is lengthened, or raised, past every parent.
    """
    kind = orphan_key_type(keys.schema[0].dataType)
    name, parent_name = keys.columns[0], parents.columns[0]
    old = materialize(keys.select(quoted(name).cast(kind).alias("old_key")).distinct(), "old-keys")
    dealt = old.repartition(max(1, -(-old.count() // KEYS_PER_TASK)), "old_key")
    known = parents.select(quoted(parent_name).alias("new_key")).filter("new_key IS NOT NULL")
    if base_type(parents.schema[0].dataType) != base_type(keys.schema[0].dataType):
        # int and float keys meet as doubles; a string never equals a number
        numeric = {base_type(parents.schema[0].dataType), base_type(keys.schema[0].dataType)} == {"int", "float"}
        known = known.select(F.col("new_key").cast("double")) if numeric else known.limit(0).select(
            F.col("new_key").cast(kind))
    tried = _candidates(dealt, kind != "string", seed).select(
        "old_key", "number", F.col("form").try_cast(kind).alias("new_key")).filter(
        "new_key IS NOT NULL AND new_key <> old_key")
    free = tried.join(known, "new_key", "left_anti").groupBy("old_key").agg(
        F.min_by("new_key", "number").alias("new_key"))
    # read again to number the keys that are left, and by the rows
    found = materialize(old.join(free, "old_key", "left"), "new-keys")
    if kind == "string":
        longest = known.agg(F.max(F.length("new_key"))).first()[0] or 0
        # the mark keeps apart keys of which one begins with the other
        beyond = F.concat("old_key", F.lit("x"), F.repeat(F.lit("0"), F.greatest(F.lit(longest) - F.length("old_key"), F.lit(0))))
        return found.select("old_key", F.coalesce("new_key", beyond).alias("new_key"))
    # above every key there is, one apart
    tops = known.agg(F.max("new_key").cast(kind)).first()[0], old.agg(F.max("old_key")).first()[0]
    top = max((v for v in tops if v is not None), default=0)
    taken = number_rows(found.filter("new_key IS NULL").select("old_key"), ["old_key"], "place").select(
        "old_key", F.try_add(F.lit(top).cast(kind), F.col("place").cast(kind) + 1).cast(kind).alias("beyond"))
    return found.join(taken, "old_key", "left").select("old_key", F.coalesce("new_key", "beyond").alias("new_key"))


def orphan_foreign_key(df: DataFrame, column: str, parents: DataFrame, rate: float, seed: str,
                       key: str = "row_id", hit: str = "hit") -> DataFrame:
    """Picked keys edited until no parent row holds them; equal keys stay equal.

    `parents` is the key column of the uncorrupted parent, clean and new rows together.
    """
    kind = orphan_key_type(df.schema[column].dataType)
    if kind is None:
        raise TypeError(f"{column}: keys of this type cannot be edited as text")
    hits, rest = _split(df, picked(rate, seed, key) & quoted(column).isNotNull(), hit)
    mapping = orphan_key_map(hits.select(quoted(column)), parents, seed)
    cast = hits.withColumn(column, quoted(column).cast(kind))
    moved = cast.join(mapping, quoted(column) == F.col("old_key")).withColumn(
        hit, F.col("new_key").isNotNull()).withColumn(column, F.coalesce("new_key", "old_key"))
    rest = rest.withColumn(column, quoted(column).cast(kind))
    return rest.unionByName(moved.drop("old_key", "new_key")).select(*[quoted(c) for c in df.columns], hit)
