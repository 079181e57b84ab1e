"""One round of corruption: decide on the driver from the profile, apply on the cluster, log.

Deciding reads schema-sized metadata only. The same seed, profile and batch give the same round.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import base_type, quoted
from plumbline.functions.moments import safe_corr
from plumbline.operators import corruption as ops
from plumbline.operators.detection import Context, data_columns
from plumbline.operators.profile_store import TableProfile
from plumbline.session import each, materialize
from plumbline.sources import logs

# The anomalies in their usual order, the errors per table, the sizes of a shift.
ANOMALIES = (
    "wrong_datatype", "insert_null", "duplicate_rows", "insert_column", "orphan_foreign_key",
    "new_category", "correlation_break", "duplicate_primary_key", "distribution_shift", "out_of_range",
)
MAX_ERRORS_PER_TABLE = 5
SHIFTS_IN_STD = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
MIN_CORRELATION = 0.3

# Changes that shuffle rows: their result is written before the next change builds on it.
_SHUFFLING = ("orphan_foreign_key", "correlation_break", "duplicate_primary_key")


@dataclass
class Change:
    """A decided corruption."""

    anomaly: str
    column: str
    settings: dict
    params: dict = field(default_factory=dict)
    partners: tuple[str, ...] = ()


@dataclass
class Round:
    """Corrupted batches by table, and the rows for the two logs."""

    batch: dict[str, DataFrame]
    injections: list[tuple]
    failures: list[tuple]

    def injection_log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.injections, logs.INJECTION_LOG)

    def failure_log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.failures, logs.FAILURE_LOG)


def choose_tables(names: list[str], rng: random.Random) -> list[str]:
    """None to all of the tables, without repeats."""
    return rng.sample(sorted(names), rng.randint(0, len(names)))


def choose_anomalies(rng: random.Random) -> list[str]:
    """None to five anomalies, repeats allowed."""
    return rng.choices(ANOMALIES, k=rng.randint(0, MAX_ERRORS_PER_TABLE))


# --- deciding ----------------------------------------------------------------------------------------

def _wrong_datatype(df: DataFrame, profile: TableProfile, rng: random.Random) -> Change | None:
    columns = [c for c, p in profile.columns.items()
               if c in df.columns and not p.potential_primary_key and p.datatype is not None]
    if not columns:
        return None
    column = rng.choice(columns)
    current = profile.columns[column].datatype
    new = rng.choice([t for t in ops.DATA_TYPES if t != current])
    return Change("wrong_datatype", column, {"current": current, "new": new, "rate": rng.random()},
                  {"type_before": current, "type_after": new})


def _insert_null(df: DataFrame, profile: TableProfile, rng: random.Random) -> Change | None:
    columns = [c for c, p in profile.columns.items() if c in df.columns and not p.null_values]
    return Change("insert_null", rng.choice(columns), {"rate": rng.random()}) if columns else None


def _duplicate_rows(df: DataFrame, profile: TableProfile, rng: random.Random) -> Change | None:
    return Change("duplicate_rows", "", {"rate": rng.random()})


def _insert_column(df: DataFrame, profile: TableProfile, rng: random.Random) -> Change | None:
    column = rng.choice([c for c in data_columns(df) if not c.startswith("__hit_")])
    name = f"NEW_{column}"
    return None if name in df.columns else Change("insert_column", column, {}, {"added_column": name})


def _orphan_foreign_key(df: DataFrame, profile: TableProfile, rng: random.Random) -> Change | None:
    columns = [c for c in profile.foreign_keys if c in df.columns]
    if not columns:
        return None
    column = rng.choice(columns)
    if ops.orphan_key_type(df.schema[column].dataType) is None:
        return None
    link = profile.foreign_keys[column]
    return Change("orphan_foreign_key", column, {"rate": rng.random()}, {
        "parent_table": link.parent_table, "parent_column": link.parent_column,
        "former_coverage": link.coverage})


def _new_category(df: DataFrame, profile: TableProfile, rng: random.Random) -> Change | None:
    columns = [c for c, p in profile.columns.items() if c in df.columns and p.datatype == "str"
               and p.is_categorical and not p.potential_primary_key]
    if not columns:
        return None
    column = rng.choice(columns)
    known = set(profile.columns[column].categories)
    # at most as many rows as there are labels
    known |= {r[0] for r in df.filter(quoted(column).isin(*ops.NEW_LABELS)).select(quoted(column)).distinct().collect()}
    labels = [label for label in ops.NEW_LABELS if label not in known]
    if not labels:
        return None
    label = rng.choice(labels)
    return Change("new_category", column, {"label": label, "rate": rng.random()}, {
        "new_label": label, "labels_known": sorted(profile.columns[column].categories)})


def _correlation_break(df: DataFrame, profile: TableProfile, rng: random.Random) -> Change | None:
    pairs = [(a, b, r) for a, b, r in profile.correlations
             if abs(r) >= MIN_CORRELATION and {a, b} <= set(df.columns)]
    if not pairs:
        return None
    a, b, r = rng.choice(pairs)
    paired, column = rng.sample([a, b], 2)
    return Change("correlation_break", column, {"rate": rng.random()},
                  {"col_paired": paired, "calibrated_correlation": r}, (paired,))


def _duplicate_primary_key(df: DataFrame, profile: TableProfile, rng: random.Random) -> Change | None:
    columns = [c for c, p in profile.columns.items() if p.potential_primary_key and c in df.columns]
    return Change("duplicate_primary_key", rng.choice(columns), {"rate": rng.random()}) if columns else None


def _distribution_shift(df: DataFrame, profile: TableProfile, rng: random.Random) -> Change | None:
    columns = [c for c, p in profile.columns.items()
               if c in df.columns and p.is_numeric_value and p.has("std", "min", "max")]
    if not columns:
        return None
    column = rng.choice(columns)
    known = profile.columns[column]
    sizes, mode = rng.choice(SHIFTS_IN_STD), rng.choice(["shift", "spread"])
    direction = rng.choice([-1, 1]) if mode == "shift" else None
    stats = known.distribution
    return Change("distribution_shift", column, {
        "amount": sizes * stats["std"], "mode": mode, "direction": direction, "low": stats["min"],
        "high": stats["max"], "rate": rng.random(), "whole": known.datatype == "int",
    }, {"calibrated_mean": stats.get("mean"), "calibrated_std": stats["std"], "calibrated_min": stats["min"],
        "calibrated_max": stats["max"], "shift_in_std": sizes, "mode": mode, "direction": direction,
        "shift_applied": sizes * stats["std"]})


def _out_of_range(df: DataFrame, profile: TableProfile, rng: random.Random) -> Change | None:
    columns = [c for c, p in profile.columns.items()
               if c in df.columns and p.is_numeric_value and p.has("min", "max")]
    if not columns:
        return None
    column = rng.choice(columns)
    low, high = (profile.columns[column].distribution[s] for s in ("min", "max"))
    width = (high - low) or abs(high) or 1.0
    reach = rng.uniform(0.01, 0.5) * width
    direction = rng.choice(["below_min", "above_max", "both"])
    return Change("out_of_range", column, {
        "low": low, "high": high, "reach": reach, "direction": direction, "rate": rng.uniform(0.001, 0.05),
        "whole": profile.columns[column].datatype == "int",
    }, {"calibrated_min": low, "calibrated_max": high, "direction": direction,
        "reach_past_bound": round(reach, 4)})


CHOOSERS: dict[str, Callable[[DataFrame, TableProfile, random.Random], Change | None]] = {
    "wrong_datatype": _wrong_datatype, "insert_null": _insert_null, "duplicate_rows": _duplicate_rows,
    "insert_column": _insert_column, "orphan_foreign_key": _orphan_foreign_key,
    "new_category": _new_category, "correlation_break": _correlation_break,
    "duplicate_primary_key": _duplicate_primary_key, "distribution_shift": _distribution_shift,
    "out_of_range": _out_of_range,
}


# --- applying ----------------------------------------------------------------------------------------

def apply_change(df: DataFrame, change: Change, seed: str, hit: str, context: Context | None = None,
                 key: str = "row_id") -> DataFrame:
    """The changed table with the boolean column `hit`."""
    settings = {"seed": seed, "hit": hit, "key": key, **change.settings}
    if change.anomaly == "duplicate_rows":
        earlier = tuple(c for c in df.columns if c.startswith("__hit_"))
        return ops.duplicate_rows(df, earlier_hits=earlier, **settings)
    if change.anomaly == "insert_column":
        return ops.insert_column(df, change.column, hit)
    if change.anomaly == "orphan_foreign_key":
        parent, column = change.params["parent_table"], change.params["parent_column"]
        sides = [p.select(quoted(column)) for p in (context or Context()).holders(parent)]
        parents = sides[0]
        for side in sides[1:]:
            parents = parents.union(side)
        return ops.orphan_foreign_key(df, change.column, parents, **settings)
    function = {
        "wrong_datatype": ops.wrong_datatype, "insert_null": ops.insert_null,
        "new_category": ops.new_category, "correlation_break": ops.correlation_break,
        "duplicate_primary_key": ops.duplicate_primary_key,
        "distribution_shift": ops.distribution_shift, "out_of_range": ops.out_of_range,
    }[change.anomaly]
    return function(df, change.column, **settings)


def _before(df: DataFrame, change: Change, seed: str, key: str) -> dict:
    """What the log keeps of a column before it is changed."""
    if change.anomaly == "correlation_break":
        r = safe_corr(quoted(change.params["col_paired"]).cast("double"), quoted(change.column).cast("double"))
        return df.agg(F.round(r, 4).alias("r_before")).first().asDict()
    if change.anomaly == "distribution_shift":
        value = F.when(ops.picked(change.settings["rate"], seed, key), quoted(change.column).cast("double"))
        return df.agg(F.round(F.avg(value), 4).alias("former_mean"),
                      F.round(F.stddev_samp(value), 4).alias("former_std")).first().asDict()
    if change.anomaly == "duplicate_primary_key":
        # distinct keys by one grouping, not by a set in a single reducer
        return {"nb_unique_keys_before": df.filter(quoted(change.column).isNotNull())
                .select(quoted(change.column)).distinct().count()}
    return {}


def _after(staged: DataFrame, change: Change, hit: str) -> dict:
    """What the log keeps of a column after it was changed."""
    if change.anomaly == "insert_null":
        return {"nb_nulls_in_column": staged.filter(quoted(change.column).isNull()).count()}
    if change.anomaly == "correlation_break":
        if base_type(staged.schema[change.params["col_paired"]].dataType) == "str":
            return {}
        r = safe_corr(quoted(change.params["col_paired"]).cast("double"), quoted(change.column).cast("double"))
        return staged.agg(F.round(r, 4).alias("r_after")).first().asDict()
    if change.anomaly == "distribution_shift":
        value = F.when(F.col(hit), quoted(change.column).cast("double"))
        return staged.agg(
            F.round(F.avg(value), 4).alias("new_mean"), F.round(F.stddev_samp(value), 4).alias("new_std"),
            F.count_if(F.col(f"{hit}_clamped")).alias("nb_values_clamped")).first().asDict()
    if change.anomaly == "out_of_range":
        value = quoted(change.column).cast("double")
        return staged.agg(
            F.count_if(F.col(hit) & F.col(f"{hit}_below")).alias("nb_below_min"),
            F.count_if(F.col(hit) & ~F.col(f"{hit}_below")).alias("nb_above_max"),
            F.round(F.min(value), 4).alias("new_min"), F.round(F.max(value), 4).alias("new_max")).first().asDict()
    if change.anomaly == "duplicate_primary_key":
        per_key = staged.filter(quoted(change.column).isNotNull()).groupBy(quoted(change.column)).count()
        return {"nb_keys_duplicated": per_key.filter("count > 1").count()}
    return {}


def _chain(df: DataFrame, steps: list[tuple[int, Change]], seed: str, context: Context | None, key: str,
           notes: dict[int, dict]) -> DataFrame:
    for number, change in steps:
        step_seed = f"{seed}/{number}"
        if number not in notes:
            notes[number] = _before(df, change, step_seed, key)
        df = apply_change(df, change, step_seed, f"__hit_{number}", context, key)
        if change.anomaly in _SHUFFLING:
            df = materialize(df, f"step-{number}")
    return df


def corrupt_table(batch: DataFrame, profile: TableProfile, anomalies: list[str], seed: str,
                  context: Context | None = None, key: str = "row_id",
                  ) -> tuple[DataFrame, list[tuple[Change, int, int]], list[tuple[str, str]]]:
    """(corrupted batch, [(change, rows affected, rows before)], [(anomaly, error)]).

    A column is hit at most once. A change that finds no row is undone: the others are applied again
    without it, which the repeatable draws make the same change.
    """
    rng = random.Random(seed)
    used: set[str] = set()
    steps: list[tuple[int, Change]] = []
    failures: list[tuple[str, str]] = []
    notes: dict[int, dict] = {}
    planned = batch
    for number, anomaly in enumerate(anomalies):
        if anomaly == "duplicate_rows" and any(c.anomaly == anomaly for _, c in steps):
            continue
        try:
            change = CHOOSERS[anomaly](planned, profile, rng)
            if change is None or (change.column and change.column in used) or used & set(change.partners):
                continue
            planned = _chain(planned, [(number, change)], seed, context, key, notes)
        except Exception as error:  # noqa: BLE001 - recorded, and the round goes on
            failures.append((anomaly, f"{type(error).__name__}: {error}"))
            continue
        steps.append((number, change))
        used |= {change.column, *change.partners} - {""}
    if not steps:
        return batch, [], failures

    rows = batch.count()
    try:
        staged, counts = _count_hits(planned, steps)
        if any(counts[n] == 0 for n, _ in steps):
            steps = [(n, c) for n, c in steps if counts[n] > 0]
            if not steps:
                return batch, [], failures
            staged, counts = _count_hits(_chain(batch, steps, seed, context, key, notes), steps)
        done = []
        for number, change in steps:
            change.params.update(notes[number])
            change.params.update(_after(staged, change, f"__hit_{number}"))
            change.params["total_nb_rows"] = rows
            if "rate" in change.settings:
                change.params["threshold"] = round(change.settings["rate"], 4)
            done.append((change, counts[number], rows))
    except Exception as error:  # noqa: BLE001 - the batch is published unchanged
        return batch, [], failures + [(c.anomaly, f"{type(error).__name__}: {error}") for _, c in steps]
    return staged.drop(*[c for c in staged.columns if c.startswith("__hit_")]), done, failures


def _count_hits(df: DataFrame, steps: list[tuple[int, Change]]) -> tuple[DataFrame, dict[int, int]]:
    """The written table and the rows each change hit, counted in the pass that writes them."""
    seen = Observation()
    staged = materialize(df.observe(seen, *[F.count_if(F.col(f"__hit_{n}")).alias(f"n{n}") for n, _ in steps]), "batch")
    found = seen.get
    return staged, {n: int(found[f"n{n}"]) for n, _ in steps}


def run_round(run_number: int, clean: dict[str, DataFrame], test: dict[str, DataFrame],
              profiles: dict[str, TableProfile], seed: str = "round", key: str = "row_id",
              tables: list[str] | None = None, anomalies: list[str] | None = None) -> Round:
    """Corrupt some of the test tables. `tables` and `anomalies` replace the random choice."""
    rng = random.Random(f"{seed}/{run_number}")
    chosen = choose_tables(list(test), rng) if tables is None else tables
    context = Context(clean=clean, batch=test)
    batch, injections, failures = dict(test), [], []
    # all choices that share the round's generator come first, in table order
    work = [(t, choose_anomalies(rng) if anomalies is None else anomalies) for t in sorted(chosen)]
    results = each(work, lambda w: corrupt_table(
        test[w[0]], profiles[w[0]], w[1], f"{seed}/{run_number}/{w[0]}", context, key))
    for (table, _), (out, done, failed) in zip(work, results):
        batch[table] = out
        for change, affected, _ in done:
            # a whole new column has no count of its own
            count = None if change.anomaly == "insert_column" else affected
            injections.append((run_number, len(injections) + 1, table, change.column, change.anomaly, "", "",
                               count, "", logs.as_params(change.params), logs.now()))
        failures += [(run_number, table, anomaly, message, logs.now()) for anomaly, message in failed]
    return Round(batch, injections, failures)
