"""Corrupt, detect, reconcile: one function for a whole experiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbering import number_rows
from plumbline.operators import reconciliation
from plumbline.operators.detection import Context, detect
from plumbline.operators.profile_store import TableProfile, read_profiles
from plumbline.plans.corruption_round import Round, run_round
from plumbline.plans.profile_dataset import load_profile, profile_dataset, save_profile
from plumbline.session import each, materialize
from plumbline.sources import logs
from plumbline.sources import tables as source

# Fixed value: rounds of one experiment.
RUNS = 20


def detect_tables(batch: dict[str, DataFrame], clean: dict[str, DataFrame],
                  profiles: dict[str, TableProfile], key: str = "row_id") -> DataFrame:
    """Findings over all batches."""
    context = Context(clean=clean, batch=batch)
    # building the checks looks at schemas only, yet takes its time on wide tables
    return reduce(DataFrame.unionByName, each(
        sorted(batch), lambda name: detect(batch[name], profiles[name], context, key=key)))


def numbered_findings(findings: DataFrame, run_number: int, start: int = 1) -> DataFrame:
    """Findings with run_number and consecutive ids; there are at most a few per column."""
    order = ["table", "column", "anomaly", "calibration"]
    numbered = number_rows(findings, order, "id", bucket=F.lit(0))
    return numbered.withColumn("id", F.col("id") + F.lit(start)).withColumn("run_number", F.lit(run_number))


def run_experiment(run_number: int, clean: dict[str, DataFrame], test: dict[str, DataFrame],
                   profiles: dict[str, TableProfile], **choices) -> tuple[Round, DataFrame, DataFrame]:
    """(round, findings, scores) of one run."""
    spark = next(iter(clean.values())).sparkSession
    done = run_round(run_number, clean, test, profiles, **choices)
    findings = materialize(
        numbered_findings(detect_tables(done.batch, clean, profiles, choices.get("key", "row_id")), run_number),
        "findings")
    # a run without injection or finding scores zero
    this_run = spark.createDataFrame([(run_number,)], "run_number int")
    scores = reconciliation.scores(done.injection_log(spark), findings)
    return done, findings, this_run.join(scores, "run_number", "left").na.fill(0)


def run_pipeline(spark: SparkSession, folder: str, target: str, runs: int = RUNS, fmt: str = "csv",
                 clusters: bool = True, seed: str = "round", **ingest_options) -> DataFrame:
    """Ingest a folder, profile it, then corrupt, detect and reconcile round by round; scores of all rounds.

    Below `target`: clean and test tables, the profile, the batches of the last round with their tables, and
    the logs of injections, failures, findings and scores, appended per round.
    """
    source.ingest(spark, folder, target, fmt, **ingest_options)
    clean, test = source.load_tables(spark, target, "clean"), source.load_tables(spark, target, "test")
    stored = f"{target.rstrip('/')}/profile"
    save_profile(profile_dataset(clean, test, key="row_id", clusters=clusters), stored)
    profiles = read_profiles(load_profile(spark, stored))
    logs.reset(spark, target, "injections", logs.INJECTION_LOG)
    logs.reset(spark, target, "failures", logs.FAILURE_LOG)
    for run_number in range(1, runs + 1):
        done, findings, scores = run_experiment(run_number, clean, test, profiles, seed=seed)
        for name, df in done.batch.items():
            source.write_table(df, target, "batch", name)
        logs.append(done.injection_log(spark), target, "injections")
        logs.append(done.failure_log(spark), target, "failures")
        first = run_number == 1
        for name, df in (("findings", findings), ("scores", scores)):
            df.write.mode("overwrite" if first else "append").parquet(logs.log_path(target, name))
    return logs.read(spark, target, "scores")
