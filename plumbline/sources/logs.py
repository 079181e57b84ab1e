"""Append-only logs of injections, failures, findings, feedback and usage."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INJECTION_LOG = ("run_number int, id long, table string, column string, anomaly string, calibration string, "
                 "current string, nb_rows_affected long, severity string, params map<string,string>, "
                 "logged_at timestamp")
FAILURE_LOG = "run_number int, table string, anomaly string, error_message string, logged_at timestamp"


def log_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/logs/{name}"


def now() -> datetime:
    return datetime.now(timezone.utc)


def as_params(params: dict) -> dict[str, str]:
    """Settings of an injection as text values."""
    return {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in params.items()
            if v is not None}


def reset(spark: SparkSession, folder: str, name: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(log_path(folder, name))


def append(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("append").parquet(log_path(folder, name))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(log_path(folder, name))


def next_id(log: DataFrame, run_number: int | None = None) -> int:
    """Largest id plus one, 1 for an empty log."""
    rows = log if run_number is None else log.filter(F.col("run_number") == run_number)
    return int(rows.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0])
