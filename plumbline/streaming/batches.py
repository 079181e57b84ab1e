"""Detectors attached to a stream: every micro-batch is a batch of new rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.detection import Context, detect
from plumbline.operators.key_store import write_key_store
from plumbline.operators.profile_store import TableProfile
from plumbline.plans.closed_loop import numbered_findings


def on_batch(profile: TableProfile, context: Context, findings_path: str,
             key: str = "row_id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function writing findings, one folder per batch: a replayed batch replaces its own."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        found = numbered_findings(detect(batch, profile, context, key=key), batch_id)
        found.drop("run_number").write.mode("overwrite").parquet(
            f"{findings_path.rstrip('/')}/run_number={batch_id}")

    return handle


def watch(stream: DataFrame, profile: TableProfile, findings_path: str, checkpoint: str,
          context: Context | None = None, key: str = "row_id", **trigger) -> StreamingQuery:
    """Start checking a stream of new rows against a profile.

    The clean keys are stored once, bucketed, unless the context holds them already; each batch then moves only its own rows.
    """
    context = context or Context()
    if context.clean and context.keys is None:
        context = replace(context, keys=write_key_store(context.clean, {profile.name: profile}))
    writer = stream.writeStream.foreachBatch(on_batch(profile, context, findings_path, key))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
