"""Headline queries on local cores, timed once each after a warm-up of the session; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.plans import registered  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = (
    "table_profile", "column_profile", "numeric_distribution", "string_distribution", "category_distribution",
    "correlations", "cramers_v", "correlation_ratio", "foreign_keys", "disguised_missing", "kmeans_profile",
    "inject_distribution_shift", "inject_duplicate_pk", "inject_orphan_fk", "inject_correlation_break",
    "detect_insert_null", "detect_new_category", "detect_orphan_foreign_key", "detect_duplicate_primary_key",
    "detect_distribution_shift", "reconcile_scores", "parse_reports", "usage_cost",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cores}]", **{
        "spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        registered.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run(HEADLINE[0])
    times = {name: run(name) for name in HEADLINE}
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
