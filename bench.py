"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose data and cores; ``BENCH_QUERIES`` (comma-separated) a subset. One warm-up,
then the median of three timed runs. A run builds the plan and executes it in
full; results go to the no-op sink, which consumes every row and column.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from gavel.plans.queries import QUERIES
from gavel.session import build_session

HEADLINE = [
    "governed_actions",
    "routed_planes",
    "decision_table",
    "event_contract",
    "rule_decisions",
    "rule_rows_decisions",
    "fallback_decisions",
    "metric_totals",
    "metric_breakdown",
    "compliance_hits",
    "latest_alerts",
    "ledger_append",
    "access_features",
    "user_sequences",
    "fusion_sweep",
    "roc_area",
    "scorer_report",
    "deduped_documents",
    "leakage_removed",
    "balanced_classes",
    "record_ids",
    "forest_scores",
    "sequence_model_scores",
    "text_model_classes",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
