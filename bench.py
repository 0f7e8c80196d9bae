"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR  folder of the tables (default: the sf0.1 test data)
    BENCH_CPUS    local cores (default: 8)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from veilwork.session import local_session  # noqa: E402

HEADLINE = (
    "mask_pii", "mask_pii_text", "pii_type_totals", "entity_rows", "detect_persons",
    "detect_injection", "route_messages", "compliance_report", "batch_mask", "assign_batches",
    "build_requests", "score_distinct", "chunk_documents", "lift_spans", "normalize_pages",
    "parse_entities", "latency_percentiles", "health_rollup", "suite_summary", "score_with_model",
    "stream_filter", "stream_metrics", "score_with_pipeline", "mask_in_chunks", "failure_report",
    "merge_bio",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(1 + RUNS):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        # the first run warms up: class loading and compiling
        times[name] = round(statistics.median(taken[1:]), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over the headline queries, median of three runs after a warm-up",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
