"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (optional,
comma separated). Every query is run to the end with a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from spanforge.plans.queries import queries
from spanforge.session import local_session

HEADLINE = [
    "flatten_traces", "flatten_logs", "flatten_metrics", "find_spans", "search_logs",
    "logs_with_trace", "trace_groups", "span_tree", "waterfall_layout", "service_map",
    "latency_stats", "latency_histogram", "outlier_spans", "trace_diff_pairs", "metric_rollup",
    "metric_series", "prometheus_samples", "status", "sample_report", "retain_traces",
    "alert_error_rate", "alert_rules", "alert_cooldown", "sql_joins", "sql_window",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores=cores, app="bench")
    known = queries()
    # Warm the JVM and the file footers, so that the first query is not charged for them.
    known["error_rate_by_service"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        begun = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begun, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline telemetry queries",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
