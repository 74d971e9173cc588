"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; the full result goes
to a no-op sink and the median counts. BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS and
BENCH_QUERIES (comma-separated names) change the run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logmill.plans.queries import QUERIES  # noqa: E402
from logmill.session import build_session  # noqa: E402

HEADLINE = [
    "read_log_lines", "classify_file", "route_files", "profile_files", "insert_if_absent",
    "update_by_name", "scan_signatures", "extract_events", "scan_summary", "capped_report",
    "security_scan", "dedupe_incidents", "resolve_incidents", "incident_totals", "clean_line",
    "term_counts", "tfidf", "file_summary", "template_clusters", "density_clusters_lines",
    "density_clusters_files", "majority_category", "small_run", "line_duplicates",
    "top_recurring_lines", "timeline_text", "hourly_histogram", "extract_patterns", "chunk_text",
    "index_docs", "topk_similar", "retrieval_context",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("logmill-bench", cpus, shuffle_partitions=max(cpus, 4))
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        taken = []
        try:
            for _ in range(runs + 1):
                start = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - start)
        except Exception as error:  # a failed run is recorded as such
            failed[name] = str(error).splitlines()[0][:200]
            continue
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
    out = {
        "metric": "headline queries, sum of medians",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
        "shuffle_partitions": max(cpus, 4),
        "cached_input": False,
    }
    if failed:
        out["failed"] = failed
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
