"""Benchmark the headline queries and print one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3),
BENCH_QUERIES (comma list to override the headline set).

Each query is planned and fully executed into Spark's no-op sink (no driver collect); one warm-up
run, then the median of BENCH_RUNS timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pass_at_k",
    "evaluate_run",
    "derive_verdict",
    "failed_tests",
    "curate_perf_tasks",
    "efficiency_run",
    "match_reference_ladder",
    "seeded_split",
    "mean_pool_fingerprint",
    "dependency_closure",
    "unique_word_ratio",
    "normalize_for_dedup",
    "extract_fenced_block",
    "clean_code",
    "stream_task_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from graderoom.registry import QUERIES, load_all
    from graderoom.session import build_session

    load_all()
    spark = build_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16,
                          app="graderoom-bench")

    def once(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    results: dict[str, float] = {}
    for name in names:
        once(name)  # warm-up
        results[name] = round(statistics.median(once(name) for _ in range(runs)), 3)

    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total_median",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
