"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list or ``all``),
BENCH_RUNS (timed runs after one warm-up, default 1; the median is reported). Every run writes to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkverbs import plans  # noqa: E402
from sparkverbs.session import local_session  # noqa: E402

HEADLINE = [
    "study_pets", "study_bike", "study_tennis", "study_birds", "study_nobel", "study_commute", "study_olympics",
    "study_friends", "study_nzbird", "study_ufo", "tokenize", "pairwise_phi", "chisq_residuals", "kde_grid",
    "global_row_number", "rank_in_group", "running_sum", "top_n_ties", "median_iqr", "pivot_table", "cumulative_expand",
    "interaction_edges", "zscore", "unpivot",
]


def run(spark, query, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_RUNS", "1"))
    queries = plans.all_queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cores, "bench")
    times = {}
    for name in names:
        warm = run(spark, queries[name], folder)
        times[name] = round(statistics.median(run(spark, queries[name], folder) for _ in range(repeats)), 3)
        print(f"{name:26s} warm-up {warm:7.2f}s  timed {times[name]:7.2f}s", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else None, "cores": cores, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
