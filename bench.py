"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_RUNS     timed runs per query; the median is reported (default 1)
BENCH_WARM_DIR small tables for one warm-up run per query (default: sf0.001 beside BENCH_SF_DIR)
BENCH_QUERIES  comma-separated names (default: all)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from boxlake.plans.queries import QUERIES
from boxlake.session import LOCAL_SETTINGS, local_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else list(QUERIES)
    spark = local_session(cpus)

    beside = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_dir = os.environ.get("BENCH_WARM_DIR", beside)

    def run(name: str, tables: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for name in names:
        if os.path.isdir(warm_dir):
            run(name, warm_dir)
        timings[name] = round(statistics.median(run(name, sf_dir) for _ in range(runs)), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "runs": runs,
        "settings": LOCAL_SETTINGS,
    }))


if __name__ == "__main__":
    main()
