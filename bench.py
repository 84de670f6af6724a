"""Time the registered queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_ONLY`` an optional
comma list of keys.
"""

from __future__ import annotations

import json
import os
import sys
import time

from abstracta.catalog import QUERIES
from abstracta.session import build_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    only = os.environ.get("BENCH_ONLY")
    keys = only.split(",") if only else list(QUERIES)

    def run(key: str) -> float:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for warm in ("venue_year_stats", "knn_join"):  # start the JVM paths and the Python workers
        run(warm)
    times: dict[str, float] = {}
    for key in keys:
        times[key] = round(run(key), 3)
        print(f"{key:28s} {times[key]:8.3f}", file=sys.stderr, flush=True)
    result = {
        "metric": "total time of registered queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
