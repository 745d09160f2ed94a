"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from aerolattice.catalog import load_all  # noqa: E402
from aerolattice.runtime import local_session  # noqa: E402

HEADLINE = [
    "build_domain",
    "cells_of_points",
    "site_conflicts",
    "g0_edges",
    "pairs_knn",
    "pairs_mst",
    "components",
    "interconnect",
    "route_plan",
    "cell_load",
    "affected_paths",
    "scene",
    "intent_state",
    "fire_all",
    "dependency_versions",
    "invalidation_closure",
    "deliveries",
    "text_stats",
    "core_distance",
    "aeqd_forward",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("aerolattice-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    names = sys.argv[1:] or HEADLINE
    queries["build_domain"](spark, sf_dir).collect()  # start executors and load classes before the clock runs
    times: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
