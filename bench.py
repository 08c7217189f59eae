"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query runs once to warm up and
once for the figure."""

from __future__ import annotations

import json
import os
import sys
import time

from crosswalk.session import bench_cores, local_session
from workload import QUERIES

HEADLINE = ["crosswalk_orders", "check_rollup", "apply_mapping", "candidate_pairs", "assign_one_to_one", "choose_pair",
            "validate_proposals", "scan_rules", "match_routes", "match_advisories", "classify_scan", "repair_rounds",
            "extract_java_fields", "dependency_closure", "failure_reasons"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(bench_cores(), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in wanted:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
