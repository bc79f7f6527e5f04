"""Benchmark the headline queries.

Runs each query of HEADLINE at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] (default 8): one warm-up run, then the median of
$BENCH_REPEATS (default 3) timed runs.  Every run executes the whole plan
through the ``noop`` sink (nothing is collected to the driver).  Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from effortlab.plans.queries import QUERIES  # noqa: E402
from effortlab.session import get_spark  # noqa: E402

HEADLINE = ["text_features", "risk_level", "grouped_errors", "stratified_split", "tfidf",
            "prepare_dataset", "baseline_report", "error_report"]


def run_once(spark, name, sf_dir):
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("effortlab-bench", master=f"local[{cpus}]", shuffle_partitions=cpus,
                      extra={"spark.driver.memory": "16g"})
    times = {}
    for name in names:
        run_once(spark, name, sf_dir)                       # warm-up
        times[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(repeats)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
