"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

Each query runs once to warm up and then RUNS times; its figure is the least. All rows are computed and dropped.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from millrace import suite

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
HEADLINES = [
    "scan_filter_lt", "scan_filter_str_range", "scan_filter_conj", "scan_filter_or", "point_lookup", "join_equi_2way", "join_4way", "join_cycle", "join_theta",
    "sum_double", "sum_distinct", "group_by_2", "group_by_join", "distinct_2", "distinct_join",
]


def main() -> None:
    os.environ["SPARK_LOCAL_IP"] = "127.0.0.1"
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        best = float("inf")
        for attempt in range(RUNS + 1):
            began = time.perf_counter()
            suite.queries()[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if attempt:
                best = min(best, time.perf_counter() - began)
        times[name] = round(best, 4)
    print(json.dumps({"metric": "suite_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS), "runs": RUNS}))


if __name__ == "__main__":
    main()
