"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores.
Every query is run to the end: all rows and columns are produced and dropped.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from arealis.plans import QUERIES
from arealis.session import build_session

HEADLINE = [
    "count_tables",
    "match_operators",
    "group_accumulators",
    "group_first_last",
    "group_push",
    "lookup",
    "bucket",
    "bucket_auto",
    "moving_average",
    "moving_average_large_keys",
    "moving_average_docs",
    "requested_keys",
    "range_average",
    "time_bucket_agg",
    "time_bucket_dimensions",
    "top_n_per_bucket",
    "compound_inner",
    "compound_full",
    "compound_nested",
    "minmax_scale",
    "linear_regression_by_key",
    "linear_regression_two_features",
    "linear_regression_with_test",
    "regression_metrics_by_key",
    "linear_metrics_by_key",
    "random_forest_by_key",
    "gbt_by_key",
    "kmeans",
    "bisecting_kmeans",
    "gaussian_mixture",
    "lda",
    "json_rows",
    "explode_json_objects_array",
]


def calibration(spark) -> float:
    """Seconds of a fixed job that no code of this repository takes part in: tells the machines of two runs apart."""
    start = time.perf_counter()
    spark.range(40_000_000, numPartitions=32).selectExpr("sum(pmod(xxhash64(id, id * 7), 1000003)) AS s").collect()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the executor's and the Python workers' machinery outside the timings
    small = spark.range(1000).selectExpr("id % 7 AS k", "id AS v")
    small.groupBy("k").sum("v").toDF("k", "v").mapInPandas(lambda frames: frames, "k long, v long").collect()
    calibration(spark)
    fixed = calibration(spark)
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", root)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "calibration": fixed,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
