"""Seconds of headline queries, as one JSON line. BENCH_SF_DIR and BENCH_CPUS say where and on how many cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "class_count", "shape_confidence", "max_count_one", "prune_grid", "pruned_property_shapes", "stats_counts",
    "sampled_support", "validate_max_count",
)


def main() -> None:
    from shapeloom.plans.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["class_count"](spark, "/root/testdata/sf0.001").collect()  # Spark's own start is not a query's time
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
