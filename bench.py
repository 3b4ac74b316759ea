"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from cohortlens.plans import queries
from cohortlens.session import ship

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = (
    "subgroup_proportions", "metric_family", "proportion_differences", "fairness_gaps", "auroc_intervals", "auroc_differences", "calibration_summary", "decile_curve",
    "recalibration", "paired_differences", "paired_delong", "design_effects", "bootstrap_auroc", "bootstrap_clustered_proportions", "criteria_results", "gate_report",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    ship(spark)
    queries.QUERIES["flow_waterfall"](spark, SF_DIR).collect()
    times = {}
    for name in HEADLINE:
        began = time.time()
        queries.QUERIES[name](spark, SF_DIR).collect()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
