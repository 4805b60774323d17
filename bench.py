"""Seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The entry ``derive_panel`` is the derivation of the panel alone; each query on it derives it again.
Every other entry is the first run of a query. ``--warm`` adds a
second run of each, ``--all`` measures every registered query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from almanack.plans.catalog import QUERIES  # noqa: E402
from almanack.plans.panel import panel  # noqa: E402

# One query per operator family and published figure.
HEADLINE = [
    "geo_trend_filter",
    "latest_year_conjunct",
    "latest_year_chained",
    "not_in_null_safe",
    "lookup_left_join",
    "codebook_left_join",
    "set_membership_bucket",
    "round_half_away",
    "select_range_cast",
    "measure_by_year",
    "window_sum_distinct",
    "group_total_on_rows",
    "rate_per_1000",
    "share_of_total",
    "combined_rate",
    "pivot_multi_value",
    "select_prefix_unpivot",
    "gather_except",
    "order_by_median",
    "order_by_mean",
    "ingest_union_drift",
    "html_nth_cell",
    "graduation_trend",
    "graduation_by_group",
    "suspension_trend",
    "suspension_by_group",
    "expulsion_trend",
    "fitness_by_grade",
    "assessment_trend",
    "assessment_by_group",
    "reclassification",
    "language_status",
    "report_chart_rows",
]


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    # The noop sink computes every row and column without moving them to the driver.
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "distinct_values", sf_dir)  # JVM and Parquet reader start-up
    start = time.perf_counter()
    panel(spark, sf_dir).write.format("noop").mode("overwrite").save()
    first = {"derive_panel": round(time.perf_counter() - start, 3)}
    second = {}
    for name in names:
        first[name] = run(spark, name, sf_dir)
        if "--warm" in sys.argv:
            second[name] = run(spark, name, sf_dir)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    result = {
        "metric": "total_first_run_time",
        "value": round(sum(first.values()), 3),
        "unit": "sec",
        "queries": first,
        "sf": float(sf.group(1)) if sf else sf_dir,
    }
    if second:
        result["warm_queries"] = second
        result["warm_value"] = round(sum(second.values()), 3)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
