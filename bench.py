"""Time the headline queries; prints one JSON line.

Every query runs to completion into Spark's no-op sink, so that the time is Spark's work and
not the transfer of rows to the driver. One untimed run warms up the JVM.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tickersieve.plans.catalog import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "eod_metrics",
    "eod_metrics_short",
    "eod_metrics_13mo",
    "chart_last_close",
    "fund_from_json",
    "universe_refresh",
    "merge_prices",
    "merge_fundamentals",
    "build_stocks",
    "pe_percentile",
    "scored_all",
    "scored_own_sector",
    "screen_table",
    "sector_heatmap",
    "todays_picks",
    "summary_cards",
    "watchlist_top",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times: dict[str, float] = {}
    for name in HEADLINE:
        run(name)
        times[name] = round(run(name), 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rsplit("sf", 1)[-1],
        "cpus": int(CPUS),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
