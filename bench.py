"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_QUERIES a comma-separated choice. Each
query runs once to warm up; its time is the better of two further runs into the ``noop`` sink,
with building and planning included.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tallywright.plans.queries import QUERIES

HEADLINE = (
    "sales_totals",
    "sales_monthly_revenue",
    "sales_mom_growth_by_tenant",
    "sales_top_products",
    "sales_top_customers_by_tenant",
    "sales_region_revenue",
    "sales_breakdown_one_scan",
    "sales_report",
    "mkt_totals",
    "mkt_campaigns",
    "mkt_best_worst",
    "mkt_monthly_trend",
    "mkt_report",
    "coerce_numeric",
    "coerce_dates",
    "map_columns",
    "latest_upload",
    "subscription_gate",
    "payment_signatures",
    "subscription_state",
    "chat_history",
    "insight_replies",
)


def timed(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(min(timed(spark, name, sf_dir) for _ in range(2)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
