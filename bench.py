"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS: tables and cores. BENCH_RUNS: runs per query after one
warm-up, of which the best counts. `load_increment` finds what to append of a batch to a
target ten times its size. BENCH_LONG_WAY=1 also times the six joins in full, the
baseline that the fact is measured against, and a load that shuffles all of the target's keys.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.longway import (
    PAYMENT_KEY,
    increment,
    new_rows_by_full_keys,
    order_fact_after_joins,
    order_fact_any_row,
)
from checks.queries import QUERIES
from checks.standins import raw_tables
from ordermart.sinks.warehouse import new_rows

HEADLINE = [
    "order_fact",
    "order_fact_conformed",
    "join_fanout",
    "customer_dim",
    "product_dim",
    "order_items_dim",
    "order_reviews_dim",
    "geolocation_dim",
    "seller_dim",
    "quality_report",
    "pk_violations",
    "fk_violations",
    "type_rejects",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ordermart-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(build) -> float:
        start = time.perf_counter()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    def best(build) -> float:
        seconds(build)
        return round(min(seconds(build) for _ in range(runs)), 3)

    times = {name: best(QUERIES[name]) for name in HEADLINE}
    batch, target = increment(spark, sf_dir)
    times["load_increment"] = best(lambda s, d: new_rows(batch, target, PAYMENT_KEY))
    result = {
        "metric": "headline queries, total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    if os.environ.get("BENCH_LONG_WAY"):
        result["long_way"] = {
            "order_fact_any_row": best(lambda s, d: order_fact_any_row(raw_tables(s, d))),
            "order_fact_after_joins": best(
                lambda s, d: order_fact_after_joins(raw_tables(s, d))
            ),
            "load_by_full_keys": best(lambda s, d: new_rows_by_full_keys(batch, target)),
        }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
