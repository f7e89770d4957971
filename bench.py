"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidewater.plans import registry

HEADLINE = [
    "late_rate_by_month", "look_back_hours", "look_back_offsets", "join_coverage", "nearest_to_hours", "trailing_statistics", "as_of_purchase", "nearest_within_interval",
    "enrich_two_roles", "deduplicated_items", "label_targets", "arrivals", "flight_conditions", "events_metadata", "item_summary", "customer_popularity", "forest_holdout",
    "range_self_join", "day_lists", "flights_prepared", "weather_prepared", "pipeline_features",  # the last three: the preparation of some 150,000 flights at sf0.1
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    registry.QUERIES["late_rate_by_month"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles and warms up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
