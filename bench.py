"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs),
BENCH_QUERIES (comma separated names instead of the headline list).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from tastemill.levels import LEVELS
from tastemill.plans.catalog import all_queries
from tastemill.session import local_session, release_cuts

HEADLINE = [
    *[f"taste_profile_{name}" for name in LEVELS],
    "clickstream_products",
    "action_ratings",
    "transaction_spend",
    "daily_customer_spend",
    "inter_shopping_days",
    "inter_shopping_days_by_location",
    "rfm_from_trips",
    "recent_product_lines",
    "channel_store_trips",
    "customer_channel_status",
    "web_sales_items",
    "clienteling_transactions",
    "merged_inventory",
    "rerank_unseen_designer_division_class",
    "publish_designer_division_class",
    "recommend_division",
    "recommend_designer_division_class",
    "combined_rating",
    "category_recommendations",
    "tune_als",
    "kmeans_elbow",
]


def timed(run) -> float:
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, partitions=max(int(cpus) if cpus.isdigit() else 8, 4), memory=os.environ.get("BENCH_MEMORY", "8g"),
                          **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tastemill-bench-")})
    registered = all_queries()
    seconds: dict[str, float] = {}
    for name in names:
        q = registered[name]
        timed(lambda: q(spark, root))
        seconds[name] = round(statistics.median(timed(lambda: q(spark, root)) for _ in range(runs)), 3)
        release_cuts(spark)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": root.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
