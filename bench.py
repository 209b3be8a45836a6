"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from vitrine.plans.queries import QUERIES
from vitrine.session import local_session

HEADLINE = [
    "users_view", "products_view", "user_features", "demand_training_set", "demand_spike",
    "training_pairs", "propensity_score", "optimal_discount", "inventory_pressure",
    "similar_products", "auc", "drift_check", "sale_badge_report", "recommend",
    "preset_comparison", "recommend_whole", "inventory_train", "propensity_train",
    "elasticity_train", "demand_train",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    partitions = int(cores) if cores.isdigit() else 8
    spark = local_session(cores, partitions)
    QUERIES["store_counts"](spark, folder).collect()  # start the workers before timing
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        # Every column of every row is produced and thrown away in Spark.
        result = QUERIES[name](spark, folder)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
