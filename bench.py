"""Time the headline queries on one machine and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the cores. A query
counts from building its plan to writing every row to the no-op sink, all its
intermediate tables included. Before the timed runs every query runs once on the
smallest tables, so that JVM start-up and code generation are not charged to it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from growthlens.plans.materialise import release
from growthlens.session import local_session
from registry.queries import QUERIES

HEADLINE = [
    "trade_panel",
    "trend_table",
    "scale_grouped",
    "pct_rank",
    "feature_table_train",
    "min_rank",
    "top_n_all_locations",
    "validation_report",
    "user_similarity",
    "knn_predictions",
    "als_predictions",
    "recommend_end_to_end",
]


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores=int(os.environ.get("BENCH_CPUS", "8")))
    names = sys.argv[1:] or HEADLINE
    smallest = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in names:
        run(spark, name, smallest if os.path.isdir(smallest) else folder)
    seconds = {name: round(run(spark, name, folder), 3) for name in names}
    release(spark)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
