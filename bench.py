"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Every query is forced to completion with the ``noop`` sink (all rows computed, nothing
collected), after caches are cleared.  ``warehouse_build`` is the historical load (flight view -> staging -> 8 dimensions
-> key resolution -> fact upsert -> Parquet write); the analytics queries then read the written
warehouse, as the dashboard does.  Each query runs twice from cleared caches: ``queries`` has the
second run (compiled code, no cached data), ``cold`` the first.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["star_lookup", "kpi_summary", "delay_by_airline", "delay_by_month", "delay_by_hour", "top_routes",
            "filtered_dashboard", "available_flights", "dq_constraints", "training_features",
            "weather_nearest_hour", "live_flatten", "live_upsert_rows", "live_append_latest", "serve_model_input"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from skyledger.session import build_session
    spark = build_session(f"local[{cpus}]", app_name="skyledger-bench", shuffle_partitions=max(8, cpus * 2),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skyledger-bench-"))
    from skyledger.catalog import QUERIES
    from skyledger.plans.warehouse import warehouse_for

    times: dict[str, float] = {}
    t0 = time.time()
    warehouse_for(spark, sf_dir)
    times["warehouse_build"] = round(time.time() - t0, 3)
    cold: dict[str, float] = {}
    for name in HEADLINE:
        for runs in (cold, times):
            spark.catalog.clearCache()
            t = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "cold": cold, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
