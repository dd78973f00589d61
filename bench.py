"""Benchmark the headline queries; print one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion into Spark's ``noop`` sink (nothing is collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "load_csv_explicit_schema": "s1_csv_explicit_schema",
    "daily_demand": "a1_daily_demand",
    "top10_subgroups": "t1_top10_subgroups_by_demand",
    "demand_per_store_by_state": "a9_a10_demand_per_store_by_state",
    "monthly_profit_by_product": "a7_monthly_profit_by_product",
    "null_and_quantile_profile": "a18_quantile_profile_price",
    "markup_quintiles": "a27_markup_quintiles",
    "weekly_median_price": "f1_weekly_median_price",
    "weekly_panel_gap_filled": "f2_weekly_panel_gap_filled",
    "weekly_forecast": "f6_weekly_forecast_h1",
    "price_grid_optimum": "m15_w1_optimal_price",
    "assembled_forecast": "m16_j15_assembled_forecast_weekly_price",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pricewise.plans import QUERIES
    from pricewise.session import build_session
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    # Warm the JVM (class loading, JIT, generated-code caches) once per headline query on the
    # smallest data set: a fixed per-process cost that does not grow with the data.
    for name in HEADLINE.values():
        QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for label, name in HEADLINE.items():
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[label] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
