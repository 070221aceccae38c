"""Benchmark: the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line.  ``build_star_sec`` is the one-off model build (adapter,
clean layer, dimensions, bridges, facts, all written as tables); each headline
query is then timed as the median of five runs, executed to completion through
the ``noop`` sink so no result is collected on the driver.  ``heavy_queries``
times the heavy extensions once each (the distinct-product star's build falls
to the first of them that needs it).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "total_historical_cost", "avg_cost_per_order_unit", "cost_by_plant_route", "capacity_fit",
    "highest_cost_routes", "carrier_cost_by_route", "capacity_utilization", "lower_cost_routes",
    "optimal_assignment", "cost_reduction", "route_rebalance",
    "total_historical_cost_by_shipment", "cost_reduction_by_shipment", "carrier_options",
]

# the heavy extensions, run once each and reported apart from the headline sum
HEAVY = [
    "cost_by_carrier", "total_historical_cost_by_shipment_dedup", "usage_frequency", "profile_tables", "dq_duplicates",
    "feasible_options", "feasible_assignment", "utilization_shift", "capacity_assignment", "capacity_assignment_by_day",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from haulage.config import CostConfig
    from haulage.plans.registry import all_queries
    from haulage.plans.star import star_for
    from haulage.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          extra={"spark.driver.memory": "16g"})
    qs = all_queries()
    names = [n for n in HEADLINE if n in qs]
    extra = [n for n in os.environ.get("BENCH_EXTRA", "").split(",") if n in qs]
    names += extra

    t0 = time.perf_counter()
    star_for(spark, sf_dir)
    build = time.perf_counter() - t0

    # what the questions read besides the star is written here and timed apart, so that no median hides it
    t0 = time.perf_counter()
    star = star_for(spark, sf_dir)
    for grain in ("order", "shipment"):
        star.cost_cube(CostConfig(grain=grain))
    cubes = time.perf_counter() - t0
    t0 = time.perf_counter()
    for guarded in (True, False):
        star.envelopes(CostConfig(), guarded)
    envelopes = time.perf_counter() - t0
    t0 = time.perf_counter()
    star_for(spark, sf_dir, True)
    dedup = time.perf_counter() - t0

    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            t = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 3)
    heavy: dict[str, float] = {}
    for name in HEAVY:
        t = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        heavy[name] = round(time.perf_counter() - t, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds", "value": total, "unit": "sec",
        "queries": times, "heavy_queries": heavy, "heavy_sum_sec": round(sum(heavy.values()), 3), "build_star_sec": round(build, 3),
        "write_cost_cubes_sec": round(cubes, 3), "write_envelopes_sec": round(envelopes, 3), "build_dedup_star_sec": round(dedup, 3), "sf": sf,
        "cpus": int(cpus), "repeats": repeats, "spark": spark.version,
    }))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
