"""Benchmark the headline queries.

Runs each query in ``HEADLINE`` over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]``; every run executes the whole plan into the ``noop``
sink (nothing is collected to the driver). Reports the median of
``$BENCH_RUNS`` (default 3) timed runs after ``$BENCH_WARMUP`` (default 1)
warm-up runs, as ONE JSON line:
{"metric": "total_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "customer_metrics", "star_internet_sales", "star_reseller_sales", "dm_prep", "time_series",
    "category_diversity", "pair_counts", "upsell_table", "quartiles", "customer_360",
    "demand_grid_stats", "demand_forecast", "weekly_demand", "inventory_status",
    "keywords", "cosine_topk_many", "search_enriched", "order_json", "order_lines",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    warm = int(os.environ.get("BENCH_WARMUP", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    os.environ["BENCH_CPUS"] = cpus

    from shelfwise.session import get_session
    from shelfwise.plans.catalog import QUERIES

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus), driver_memory="16g")
    # the benchmark's files hold one row group each; spread their scans over the cores of this machine
    spark.conf.set("spark.shelfwise.scan.spread", ",".join(f"{t}={cpus}" for t in ("lineitem", "orders", "documents")))
    names = only or HEADLINE
    results: dict[str, float] = {}
    for name in names:
        fn = QUERIES[name]
        times = []
        for i in range(warm + runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i >= warm:
                times.append(dt)
        results[name] = round(statistics.median(times), 3)
        print(f"# {name}: {results[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(results.values()), 3), "unit": "sec",
                      "queries": results, "sf": sf, "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
