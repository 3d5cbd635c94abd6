"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bars_15min", "bars_weekly_from_daily", "pct_chg_refresh", "bar_features_5min", "bar_features_daily_history", "kd_lines",
    "decision_points", "decisions_with_liquidity", "decision_snapshots", "decision_index", "latest_bar_as_of", "last_bars_per_bar",
    "market_steps", "upsert_bars", "rebuild_plan", "compare_aggregated_with_direct", "consistency_report", "preflight_checks",
    "inventory_rollup", "portfolio_metrics", "overfitting_splits", "live_partial_bars",
]


def main() -> None:
    from barspark.catalog import load
    from barspark.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    queries, spark = load().QUERIES, local_session("bench", cores=cpus)
    queries["inventory_per_slice"](spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM's code paths
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
