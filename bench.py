"""Headline queries, one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.

The first query warms the session up; then every query is planned and run to a no-op sink once.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.plans import registry
from tidemark.session import local_session, release

HEADLINE = (
    "asof_running_rates", "asof_cross_season", "joint_index", "trailing_30d_sums", "event_rates", "modal_value", "keep_last",
    "lineup_composite", "team_defense", "appearances", "trailing_pool_topn", "pool_composites", "best_lines",
    "annotate_bets_daily", "bankroll_history", "threshold_sweep", "ledger_merge", "ledger_settle", "ledger_clv",
    "calibration_table", "exact_quantiles", "ridge_coefficients", "stream_daily_counts", "training_features",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tidemark-bench")
    registry.load()
    seconds = {}

    def run(name: str) -> float:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = round(time.perf_counter() - start, 3)
        release(spark)
        return took

    run(names[0])
    for name in names:
        seconds[name] = run(name)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
