"""Time the headline queries: one warm-up pass over the list, then one timed pass.

Prints one JSON line. Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_QUERIES (names separated by commas, or ``all``).
"""

from __future__ import annotations

import json
import os
import time

from shelfwise.plans.catalog import QUERIES
from shelfwise.session import local_session

HEADLINE = [
    "silver_sales", "silver_inventory", "silver_transfers", "recent_sales_7d", "store_sku_position",
    "worst_shortfalls", "metric_headline", "metric_view", "metric_rollup", "store_breakdown", "kpi_summary",
    "velocity_trend_weekly", "open_shortfalls", "recovery_recommendations", "move_ranking_sorted",
    "live_state_join", "apply_approvals", "mirror_insert_absent", "asof_move_features", "grid_densify",
    "fulltext_search", "bm25_score", "hybrid_search", "pii_redact", "gateway_usage_by_requester",
    "rate_limit_refused_calls", "message_positions", "changelog_current", "scd2_history", "dq_smoke",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else (wanted.split(",") if wanted else HEADLINE)
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        run(spark, name, sf_dir)
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
