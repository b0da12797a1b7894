"""Time the headline queries: one warm-up, then the median of three runs each.

Prints one JSON line. Rows go to Spark's no-op sink, so every column of every row is computed
and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from medialog.registry import REGISTRY  # noqa: E402
from medialog.session import configure  # noqa: E402

HEADLINE = (
    "enrich_requests",
    "access_log_enriched",
    "log_page",
    "export_rows",
    "show_rollup",
    "show_stats_zero_filled",
    "episode_totals",
    "overview_compare",
    "busiest_episodes",
    "by_client",
    "daily_series",
    "show_card_clients",
    "last_feed_fetch",
    "reconcile_changes",
    "episode_timeline",
    "readiness_summary",
    "show_overview",
    "feed_items",
    "feed_document_summary",
    "scan_diagnostics",
    "login_failures_trailing",
    "match_category",
    "content_identity",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("medialog-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        REGISTRY.queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    line = {
        "metric": f"total of {len(seconds)} headline queries, warm median of {RUNS}",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
