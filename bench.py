"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of local cores. Every
query is built, planned and run to its end; of two runs the faster one counts. "rows_per_sec" gives
the throughput of the jobs that read the whole log.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent))

from loglens.plans import catalog, fixtures  # noqa: E402

HEADLINE = [
    "overview", "timeseries", "timeseries_hourly", "performance", "top_paths", "top_countries", "hosts_summary",
    "slowest_paths", "requests_page", "ip_profile_top_paths", "ip_timeline", "ip_modal_attrs", "ip_latency",
    "rollup_minutely", "rollup_hourly", "enrich_geo", "enrich_ua", "sec_window_60s", "sec_auth_fail", "ip_list_match",
    "alert_evaluate", "live_metrics", "stream_rollup", "security_events", "parse_lines",
]
# A query that takes longer is run once.
REPEAT_BELOW = 3.0
THROUGHPUT = ["parse_lines", "enrich_geo", "security_events", "rollup_hourly", "stream_rollup"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loglens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = fixtures.table(spark, sf_dir, "events").count()
    queries = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        runs = []
        while not runs or (len(runs) < 2 and runs[0] < REPEAT_BELOW):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": {name: round(rows / seconds[name]) for name in THROUGHPUT if name in seconds},
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
