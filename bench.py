"""Headline queries on the bench data; prints one JSON line.

    BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local threads (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import registry  # noqa: E402

HEADLINE = [
    "table_verdict",
    "scenario_summary",
    "verdict_samples",
    "outage_window",
    "content_diff",
    "hop_reconcile",
    "reject_balance",
    "frontier",
    "gap_ranges",
    "range_adjacency",
    "resume_compare",
    "resume_prefix",
    "bounded_replay",
    "history_profile",
    "interval_miss",
    "wire_decode",
    "disposition",
    "latest_version",
    "insert_if_absent",
    "sink_idempotent",
    "router_hop",
    "stream_direct",
    "stream_restart",
    "stream_two_hop",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(8 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that start-up is not billed to the first entry.
    registry.QUERIES["ledger_phases"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        result = registry.QUERIES[name](spark, sf_dir)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    total = round(sum(seconds.values()), 3)
    rate = {name: int(events / took) for name, took in seconds.items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": events,
                "events_per_sec": rate,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
