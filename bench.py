"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
threads, BENCH_QUERIES a comma-separated choice, BENCH_RUNS (default 2) the runs per query,
of which the fastest counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clickengine.plans.catalog import QUERIES  # noqa: E402
from clickengine.session import configure  # noqa: E402

HEADLINE = [
    "user_set_bag", "bag_signature", "prev_hour_count", "prev_day_count", "past_rate_by_key",
    "previous_day_counts", "prepared_log", "namespaced_hash", "cross_numeric", "bag_feature_set",
    "count_feature_set", "topic_feature_set", "rare_filter_exact", "rare_filter_progressive",
    "rare_filter_count_min", "libsvm_roundtrip", "sparse_dot", "ftrl_one_batch", "ftrl_two_batches",
    "ftrl_approx_batch", "ogd_two_batches", "config_grid", "shard_train", "auc", "rolling_metrics",
    "progressive_by_batch", "score_submission", "stream_hour_counts", "stream_foreach_batch",
    "stream_keyed_state", "topic_distribution",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["count_by_key"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
