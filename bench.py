"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then three times; the median counts. Results are fully computed into
a no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from modelwatch.plans import bindings

HEADLINE = ["scan_feature_view", "logs_in_window", "two_window_profile", "feature_drift", "drift_all_alerts", "pit_features",
            "pit_orders", "online_features", "feature_freshness", "label_shift", "serving_skew_audit",
            "registry_metric_diff", "commits_in_window", "diff_line_profile", "daily_accuracy", "investigate",
            "investigate_fleet", "eval_summary"]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("modelwatch-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="modelwatch-bench-"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            bindings.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    alerts = bindings.table(spark, sf_dir, "events").select("user_id").distinct().count()
    spark.stop()
    print(json.dumps({
        "metric": "sum of median seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "fleet_alerts": alerts, "seconds_per_alert_in_fleet": round(seconds["investigate_fleet"] / max(alerts, 1), 5)}))


if __name__ == "__main__":
    main()
