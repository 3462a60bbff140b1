"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from omenlog.plans import load
from omenlog.session import get_spark

HEADLINE = (
    "window_alert_precision",  # tumbling alert precision at three widths
    "lead_time_within_hour",  # earliest alert in a time range
    "lead_time_in_rows",  # earliest alert in a row range
    "time_features",  # event rates and the other time features
    "auroc",
    "best_f1_linear_grid",  # 1000 thresholds in one pass
    "threshold_sensitivity",  # lead times at 20 thresholds
    "anchored_groups",
    "score_distinct_lines_once",
    "normalise_generic",
    "normalise_thunderbird",
    "line_surprise",
    "memory_knn_mean",
    "change_score_median",
    "gap_audit_events",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = get_spark(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="20g", spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = load()
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the JVM before the clock
    seconds = {}
    for name in only:
        start = time.perf_counter()
        registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
