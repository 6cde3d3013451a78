"""Time the headline queries and print one JSON line.

Each query is planned and run in full (every row, no-op sink) after one untimed run; the
recorded time is the median of the timed runs, planning included.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from loanloom.queries import registered  # noqa: E402

HEADLINE = (
    "active_loans",
    "active_loans_distinct",
    "active_loans_measures_dedup",
    "active_loans_contact_masked",
    "auto_loans_synonyms",
    "high_risk_exposure",
    "high_risk_exposure_fanout",
    "high_risk_total",
    "flagged_borrower_volume",
    "high_balance_good_score",
    "target_customers",
    "distinct_channel_users",
    "monthly_channel_trunc",
    "monthly_channel_category",
    "monthly_channel_unique",
    "approved_record_count",
    "segments_flag",
    "segments_detail",
    "segments_latest",
    "segments_latest_upi",
    "segments_any",
    "window_counts",
    "latest_transaction",
    "dedup_keys",
    "distinct_loan_kinds",
    "dq_profile_segments",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loanloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # Do not record a Python stack trace for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    queries = registered()
    times: dict[str, float] = {}
    for name in HEADLINE:
        samples = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
        times[name] = round(statistics.median(samples[1:]), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(folder.rsplit("sf", 1)[-1]) if "sf" in folder else folder,
            }
        )
    )


if __name__ == "__main__":
    main()
