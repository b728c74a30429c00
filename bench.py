"""Times the headline queries and prints one JSON line.

Every query runs twice in one warm session, writing to the no-op sink; the second time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from logspark.plans.catalog import QUERIES
from logspark.session import apply_settings

HEADLINE = (
    "q01_incremental_scan", "q03_parse_lines", "q04_run_dedup", "q04b_dedup_stats",
    "q05_regex_exclude", "q06_filter_stats", "q07_greedy_chunks", "q07b_greedy_chunks_documents",
    "q08_prompt_budget", "q09_first_requests", "q09d_results", "q10_classify_extract",
    "q12b_reports", "q13_retention", "q14_cursor_upsert", "q15_executive_request", "q18_obsolete",
    "q21_preview",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (apply_settings(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).lstrip("sf"),
    }))


if __name__ == "__main__":
    main()
