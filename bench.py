"""Headline timings: one JSON line, per-query median seconds.

Every run starts with an empty cache, so no result is reused between runs.
Environment: BENCH_SF_DIR (folder), BENCH_CPUS, BENCH_RUNS, BENCH_QUERIES (comma separated).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from checks.queries import QUERIES
from salesloom.session import build_session

HEADLINE = (
    "clean_transactions", "validation_report", "overall_metrics", "revenue_daily",
    "revenue_monthly", "segment_category", "segment_customer", "segment_all", "monthly_trend",
    "anomaly_last_day", "metrics_bundle_long", "full_report", "context_summary",
    "transaction_documents", "text_embeddings", "similar_topk", "index_upsert",
    "retrieve_for_questions", "question_prompts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__ui__enabled="false",
                          spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    timings, rows = {}, {}
    for name in names:
        seconds = []
        for _ in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            table = QUERIES[name](spark, folder).toArrow()
            seconds.append(time.perf_counter() - start)
            rows[name] = table.num_rows
            spark.catalog.clearCache()
        timings[name] = round(statistics.median(seconds[1:]), 3)
        print(f"{name}: {timings[name]} s, {rows[name]} rows", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "rows": rows, "runs": runs, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
