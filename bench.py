"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from registry import all_queries
from shelfmark.session import get_session

HEADLINE = [
    "bm25_match_topk", "baseline_bm25", "boosted_bm25", "enriched_profile", "all_strategies", "filtered_search",
    "search_profile", "hash_embedding", "knn_topk", "hybrid_rrf", "rerank_window", "evaluation_summary",
    "latency_summary", "quality_gate", "tune_evaluate", "event_outcomes", "replayed_catalog", "upsert",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/part.parquet").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    found = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "total wall-clock of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else None}))


if __name__ == "__main__":
    main()
