"""Times the headline queries on one machine and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from corvine.plans import catalogue

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "bm25_okapi_topk", "bm25_fts_topk", "dense_topk_cosine", "hybrid_topk", "abstain_decision", "evidence_select", "phrase_search",
    "chunk_documents", "section_split", "stable_ids", "incremental_diff", "redirect_closure", "evidence_wiki_rank", "retrieval_metrics_mean",
    "latency_histogram", "review_dedup_24h", "events_sessions",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalogue.queries(), {}
    queries["stable_ids"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # starts executors and readers
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, wall clock", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
