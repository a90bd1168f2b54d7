"""Time the headline queries. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "chunk_documents", "mentions", "entity_fusion", "relation_fusion", "entity_summaries", "document_summaries",
    "graph_recall_topk", "vector_recall_topk", "hybrid_search", "rrf_route", "candidate_pairs", "link_scores",
    "same_as_neighbours", "document_metadata", "main_evidence", "node_merge", "edge_merge", "required_docs_all",
    "upsert_last_wins", "strict_json",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from quiltgraph.plans.catalog import QUERIES

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        # One run first, so that generated code is compiled and Python workers are up.
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(sorted(runs)[len(runs) // 2], 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
