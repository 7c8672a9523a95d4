"""Times the headline queries and prints one JSON line.

Every query is run once to the end (all rows computed, none collected), after a short query that starts the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from leafloom.plans import catalog
from leafloom.plans.retrieval_queries import flagship
from leafloom.session import Tables, build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "clean_text",
    "cleanup_report",
    "number_paragraphs",
    "merge_ocr_with_native",
    "assign_chapters",
    "coverage",
    "tree_violations",
    "assemble_leaf_body",
    "bm25_stats",
    "pair_similarity",
    "duplicate_clusters",
    "merge_actions",
    "verify_spans",
    "grade_summary",
    "apply_compaction",
    "fold_agent_turn",
    "job_state",
    "stream_ingest_clean",
]


def seconds(run, tables: Tables) -> float:
    start = time.perf_counter()
    run(tables).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session("leafloom-bench", CPUS, **{"spark.sql.shuffle.partitions": CPUS})
    tables = Tables(spark, SF_DIR)
    runs = {"flagship": flagship, **{name: catalog.QUERIES[name] for name in HEADLINE}}
    seconds(catalog.QUERIES["tokenize"], tables)
    times = {}
    for name, run in runs.items():
        times[name] = round(seconds(run, tables), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").rsplit("/", 1)[-1]}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
