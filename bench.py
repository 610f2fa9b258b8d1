"""Times the headline queries, the median of three runs after a first one, which is given beside it; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tessera.plans import registry, retrieval, search

RUNS = 3
HEADLINE = [
    "q_bm25_topk", "q_bm25_weighted", "q_jaccard_overlap", "q_dense_topk", "q_hybrid_score", "q_fanout_merge", "q_level_expand", "q_rerank_doc_aware", "q_filter_projection_ancestors",
    "q_relations_topn", "q_upsert_docs", "q_cdc_changed", "q_queue_totals", "q_trace_metrics", "q_eval_cases_union", "q_memory_merge", "q_activation_boundary", "q_stream_outbox_fold", "q_benchmark_suite", "q_observer_pass", "q_reflection_records", "q_find", "q_search",
]


def builds(spark: SparkSession, sf_dir: str) -> dict[str, dict[str, float]]:
    """What writing each stored index takes, and its size; the queries read these."""
    out = {}
    for name, make in (("search", lambda: search.search_index(spark, sf_dir)), ("words", lambda: retrieval._index(spark, sf_dir, False)), ("weighted words", lambda: retrieval._index(spark, sf_dir, True))):
        t = time.time()
        folder = make().path.removeprefix("file:")
        took = round(time.time() - t, 3)
        out[name] = {"sec": took, "mb": round(sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs) / 1e6, 1)}
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, times, first = registry.queries(), {}, {}
    built = builds(spark, sf_dir)
    for name in HEADLINE:
        runs = []
        for _ in range(1 + RUNS):  # the first run warms up
            t = time.time()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        first[name] = round(runs[0], 3)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "first_runs": first, "index_builds": built, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
