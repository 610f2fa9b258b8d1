"""Acceptance checks, benchmark gates and release decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Acceptance thresholds: name, bound, whether the value must be at least the bound. Fixed values.
ACCEPTANCE = [
    ("find_p95_ms", 600.0, False), ("search_p95_ms", 1200.0, False), ("commit_p95_ms", 1500.0, False), ("ndcg10", 0.75, True), ("recall10", 0.85, True),
    ("queries", 120.0, True), ("semantic_queries", 60.0, True), ("lexical_queries", 40.0, True), ("mixed_queries", 20.0, True),
]
MOST_DROP_PERCENT = 3.0
LEAST_TOP1 = 0.75


def acceptance(report: DataFrame) -> DataFrame:
    """Nine check rows from a one-row report, and whether each passes."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("double").alias("value"), F.lit(b).alias("bound"), ((F.col(n) >= b) if at_least else (F.col(n) <= b)).alias("passed")) for n, b, at_least in ACCEPTANCE])
    return report.select(F.explode(rows).alias("r")).select("r.*")


def gate(reports: DataFrame, last: int, quorum: int, p95_ms: float = 600.0, top1: float = LEAST_TOP1) -> DataFrame:
    """The newest ``last`` runs with reasons against each, and whether a quorum passes.

    ``reports``: run_id, created_at, p95_ms, top1, ndcg10. A run is also held
    against the one before it.
    """
    before = F.lag("ndcg10").over(Window.orderBy("created_at", "run_id"))
    drop = F.when(before > 0, (before - F.col("ndcg10")) * 100 / before)
    reasons = F.array_compact(F.array(F.when(F.col("p95_ms") > p95_ms, "latency"), F.when(F.col("top1") < top1, "accuracy"), F.when(drop > MOST_DROP_PERCENT, "regression")))
    runs = reports.withColumn("reasons", reasons).orderBy(F.desc("created_at"), F.desc("run_id")).limit(last)
    judged = runs.withColumn("passed", F.size("reasons") == 0)
    return judged.withColumn("gate_passed", F.count_if("passed").over(Window.partitionBy()) >= quorum)


def release_decision(executed: int, top1: float, buckets: dict[str, int]) -> dict[str, bool]:
    """The evaluation and memory gates from counts."""
    clear = all(buckets.get(b, 0) == 0 for b in ("filter_ignored", "relation_missing"))
    return {"eval": executed > 0 and top1 >= LEAST_TOP1 and clear, "memory": buckets.get("memory_category_miss", 0) == 0}
