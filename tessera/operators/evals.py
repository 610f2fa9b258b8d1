"""Evaluation sets, amortised runs, trends, thread sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_golden(golden: DataFrame, traces: DataFrame, most: int) -> DataFrame:
    """``golden`` with up to ``most`` trace cases whose query isn't there yet; roots and empty expectations are left out.

    Cases have query, expected_uri, source and pos, the order in which traces count.
    """
    usable = traces.where(F.col("expected_uri").isNotNull() & F.col("expected_uri").rlike(r"^[a-z]+://[^/]+/."))
    first = usable.groupBy(F.lower("query").alias("q")).agg(F.min_by(F.struct("query", "expected_uri", "pos"), "pos").alias("c"))
    known = golden.select(F.lower("query").alias("q")).distinct()
    new = first.join(known, "q", "left_anti").select("c.query", "c.expected_uri", F.lit("golden-seed").alias("source"), "c.pos")
    return golden.unionByName(new.orderBy("pos").limit(most))


def amortized(runs: DataFrame) -> DataFrame:
    """One row over iterations (p95_ms, top1, ndcg10, recall10): the upper median of p95, means of the rest."""
    own = F.sort_array(F.collect_list("p95_ms"))
    return runs.agg(
        F.count("*").alias("iterations"), F.get(own, F.floor(F.size(own) / 2).cast("int")).alias("p95_ms_median"),
        *[F.round(F.avg(c), 6).alias(f"{c}_avg") for c in ("top1", "ndcg10", "recall10")],
    )


def trend(reports: DataFrame) -> DataFrame:
    """Each report against the one before it: improved, regressed, mixed or insufficient_history."""
    w = Window.orderBy("created_at", "run_id")
    d95, d1 = F.col("p95_ms") - F.lag("p95_ms").over(w), F.col("top1") - F.lag("top1").over(w)
    own = reports.withColumn("delta_p95", d95).withColumn("delta_top1", d1)
    status = (
        F.when(F.col("delta_p95").isNull() & F.col("delta_top1").isNull(), "insufficient_history").when((F.col("delta_p95") <= 0) & (F.col("delta_top1") >= 0), "improved")
        .when((F.col("delta_p95") > 0) & (F.col("delta_top1") < 0), "regressed").otherwise("mixed")
    )
    return own.withColumn("status", status)


def bucket_counts(cases: DataFrame, required: list[str]) -> DataFrame:
    """Cases by bucket, with a zero for each required bucket that has none; most first, then by name."""
    need = cases.sparkSession.createDataFrame([(b,) for b in required], "bucket string")
    return cases.select("bucket", F.lit(1).alias("n")).unionByName(need.withColumn("n", F.lit(0))).groupBy("bucket").agg(F.sum("n").alias("cases")).orderBy(F.desc("cases"), "bucket")


def apply_metrics(outcomes: DataFrame) -> DataFrame:
    """Reflection outcomes (outcome, latency_ms) as counts and ratios."""
    n, of = F.count("*"), lambda o: F.count_if(F.col("outcome") == o)
    ratio = lambda a: F.when(n == 0, 0.0).otherwise(F.round(a / n, 6))
    return outcomes.agg(
        n.alias("attempts"), of("applied").alias("applied"), of("stale_generation").alias("stale"), of("idempotent_event").alias("idempotent"),
        ratio(of("stale_generation")).alias("stale_ratio"), ratio(F.coalesce(F.sum("latency_ms"), F.lit(0))).alias("avg_latency"), F.coalesce(F.max("latency_ms"), F.lit(0)).alias("max_latency"),
    )


def thread_sections(sections: DataFrame, preferred: Column) -> DataFrame:
    """One observation text a scope from its threads' sections, and the task of the preferred or first thread.

    ``sections``: scope, thread, observations, task. Threads are few a scope; their texts make one value by definition.
    """
    lines = F.array_sort(F.collect_list(F.struct("thread", "observations")))
    text = F.array_join(F.transform(lines, lambda x: F.concat(F.lit('<thread id="'), x["thread"], F.lit('">\n'), x["observations"], F.lit("\n</thread>"))), "\n")
    rank = F.when(F.col("task").isNotNull(), F.struct((~preferred).cast("int"), "thread"))
    return sections.groupBy("scope").agg(text.alias("observations"), F.min_by("task", rank).alias("task"))


def last_observed(messages: DataFrame) -> DataFrame:
    """The newest message time of each thread."""
    return messages.groupBy("thread").agg(F.max("created_at").alias("last_observed"))
