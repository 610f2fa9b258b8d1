"""Benchmark suites, probes, evidence, release decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import engine as E
from tessera.operators import ontology as H
from tessera.operators import suite as U

from .memory import SAID_SQL, _category_sql, _said
from .registry import query, table
from .retrieval import DOCS_SQL, WORDS_SQL, _docs
from .search import ENTRIES_SQL, scored_sql, search_index

_CASE_SQL = f"""{DOCS_SQL}, {WORDS_SQL}, lens AS (SELECT uri, sum(tf) AS doc_len, count(*) AS terms FROM post GROUP BY uri), corpus AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM lens),
cs AS (SELECT item_id AS case_id, text AS query, CASE WHEN item_id % 9 <> 0 THEN 'ctx://resources/src' || item_id % 3 || '/en/' || item_id || '.txt' END AS expected_uri, CASE WHEN item_id % 4 = 0 THEN 'ctx://resources/src1' END AS target_uri, CASE WHEN item_id % 2 = 0 THEN 'stress:typo' ELSE 'golden' END AS source FROM benchmark),
qt AS (SELECT DISTINCT case_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM cs), dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
sc AS (SELECT case_id, uri, round(sum(greatest(ln(1 + (n - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 4) AS score FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (uri) CROSS JOIN corpus GROUP BY ALL),
fd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, uri) AS rank FROM sc) WHERE rank <= 10), tp AS (SELECT case_id, min_by(uri, rank) AS top_uri FROM fd GROUP BY case_id),
res AS (SELECT cs.*, top_uri, fd.rank, CASE WHEN cs.expected_uri IS NULL THEN 'missing_expectation' WHEN top_uri IS NULL THEN 'no_results' WHEN top_uri = cs.expected_uri THEN 'pass' WHEN target_uri IS NOT NULL AND NOT starts_with(top_uri, target_uri || '/') THEN 'target_scope_mismatch' ELSE 'ranking_regression' END AS bucket FROM cs LEFT JOIN tp USING (case_id) LEFT JOIN fd ON fd.case_id = cs.case_id AND fd.uri = cs.expected_uri)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id")
    uri = F.concat(F.lit("ctx://resources/src"), (k % 3).cast("string"), F.lit("/en/"), k.cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "benchmark").select(
        k.alias("case_id"), F.col("text").alias("query"), F.when(k % 9 != 0, uri).alias("expected_uri"), F.when(k % 4 == 0, "ctx://resources/src1").alias("target_uri"), F.when(k % 2 == 0, "stress:typo").otherwise("golden").alias("source")
    )


@query(f"WITH {_CASE_SQL} SELECT case_id, source, expected_uri, top_uri, rank, bucket, bucket = 'pass' AS passed FROM res")
def q_case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark cases searched at once, with how each fared."""
    c = _cases(spark, sf_dir)
    return U.case_results(c, U.batch_search(_docs(spark, sf_dir), c)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_CASE_SQL} SELECT count(*) AS cases, count(expected_uri) AS graded, round(count(*) FILTER (bucket = 'pass') / count(expected_uri), 6) AS top1, round(coalesce(sum(1 / log2(rank + 1)) FILTER (expected_uri IS NOT NULL), 0) / count(expected_uri), 6) AS ndcg10, round(count(rank) / count(expected_uri), 6) AS recall10, round(avg(CASE WHEN bucket = 'pass' THEN 1.0 ELSE 0.0 END) FILTER (starts_with(source, 'stress:')), 6)::DOUBLE AS stress_top1 FROM res")
def q_benchmark_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality row of the suite: top-1, NDCG, recall, and the stress cases' top-1."""
    return U.run_suite(_docs(spark, sf_dir), _cases(spark, sf_dir))


_PROBE, _PROBE_TAG = "recent license", "en"


@query(f"""WITH RECURSIVE {ENTRIES_SQL}, {scored_sql("pa", _PROBE)}, f AS (SELECT count(*) AS n FROM (SELECT uri FROM pas JOIN docs USING (uri) WHERE lang = '{_PROBE_TAG}' LIMIT 10)),
{SAID_SQL}, a AS (SELECT count(*) AS n FROM msgs WHERE contains(lower(text), 'recent') OR contains(lower(text), 'license')), w AS (SELECT count(DISTINCT category) AS n FROM ({_category_sql()}))
SELECT 'filter' AS probe, 'filter_ignored' AS bucket, n AS checked, n > 0 AS passed FROM f UNION ALL SELECT 'relation', 'relation_missing', 5 * n, n > 0 FROM f UNION ALL SELECT 'intent', 'intent_miss', 1, true UNION ALL SELECT 'archive', 'archive_context_miss', n, n > 0 FROM a UNION ALL SELECT 'memory', 'memory_category_miss', n, n >= 3 FROM w""")
def q_eval_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of filters, relations, plans, archives and memories over the documents and the messages; ten documents each are related."""
    docs = _docs(spark, sf_dir)
    related = docs.groupBy(F.floor(F.col("doc_id") / 10).cast("string").alias("id")).agg(F.lit("ctx://resources").alias("owner_uri"), F.collect_list("uri").alias("uris"), F.lit("probe").alias("reason"))  # ten documents each
    return U.probes(E.Stored(spark, search_index(spark, sf_dir)), docs.select("uri", "tags"), related, _said(spark, sf_dir), _PROBE, _PROBE_TAG, 3)


_EVIDENCE = "SELECT true AS contract, true AS build, count(*) FILTER (event_type = 'click') > 0 AS reliability, count(*) AS executed, 1.0 - count(*) FILTER (event_type = 'error') / count(*) AS top1, count(*) FILTER (event_type = 'refund') AS filter_ignored, 0 AS relation_missing, true AS memory, count(*) FILTER (event_type = 'error') AS memory_category_miss, true AS audit, false AS audit_strict, max(value) < 1e9 AS benchmark, true AS operability FROM events"


@query(f"""WITH e AS ({_EVIDENCE}), d AS (SELECT unnest([{{'gate': 'G0', 'name': 'contract_integrity', 'passed': contract}}, {{'gate': 'G1', 'name': 'build_quality', 'passed': build}}, {{'gate': 'G2', 'name': 'reliability_evidence', 'passed': reliability}}, {{'gate': 'G3', 'name': 'eval_quality', 'passed': executed > 0 AND top1 >= 0.75 AND filter_ignored = 0 AND relation_missing = 0}},
 {{'gate': 'G4', 'name': 'session_memory', 'passed': memory AND memory_category_miss = 0}}, {{'gate': 'G5', 'name': 'security_audit', 'passed': audit AND audit_strict}}, {{'gate': 'G6', 'name': 'benchmark', 'passed': benchmark}}, {{'gate': 'G7', 'name': 'operability_evidence', 'passed': operability}}]) AS d FROM e), b AS (SELECT count(*) FILTER (NOT d.passed) AS n FROM d)
SELECT d.gate, d.name, d.passed, CAST(n AS INTEGER) AS blockers, n = 0 AS pack_passed FROM d, b UNION ALL SELECT 'G8', 'blocker_rollup', n = 0, CAST(n AS INTEGER), n = 0 FROM b""")
def q_release_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release decisions from the evidence, with the roll-up of blockers."""
    kind, n = F.col("event_type"), F.count("*")
    e = table(spark, sf_dir, "events").agg(
        F.lit(True).alias("contract"), F.lit(True).alias("build"), (F.count_if(kind == "click") > 0).alias("reliability"), n.alias("executed"), (1.0 - F.count_if(kind == "error") / n).alias("top1"), F.count_if(kind == "refund").alias("filter_ignored"),
        F.lit(0).alias("relation_missing"), F.lit(True).alias("memory"), F.count_if(kind == "error").alias("memory_category_miss"), F.lit(True).alias("audit"), F.lit(False).alias("audit_strict"), (F.max("value") < 1e9).alias("benchmark"), F.lit(True).alias("operability"),
    )
    return U.release_pack(e)


@query("""WITH s AS (SELECT count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'click') AS due, max(event_id) AS after_ FROM events) SELECT unnest([{'check': 'replay_processed_events', 'passed': done > 0}, {'check': 'queue_drained_after_replay', 'passed': due = 0}, {'check': 'dead_letter_not_increased', 'passed': true}, {'check': 'replay_checkpoint_advanced', 'passed': after_ > 10}, {'check': 'replay_checkpoint_recorded', 'passed': true}, {'check': 'searchable_after_replay', 'passed': true}, {'check': 'searchable_after_restart', 'passed': false}], recursive := true) FROM s
UNION ALL SELECT unnest([{'check': 'request_logs_present', 'passed': true}, {'check': 'trace_metrics_present', 'passed': false}, {'check': 'queue_diagnostics_collected', 'passed': true}], recursive := true)""")
def q_evidence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability and operability checks from counts."""
    kind = F.col("event_type")
    s = table(spark, sf_dir, "events").agg(
        F.count_if(kind == "purchase").alias("done"), F.count_if(kind == "click").alias("new_due"), F.lit(0).alias("processing"), F.lit(5).alias("dead_before"), F.lit(5).alias("dead_after"), F.lit(10).cast("long").alias("checkpoint_before"),
        F.max("event_id").alias("checkpoint_after"), F.lit("ctx://x").alias("replay_hit"), F.lit(None).cast("string").alias("restart_hit"), F.count("*").alias("request_logs"), F.lit(0).alias("traces"), F.lit(0).alias("request_types"),
    )
    return U.reliability_checks(s).unionByName(U.operability_checks(s))


@query("WITH d AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, sum(CAST(floor(o_totalprice) AS BIGINT)) AS p FROM orders GROUP BY o_custkey) SELECT o_custkey, round(CASE WHEN f <> 0 THEN (n - f) / f * 100 END, 6) AS delta, round(CASE WHEN f > 0 THEN (f - n) / f * 100 END, 6) AS drop_, CAST(ceil(p / 1000) AS BIGINT) AS units FROM d")
def q_percent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes and drops in percent, null where nothing was before, and durations rounded up."""
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.sum(F.floor("o_totalprice")).alias("p"))
    return d.select("o_custkey", F.round(U.percent_delta(F.col("n"), F.col("f")), 6).alias("delta"), F.round(U.percent_drop(F.col("n"), F.col("f")), 6).alias("drop_"), U.latency_units(F.col("p"), 1000).alias("units"))


@query("""WITH g AS (SELECT text AS query, 'old' AS source FROM documents), c AS (SELECT lower(text) AS query, 'new' AS source FROM benchmark UNION ALL SELECT ' ' || lower(text) || ' ', 'new' FROM documents JOIN labels USING (doc_id))
SELECT query, source FROM g WHERE lower(trim(query, ' ')) NOT IN (SELECT lower(trim(query, ' ')) FROM c) UNION ALL SELECT query, source FROM c""")
def q_golden_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cases, one of every document, with those of the benchmark and of labelled documents added; those of the same query are replaced."""
    d, b, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "labels")
    new = b.select(F.lower("text").alias("query")).unionByName(d.join(labels, "doc_id").select(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).alias("query"))).withColumn("source", F.lit("new"))
    return U.add_golden(d.select(F.col("text").alias("query"), F.lit("old").alias("source")), new)


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown_action' WHEN event_id % 3 = 0 THEN 'input' ELSE 'queued' END AS outcome, CASE WHEN event_type IN ('click', 'view') AND event_id % 3 <> 0 THEN CAST(to_json({'action_id': event_type, 'input': props}) AS VARCHAR) END AS payload_json FROM events""")
def q_action_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested actions as outbox rows, where the action is known and its input fits."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("action_id"), F.when(F.col("event_id") % 3 == 0, "[1]").otherwise(F.col("props")).alias("input"))
    return H.enqueue(e, {"click": "json-object", "view": "json-object"}).select("event_id", "outcome", "payload_json")
