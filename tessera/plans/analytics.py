"""Queue, trace, evaluation and gate reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.operators import evals as V
from tessera.operators import outbox as O

from .registry import query, table

OUTBOX_SQL = """outbox AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'embedding_upsert' WHEN 'click' THEN 'semantic_scan' WHEN 'purchase' THEN 'om_reflect_requested' WHEN 'signup' THEN 'upsert' ELSE 'om_observe_buffer_requested' END AS event_type,
  ts AS created_at, CASE event_type WHEN 'error' THEN 'dead_letter' WHEN 'signup' THEN 'done' WHEN 'view' THEN 'processing' ELSE 'new' END AS status,
  CAST(event_id % 7 AS INTEGER) AS attempt, ts + to_hours(CAST(event_id % 240 AS INTEGER)) AS next_attempt_at FROM events),
laned AS (SELECT *, CASE WHEN event_type = 'upsert' OR starts_with(event_type, 'embedding_') THEN 'embedding' ELSE 'semantic' END AS lane FROM outbox)"""


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.from_events(table(spark, sf_dir, "events"))


_DUE = "next_attempt_at <= TIMESTAMP '2024-02-01'"
_COUNTS = f"count(*) FILTER (status = 'new') AS new_total, count(*) FILTER (status = 'new' AND {_DUE}) AS new_due, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'done') AS processed, count(*) FILTER (status = 'dead_letter') AS dead"


@query(f"WITH {OUTBOX_SQL} SELECT lane, {_COUNTS}, min(CASE WHEN status = 'new' THEN next_attempt_at END) AS earliest FROM laned GROUP BY lane")
def q_queue_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.snapshot(_outbox(spark, sf_dir), "2024-02-01 00:00:00").where("lane is not null")


@query(f"WITH {OUTBOX_SQL} SELECT coalesce(lane, 'total') AS lane, {_COUNTS} FROM laned GROUP BY ROLLUP (lane)")
def q_queue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.snapshot(_outbox(spark, sf_dir), "2024-02-01 00:00:00").drop("earliest").withColumn("lane", F.coalesce("lane", F.lit("total")))


@query(f"WITH {OUTBOX_SQL} SELECT event_type, count(*) AS total, count(*) FILTER (status = 'dead_letter') AS dead, round(count(*) FILTER (status = 'dead_letter') / count(*), 6)::DOUBLE AS rate FROM outbox GROUP BY event_type")
def q_dead_letter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = F.count_if(F.col("status") == "dead_letter")
    return _outbox(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("total"), dead.alias("dead"), F.round(S.safe_ratio(dead, F.count("*")), 6).alias("rate"))


@query(f"WITH {OUTBOX_SQL} SELECT id, event_type, next_attempt_at FROM outbox WHERE status = 'new' AND {_DUE} ORDER BY id LIMIT 50")
def q_due_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.fetch(_outbox(spark, sf_dir), "new", "2024-02-01 00:00:00", 50).select("id", "event_type", "next_attempt_at")


@query(f"WITH {OUTBOX_SQL} SELECT id, CASE WHEN status = 'processing' AND created_at <= TIMESTAMP '2024-01-20' - INTERVAL 300 SECOND THEN 'new' ELSE status END AS status FROM outbox")
def q_stale_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.recover_stale(_outbox(spark, sf_dir), "2024-01-20 00:00:00", 300).select("id", "status")


_MOST = "CASE WHEN event_type = 'semantic_scan' THEN 5 WHEN event_type IN ('om_reflect_requested', 'om_reflect_buffer_requested', 'om_observe_buffer_requested') THEN 6 ELSE 3 END"
_CAP = "CASE WHEN event_type = 'semantic_scan' THEN 60 WHEN event_type IN ('om_reflect_requested', 'om_reflect_buffer_requested', 'om_observe_buffer_requested') THEN 120 ELSE 30 END"


@query(f"WITH {OUTBOX_SQL} SELECT id, attempt < {_MOST} AS retry, CAST(least(2 ** least(greatest(attempt - 1, 0), 6), {_CAP}) AS BIGINT) AS backoff FROM outbox")
def q_retry_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outbox(spark, sf_dir)
    return o.select("id", O.should_retry(F.col("event_type"), F.col("attempt")).alias("retry"), O.backoff(F.col("event_type"), F.col("attempt")).alias("backoff"))


_P = "list_sort(list(v))[CAST(((count(*) - 1) * {bp} + 5000) // 10000 AS BIGINT) + 1]"
_PCTS = ", ".join(f"{_P.format(bp=bp)} AS {name}" for bp, name in ((5000, "p50"), (9500, "p95"), (9900, "p99")))


@query(f"WITH t AS (SELECT event_type, CAST(ceil(value) AS BIGINT) AS v FROM events) SELECT event_type, count(*) AS traces, {_PCTS}, round(avg(v), 4) AS mean FROM t GROUP BY event_type")
def q_trace_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rounded-rank percentiles and means by request type.

    Percentiles come from a histogram of distinct whole values, so a group's
    size is the number of its distinct latencies, not of its traces.
    """
    t = table(spark, sf_dir, "events").select("event_type", F.ceil("value").cast("long").alias("v"))
    return O.latency_report(t, ["event_type"])


@query("SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def q_slowest20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(20)


_DAILY = "d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query(f"WITH {_DAILY} SELECT day, n, n - lag(n) OVER (ORDER BY day) AS change, round((n - lag(n) OVER (ORDER BY day)) * 100.0 / lag(n) OVER (ORDER BY day), 4)::DOUBLE AS percent FROM d")
def q_trend_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change against the day before; a window over a row a day."""
    before = F.lag("n").over(Window.orderBy("day"))
    return _daily(spark, sf_dir).select("day", "n", (F.col("n") - before).alias("change"), F.round((F.col("n") - before) * 100.0 / before, 4).alias("percent"))


@query(f"WITH {_DAILY}, r AS (SELECT day, n, errors, lag(n) OVER (ORDER BY day) AS prev FROM d) SELECT day, n >= 30 AS enough, errors / n <= 0.25 AS healthy, prev IS NULL OR (prev - n) * 100.0 / prev <= 30 AS steady, n >= 30 AND errors / n <= 0.25 AND (prev IS NULL OR (prev - n) * 100.0 / prev <= 30) AS passed FROM r")
def q_gate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run judged by itself and against the run before."""
    prev = F.lag("n").over(Window.orderBy("day"))
    d = _daily(spark, sf_dir).withColumn("prev", prev)
    enough, healthy, steady = F.col("n") >= 30, F.col("errors") / F.col("n") <= 0.25, F.col("prev").isNull() | ((F.col("prev") - F.col("n")) * 100.0 / F.col("prev") <= 30)
    return d.select("day", enough.alias("enough"), healthy.alias("healthy"), steady.alias("steady"), (enough & healthy & steady).alias("passed"))


@query(f"WITH {_DAILY}, f AS (SELECT day, n > 20 AS flag FROM d) SELECT CAST(count(*) AS BIGINT) AS trailing FROM f WHERE day > coalesce((SELECT max(day) FROM f WHERE NOT flag), DATE '1900-01-01')")
def q_trailing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of the last unbroken run of good days: days after the last bad one."""
    f = _daily(spark, sf_dir).select("day", (F.col("n") > 20).alias("flag"))
    bad = f.agg(F.coalesce(F.max(F.when(~F.col("flag"), F.col("day"))), F.lit("1900-01-01").cast("date")).alias("last_bad"))
    return f.crossJoin(F.broadcast(bad)).agg(F.count_if(F.col("day") > F.col("last_bad")).alias("trailing"))  # one row is broadcast


_CASES = """cases AS (SELECT item_id, lower(trim(text)) AS query, item_id AS expected, 0 AS src FROM benchmark
UNION ALL SELECT item_id, lower(trim('how to ' || text)), item_id, 1 FROM benchmark WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 2 AND NOT starts_with(lower(trim(text)), 'how to ') UNION ALL SELECT doc_id, lower(trim(text)), doc_id, 2 FROM documents)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    trim = lambda c: F.lower(F.trim(c))
    golden = b.select("item_id", trim(F.col("text")).alias("query"), F.col("item_id").alias("expected"), F.lit(0).alias("src"))
    variants = b.select("item_id", F.explode(O.stress_variants(F.col("text"))).alias("v")).where("v.kind = 'paraphrase'")
    stress = variants.select("item_id", trim(F.col("v.variant")), F.col("item_id"), F.lit(1))
    traces = d.select("doc_id", trim(F.col("text")), "doc_id", F.lit(2))
    return golden.union(stress).union(traces)


@query(f"WITH {_CASES} SELECT query, expected, src FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY src, item_id) AS rn FROM cases) WHERE rn = 1")
def q_eval_cases_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden, stress and trace cases, one for each query, by order of sources: an aggregate with map-side combine."""
    first = F.min(F.struct("src", "item_id", "expected"))
    return _cases(spark, sf_dir).groupBy("query").agg(first.alias("f")).select("query", F.col("f.expected").alias("expected"), F.col("f.src").alias("src"))


_RANKS = """r AS (SELECT l.doc_id, l.doc_id % 37 AS rank0, l.quality, l.toxic FROM labels l), c AS (SELECT *, rank0 + 1 AS rank FROM r)"""


@query(f"WITH {_RANKS} SELECT CASE WHEN rank = 1 THEN 'pass' WHEN rank > 30 THEN 'no_results' WHEN quality = 0 THEN 'missing_expectation' WHEN toxic = 1 THEN 'target_scope_mismatch' ELSE 'ranking_regression' END AS bucket, count(*) AS n FROM c GROUP BY 1")
def q_eval_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.col("doc_id") % 37 + 1
    bucket = (
        F.when(rank == 1, "pass").when(rank > 30, "no_results").when(F.col("quality") == 0, "missing_expectation")
        .when(F.col("toxic") == 1, "target_scope_mismatch").otherwise("ranking_regression")
    )
    return table(spark, sf_dir, "labels").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {_RANKS} SELECT quality, count(*) AS cases, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg10, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall10, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS top1 FROM c GROUP BY quality")
def q_ndcg_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG, recall and top-1 of single-answer cases."""
    rank = F.col("doc_id") % 37 + 1
    at = lambda ok, v: F.round(F.avg(F.when(ok, v).otherwise(0.0)), 6)
    return table(spark, sf_dir, "labels").groupBy("quality").agg(
        F.count("*").alias("cases"), at(rank <= 10, 1 / F.log2(rank + 1)).alias("ndcg10"), at(rank <= 10, F.lit(1.0)).alias("recall10"), at(rank == 1, F.lit(1.0)).alias("top1")
    )


@query(r"""WITH q AS (SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' ') AS query FROM benchmark), t AS (SELECT item_id, query, string_split(query, ' ') AS w FROM q)
SELECT item_id, 'paraphrase' AS kind, 'how to ' || query AS variant FROM t WHERE len(w) >= 2 AND NOT starts_with(lower(query), 'how to ')
UNION ALL SELECT item_id, 'typo', array_to_string(list_transform(w, lambda x, i: CASE WHEN i = pos THEN x[1:len(x) // 2] || x[len(x) // 2 + 2:] ELSE x END), ' ') FROM (SELECT *, len(w) - list_position(list_reverse(list_transform(w, lambda x: len(x))), list_max(list_transform(w, lambda x: len(x)))) + 1 AS pos FROM t) WHERE len(w[pos]) >= 5""")
def q_stress_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paraphrased and misspelt variants of each item."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    q = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("query"))
    return q.select("item_id", F.explode(O.stress_variants(F.col("query"))).alias("v")).select("item_id", "v.kind", "v.variant")


@query(r"SELECT class, count(*) AS n FROM (SELECT CASE WHEN (regexp_matches(text, '::|[/._]') OR regexp_matches(text, '[0-9]')) AND n < 4 THEN 'lexical' WHEN regexp_matches(text, '::|[/._]') OR regexp_matches(text, '[0-9]') THEN 'mixed' WHEN n >= 4 THEN 'semantic' ELSE 'mixed' END AS class FROM (SELECT text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM benchmark)) GROUP BY class")
def q_query_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every query of the set, counted."""
    mark = F.col("text").rlike(r"::|[/._]|[0-9]")
    n = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    kind = F.when(mark & (n < 4), "lexical").when(mark, "mixed").when(n >= 4, "semantic").otherwise("mixed")
    return table(spark, sf_dir, "benchmark").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE lower(event_type) = 'error' AND json_extract_string(props, '$.k') IS NOT NULL ORDER BY event_id DESC LIMIT 100")
def q_request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest log rows of one operation, names in any case."""
    e = table(spark, sf_dir, "events")
    ok = (F.lower("event_type") == "error") & F.get_json_object("props", "$.k").isNotNull()
    return e.where(ok).select("event_id", "event_type").orderBy(F.desc("event_id")).limit(100)


@query("SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CASE WHEN count(*) >= 5000 OR sum(strlen(text)) >= 1073741824 THEN 'M' WHEN count(*) >= 1500 OR sum(strlen(text)) >= 314572800 THEN 'S' ELSE 'custom' END AS profile FROM documents")
def q_corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b = F.count("*"), F.sum(F.octet_length("text"))
    kind = F.when((n >= 5000) | (b >= 1 << 30), "M").when((n >= 1500) | (b >= 300 << 20), "S").otherwise("custom")
    return table(spark, sf_dir, "documents").agg(n.alias("files"), b.alias("bytes"), kind.alias("profile"))


@query("""WITH g AS (SELECT item_id, text AS query FROM benchmark), t AS (SELECT lower(text) AS q, min(doc_id) AS pos, min_by(text, doc_id) AS query FROM documents GROUP BY 1)
SELECT query, 'ctx://resources/b/' || item_id AS expected_uri, 'golden' AS source FROM g UNION ALL (SELECT query, 'ctx://resources/b/' || pos, 'golden-seed' FROM t WHERE q NOT IN (SELECT lower(query) FROM g) ORDER BY pos LIMIT 5)""")
def q_golden_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cases with up to five new ones from traces."""
    case = lambda id, source: [F.col("text").alias("query"), F.concat(F.lit("ctx://resources/b/"), F.col(id).cast("string")).alias("expected_uri"), F.lit(source).alias("source"), F.col(id).alias("pos")]
    golden, traces = table(spark, sf_dir, "benchmark").select(*case("item_id", "golden")), table(spark, sf_dir, "documents").select(*case("doc_id", "trace"))
    return V.merge_golden(golden, traces, 5).drop("pos")


_RUNS_SQL = "runs AS (SELECT CAST(ts AS DATE) AS day, CAST(max(ceil(value)) AS BIGINT) AS p95_ms, round(count(*) FILTER (event_type <> 'error') / count(*), 4) AS top1 FROM events GROUP BY 1)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("ts").cast("date").alias("day")).agg(F.max(F.ceil("value")).cast("long").alias("p95_ms"), F.round(F.count_if(F.col("event_type") != "error") / F.count("*"), 4).alias("top1"))


@query(f"WITH {_RUNS_SQL} SELECT count(*) AS iterations, list_sort(list(p95_ms))[count(*) // 2 + 1] AS p95_ms_median, round(avg(top1), 6) AS top1_avg FROM runs")
def q_amortized_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of the iterations' latency and their mean accuracy; a row a day goes in."""
    r = _runs(spark, sf_dir).withColumns({"ndcg10": F.col("top1"), "recall10": F.col("top1")})
    return V.amortized(r).select("iterations", "p95_ms_median", "top1_avg")


@query(f"WITH {_RUNS_SQL}, d AS (SELECT day, p95_ms - lag(p95_ms) OVER (ORDER BY day) AS a, top1 - lag(top1) OVER (ORDER BY day) AS b FROM runs) SELECT day, CASE WHEN a IS NULL AND b IS NULL THEN 'insufficient_history' WHEN a <= 0 AND b >= 0 THEN 'improved' WHEN a > 0 AND b < 0 THEN 'regressed' ELSE 'mixed' END AS status FROM d")
def q_benchmark_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's trend against the run before."""
    return V.trend(_runs(spark, sf_dir).withColumns({"run_id": F.col("day"), "created_at": F.col("day")})).select("day", "status")


@query("SELECT bucket, CAST(sum(n) AS BIGINT) AS cases FROM (SELECT event_type AS bucket, 1 AS n FROM events UNION ALL SELECT * FROM (VALUES ('click', 0), ('filter_ignored', 0), ('relation_missing', 0))) GROUP BY bucket")
def q_required_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets with zeros for the required ones that have no case."""
    cases = table(spark, sf_dir, "events").select(F.col("event_type").alias("bucket"))
    return V.bucket_counts(cases, ["click", "filter_ignored", "relation_missing"])


@query("SELECT count(*) AS attempts, count(*) FILTER (event_id % 4 < 2) AS applied, count(*) FILTER (event_id % 4 = 2) AS stale, count(*) FILTER (event_id % 4 = 3) AS idempotent, round(count(*) FILTER (event_id % 4 = 2) / count(*), 6) AS stale_ratio, round(sum(CAST(ceil(value) AS BIGINT)) / count(*), 6) AS avg_latency, CAST(max(ceil(value)) AS BIGINT) AS max_latency FROM events")
def q_apply_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflection outcomes as counts and ratios."""
    kind = F.when(F.col("event_id") % 4 < 2, "applied").when(F.col("event_id") % 4 == 2, "stale_generation").otherwise("idempotent_event")
    return V.apply_metrics(table(spark, sf_dir, "events").select(kind.alias("outcome"), F.ceil("value").cast("long").alias("latency_ms")))


@query("""WITH s AS (SELECT conv_id // 4 AS scope, conv_id::VARCHAR AS thread, string_agg(role || turn, ' ' ORDER BY turn) AS observations, max(CASE WHEN role = 'user' THEN conv_id::VARCHAR END) AS task FROM conversations GROUP BY conv_id)
SELECT scope, string_agg('<thread id="' || thread || '">' || chr(10) || observations || chr(10) || '</thread>', chr(10) ORDER BY thread) AS observations, coalesce(min(task) FILTER (CAST(thread AS BIGINT) % 4 = 2), min_by(task, thread) FILTER (task IS NOT NULL)) AS task FROM s GROUP BY scope""")
def q_thread_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of several threads as one text, with the preferred thread's task."""
    c = table(spark, sf_dir, "conversations")
    name = F.col("conv_id").cast("string")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], x["turn"].cast("string"))), " ")
    s = c.groupBy("conv_id").agg(words.alias("observations"), F.max(F.when(F.col("role") == "user", name)).alias("task")).select(F.floor(F.col("conv_id") / 4).alias("scope"), name.alias("thread"), "observations", "task")
    return V.thread_sections(s, F.col("thread").cast("long") % 4 == 2)
