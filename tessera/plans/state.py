"""Outbox replay, observer state and the request interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import gates as G
from tessera.operators import observe as B
from tessera.operators import outbox as O
from tessera.streaming import observer as V

from .analytics import _CAP, _MOST, OUTBOX_SQL, _outbox
from .memory import MSG_SQL, _msgs
from .registry import query, table

_REPLAY = f"""WITH {OUTBOX_SQL}, r AS (SELECT *, attempt + 1 AS a FROM (SELECT * EXCLUDE (status), CASE WHEN status = 'processing' AND created_at <= TIMESTAMP '2024-02-01' - INTERVAL 300 SECOND THEN 'new' ELSE status END AS status FROM outbox) WHERE status = 'new' AND next_attempt_at <= TIMESTAMP '2024-02-01' ORDER BY id LIMIT 500),
s AS (SELECT id, a AS attempt, next_attempt_at, CASE WHEN id % 3 = 0 AND a < {_MOST.replace('attempt', 'a')} THEN 'requeued' WHEN id % 3 = 0 THEN 'dead_letter' ELSE 'done' END AS outcome, CAST(least(2 ** least(greatest(a - 1, 0), 6), {_CAP}) AS BIGINT) AS wait FROM r)"""


@query(f"{_REPLAY} SELECT id, outcome, attempt, CASE WHEN outcome = 'requeued' THEN TIMESTAMP '2024-02-01' + to_seconds(wait) ELSE next_attempt_at END AS next_attempt_at FROM s")
def q_outbox_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One replay pass; every third handler call fails."""
    return O.replay(_outbox(spark, sf_dir), "2024-02-01 00:00:00", 500, F.col("id") % 3 == 0)


@query(f"{_REPLAY} SELECT outcome, count(*) AS events FROM s GROUP BY outcome")
def q_replay_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.replay_report(O.replay(_outbox(spark, sf_dir), "2024-02-01 00:00:00", 500, F.col("id") % 3 == 0))


_P, _O = "(s.p + x)", "(s.o + CASE WHEN s.p + x >= 200 THEN CAST(ceil((s.p + x) / 4.0) AS BIGINT) ELSE 0 END)"


@query(f"""WITH {MSG_SQL}, f AS (SELECT session_id, list_reduce(list(CAST(ceil(length(text) / 4.0) AS BIGINT) ORDER BY turn, id), lambda s, x: {{'p': CASE WHEN {_P} >= 200 THEN 0 ELSE {_P} END, 'o': CASE WHEN {_O} > 300 THEN {_O} // 2 ELSE {_O} END, 'c': s.c + CASE WHEN {_P} >= 200 THEN 1 ELSE 0 END,
 'd': s.d + CASE WHEN {_P} < 200 AND {_P} > 0 AND {_P} // 50 > s.p // 50 THEN 1 ELSE 0 END, 'r': s.r + CASE WHEN {_O} > 300 THEN 1 ELSE 0 END}}, {{'p': 0::BIGINT, 'o': 0::BIGINT, 'c': 0, 'd': 0, 'r': 0}}) AS s FROM msgs GROUP BY session_id)
SELECT session_id, CAST(s.p AS INTEGER) AS pending, CAST(s.o AS INTEGER) AS observed, CAST(s.c AS INTEGER) AS chunks, CAST(s.d AS INTEGER) AS deferred, CAST(s.r AS INTEGER) AS reflections, CAST(s.r AS INTEGER) AS generation FROM f""")
def q_observer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observer state of each session after its messages, folded in order."""
    return V.fold_batch(_msgs(spark, sf_dir))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, ceil(quantile_cont(value, 0.5)) AS p95, count(*) FILTER (event_type <> 'error') / count(*) AS top1 FROM events GROUP BY 1), r AS (SELECT day, p95, top1, lag(top1) OVER (ORDER BY day) AS prev FROM d),
j AS (SELECT day, p95 <= 600 AND top1 >= 0.75 AND NOT coalesce((prev - top1) * 100 / prev > 3, false) AS passed FROM r ORDER BY day DESC LIMIT 5) SELECT day, passed, (SELECT count(*) FILTER (passed) FROM j) >= 2 AS gate_passed FROM j""")
def q_benchmark_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest runs against thresholds and the run before, with a quorum."""
    e = table(spark, sf_dir, "events")
    d = e.groupBy(F.col("ts").cast("date").alias("day")).agg(F.ceil(F.percentile("value", 0.5)).cast("double").alias("p95_ms"), (F.count_if(F.col("event_type") != "error") / F.count("*")).alias("top1"))
    runs = d.select(F.col("day").alias("run_id"), F.col("day").alias("created_at"), "p95_ms", "top1", F.col("top1").alias("ndcg10"))
    return G.gate(runs, 5, 2).select(F.col("run_id").alias("day"), "passed", "gate_passed")


@query(f"""WITH {MSG_SQL}, l AS (SELECT session_id, id, turn, '[' || role || '] ' || rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240)) AS line FROM msgs WHERE trim(text, ' ') <> ''), f AS (SELECT session_id, line, min_by(id, (turn, id)) AS id FROM l GROUP BY ALL)
SELECT session_id, id, line FROM f WHERE (session_id, line) NOT IN (SELECT session_id, line FROM l WHERE turn = 0)""")
def q_observation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New observation lines of each session; those of the first turn are active already."""
    m = _msgs(spark, sf_dir)
    nothing = m.select("session_id", F.lit("").alias("line")).limit(0)
    active = B.synthesize(m.where("turn = 0"), nothing)
    return B.synthesize(m, active)


@query(f"""WITH {MSG_SQL}, e AS (SELECT session_id AS scope, id AS entry_id, CASE WHEN turn % 4 = 0 THEN 'high' ELSE 'medium' END AS priority, created_at, substr(text, 1, 60) AS line, CAST(turn % 2 AS INTEGER) AS origin FROM msgs),
u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY scope ORDER BY CASE WHEN priority <> 'high' THEN 1 ELSE 0 END, created_at DESC, entry_id ROWS UNBOUNDED PRECEDING) AS used FROM e) SELECT scope, entry_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 150""")
def q_bounded_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each scope that fit a hint of 150 characters."""
    m = _msgs(spark, sf_dir)
    e = m.select(F.col("session_id").alias("scope"), F.col("id").alias("entry_id"), F.when(F.col("turn") % 4 == 0, "high").otherwise("medium").alias("priority"), "created_at", F.substring("text", 1, 60).alias("line"), "turn")
    seen = B.visible_entries(e.where("turn % 2 = 0"), e)
    return B.bounded_hint(seen, 150).select("scope", "entry_id", "used")


@query(f"""WITH {MSG_SQL}, t AS (SELECT session_id, list(id ORDER BY turn, id) AS ids, list(turn ORDER BY turn, id) AS turns, list(CAST(ceil(length(text) / 4.0) AS BIGINT) ORDER BY turn, id) AS toks FROM msgs GROUP BY session_id),
f AS (SELECT *, list_reduce(toks, lambda s, x: {{'b': CASE WHEN s.u > 0 AND s.u + x > 150 THEN s.b + 1 ELSE s.b END, 'u': CASE WHEN s.u > 0 AND s.u + x > 150 THEN x ELSE s.u + x END, 'o': list_append(s.o, CASE WHEN s.u > 0 AND s.u + x > 150 THEN s.b + 1 ELSE s.b END)}}, {{'b': 0, 'u': 0::BIGINT, 'o': []::INTEGER[]}}) AS s FROM t)
SELECT session_id, unnest(ids) AS id, unnest(turns) AS turn, unnest(toks) AS tokens, unnest(s.o) AS batch FROM f""")
def q_batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each session in batches of at most 150 tokens."""
    rows = _msgs(spark, sf_dir).select("session_id", "id", "turn", T.estimate_tokens(F.col("text")).alias("tokens"))
    return B.pack(rows, "session_id", ["turn", "id"], "tokens", 150)


@query("""WITH f AS (SELECT event_id AS id, event_type AS category, props AS text, CAST(floor(value * 3) AS INTEGER) AS confidence FROM events), ok AS (SELECT * FROM f WHERE confidence <= 1000 AND length(text) <= 512 AND trim(text, ' ') <> '')
SELECT category, text, min(id) AS id, max(confidence) AS confidence FROM ok WHERE (category, text) NOT IN (SELECT category, text FROM f WHERE id % 50 = 0) GROUP BY category, text""")
def q_promotion_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-effort promotion of events as facts."""
    f = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.col("props").alias("text"), F.array("event_id").alias("ids"), F.floor(F.col("value") * 3).cast("int").alias("confidence"))
    return B.promote(f, f.where("id % 50 = 0"), best_effort=True)


@query("""WITH l AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 9 <> 0), d AS (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 8 <> 0)
SELECT CAST(coalesce(l.doc_id, d.doc_id) AS VARCHAR) AS uri, CASE WHEN d.h IS NULL THEN 'missing' WHEN l.h IS NULL THEN 'untracked' ELSE 'changed' END AS drift FROM l FULL JOIN d ON l.doc_id = d.doc_id WHERE l.h IS DISTINCT FROM d.h""")
def q_reconcile_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of hashes against the documents."""
    d = table(spark, sf_dir, "documents")
    uri = F.col("doc_id").cast("string").alias("uri")
    now = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return B.drift(d.where("doc_id % 9 <> 0").select(uri, F.md5("text").alias("hash")), d.where("doc_id % 8 <> 0").select(uri, F.md5(now).alias("hash")))


@query("SELECT count(*) FILTER (event_id % 5 <> 0) AS found, count(*) FILTER (event_id % 5 = 0) AS missing, CAST(0 AS BIGINT) AS invalid FROM events")
def q_trace_index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace index against its documents."""
    e = table(spark, sf_dir, "events")
    return B.trace_join(e.select(F.col("event_id").alias("trace_id")), e.where("event_id % 5 <> 0").select(F.col("event_id").alias("trace_id"), F.col("props").alias("payload")))
