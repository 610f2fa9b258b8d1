"""Observational memory: compare-and-set writes, responses, reflections, events, promotions, hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import signals as G
from tessera.functions import text as T
from tessera.operators import memory as M
from tessera.operators import om as Z
from tessera.operators import ranking as K

from .analytics import OUTBOX_SQL, _outbox
from .memory import MSG_SQL, _category_sql, _msgs, _said
from .memory import SAID_SQL
from .registry import query, table

_REC_SQL = f"""{MSG_SQL}, rec AS (SELECT 's' || session_id AS scope_key, session_id % 4 AS generation, CASE WHEN session_id % 3 = 0 THEN 'waits' WHEN session_id % 3 = 1 THEN ' ' END AS buffered_reflection, true AS is_buffering, session_id % 5 AS last_event FROM (SELECT DISTINCT session_id FROM msgs)),
req AS (SELECT 's' || session_id AS scope_key, session_id % 2 AS expected_generation, min_by(text, turn) AS reflection, CAST(count(*) AS BIGINT) AS input_tokens FROM msgs WHERE session_id % 6 <> 5 GROUP BY session_id)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("session_id")
    waits = F.when(k % 3 == 0, "waits").when(k % 3 == 1, " ")
    return _msgs(spark, sf_dir).select("session_id").distinct().select(
        F.concat(F.lit("s"), k.cast("string")).alias("scope_key"), (k % 4).alias("generation"), waits.alias("buffered_reflection"), F.lit(None).cast("long").alias("buffered_tokens"),
        F.lit(None).cast("long").alias("buffered_input_tokens"), F.lit(True).alias("is_buffering"), F.lit(True).alias("is_reflecting"), (k % 5).alias("last_event"), F.lit("").alias("active_observations"), F.lit(0).cast("long").alias("observation_tokens"),
    )


@query(f"""WITH {_REC_SQL}, j AS (SELECT rec.*, req.reflection, req.input_tokens, CASE WHEN req.scope_key IS NULL THEN NULL WHEN generation <> expected_generation THEN 'stale_generation' WHEN trim(coalesce(buffered_reflection, ''), ' ') <> '' THEN 'already_buffered' ELSE 'buffered' END AS outcome FROM rec LEFT JOIN req USING (scope_key))
SELECT scope_key, outcome, coalesce(outcome, '') NOT IN ('buffered', 'already_buffered') AS is_buffering, CASE WHEN outcome = 'buffered' THEN reflection ELSE buffered_reflection END AS buffered_reflection, CASE WHEN outcome = 'buffered' THEN CAST(ceil(length(reflection) / 4.0) AS BIGINT) END AS buffered_tokens, CASE WHEN outcome = 'buffered' THEN input_tokens END AS buffered_input_tokens FROM j""")
def q_buffer_reflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflections buffered where the generation is the expected one and none waits."""
    m = _msgs(spark, sf_dir).where("session_id % 6 <> 5").groupBy("session_id").agg(F.min_by("text", "turn").alias("reflection"), F.count("*").alias("input_tokens"))
    req = m.select(F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("scope_key"), (F.col("session_id") % 2).alias("expected_generation"), "reflection", "input_tokens")
    return Z.buffer_reflection(_records(spark, sf_dir), req).select("scope_key", "outcome", "is_buffering", "buffered_reflection", "buffered_tokens", "buffered_input_tokens")


@query(f"WITH {_REC_SQL} SELECT scope_key, generation <> 1 AS is_reflecting, generation <> 1 AS is_buffering FROM rec")
def q_clear_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflection flags cleared for one generation."""
    r = _records(spark, sf_dir)
    return Z.clear_flags(r, r.select("scope_key", F.lit(1).cast("long").alias("expected_generation"))).select("scope_key", "is_reflecting", "is_buffering")


_CAS_SQL = f"""{_REC_SQL}, ent AS (SELECT 's' || session_id AS scope_key, id AS entry_id, text, created_at FROM msgs), refl AS (SELECT 's' || session_id AS scope_key, session_id % 7 AS event_id, session_id % 2 AS expected_generation, CASE WHEN session_id % 11 = 3 THEN ' ' ELSE ' merged ' || session_id END AS reflection FROM (SELECT DISTINCT session_id FROM msgs)),
judged AS (SELECT r.scope_key, event_id, trim(reflection, ' ') AS reflection, CASE WHEN last_event = event_id THEN 'idempotent_event' WHEN generation <> expected_generation THEN 'stale_generation' ELSE 'applied' END AS outcome FROM refl r JOIN rec USING (scope_key)),
full_ AS (SELECT * FROM judged WHERE outcome = 'applied' AND reflection <> ''), aft AS (SELECT e.*, CASE WHEN f.scope_key IS NOT NULL AND CAST(string_split(entry_id, ':')[2] AS BIGINT) < 2 THEN 'reflection:' || f.scope_key || ':' || event_id END AS by_ FROM ent e LEFT JOIN full_ f USING (scope_key))"""


def _cas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = _msgs(spark, sf_dir)
    key = F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("scope_key")
    entries = m.select(key, F.col("id").alias("entry_id"), "text", F.lit("medium").alias("priority"), F.lit("chunk").alias("origin"), F.lit(None).cast("string").alias("superseded_by"), "created_at")
    covers = m.groupBy("session_id").agg(F.collect_list(F.when(F.col("turn") < 2, F.concat(F.lit(" "), "id"))).alias("covers"))
    text = F.when(F.col("session_id") % 11 == 3, " ").otherwise(F.concat(F.lit(" merged "), F.col("session_id").cast("string")))
    req = covers.select(key, (F.col("session_id") % 7).alias("event_id"), (F.col("session_id") % 2).alias("expected_generation"), text.alias("reflection"), "covers")
    return Z.apply_reflections(_records(spark, sf_dir), entries, req)


@query(f"WITH {_CAS_SQL} SELECT scope_key, event_id, outcome FROM judged")
def q_reflection_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each reflection: applied, idempotent or stale."""
    return _cas(spark, sf_dir)[2]


@query(f"""WITH {_CAS_SQL}, rest AS (SELECT scope_key, string_agg(text, chr(10) || chr(10) ORDER BY created_at DESC, entry_id) AS t FROM aft WHERE by_ IS NULL AND trim(text, ' ') <> '' GROUP BY scope_key),
n AS (SELECT rec.*, j.event_id, j.outcome = 'applied' AS hit, concat_ws(chr(10) || chr(10), nullif(j.reflection, ''), t) AS merged FROM rec LEFT JOIN judged j USING (scope_key) LEFT JOIN rest USING (scope_key))
SELECT scope_key, CASE WHEN hit THEN generation + 1 ELSE generation END AS generation, CASE WHEN hit THEN event_id ELSE last_event END AS last_event, CASE WHEN hit THEN merged ELSE '' END AS active_observations, CASE WHEN hit THEN CAST(ceil(length(merged) / 4.0) AS BIGINT) ELSE 0 END AS observation_tokens, NOT hit AS is_buffering, CASE WHEN NOT hit THEN buffered_reflection END AS buffered_reflection FROM n""")
def q_reflection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records after reflections with compare-and-set."""
    return _cas(spark, sf_dir)[0].select("scope_key", "generation", "last_event", "active_observations", "observation_tokens", "is_buffering", "buffered_reflection")


@query(f"WITH {_CAS_SQL} SELECT scope_key, entry_id, text, 'medium' AS priority, 'chunk' AS origin, by_ AS superseded_by FROM aft UNION ALL SELECT scope_key, 'reflection:' || scope_key || ':' || event_id, reflection, 'high', 'reflection', NULL FROM full_")
def q_reflection_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries after reflections: covered ones superseded, one new each."""
    return _cas(spark, sf_dir)[1].select("scope_key", "entry_id", "text", "priority", "origin", "superseded_by")


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '" + w.replace("'", "''") + "')" for w in words) + ")"


_Q = "(contains(low, '?') OR contains(t, '？')) AND (" + " OR ".join(f"starts_with(low, '{w}')" for w in G.QUESTION_STARTS) + f" OR {_any('low', G.QUESTION_CUES)})"
_SIGNAL_SQL = f"""sig AS (SELECT session_id, id, turn, role, text, t, low, ({_Q}) OR starts_with(low, 'please ') OR len(list_intersect(list_transform(string_split(low, ' '), lambda x: regexp_replace(x, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), [{", ".join(f"'{w}'" for w in G.TASK_VERBS)}])) > 0
 OR CASE WHEN regexp_matches(t, '[\\x{{AC00}}-\\x{{D7A3}}\\x{{1100}}-\\x{{11FF}}\\x{{3130}}-\\x{{318F}}]') THEN {_any('t', G.TASK_KOREAN)} WHEN regexp_matches(t, '[\\x{{3040}}-\\x{{30FF}}]') THEN {_any('t', G.TASK_JAPANESE)} WHEN regexp_matches(t, '[\\x{{4E00}}-\\x{{9FFF}}]') THEN {_any('t', G.TASK_CHINESE)} ELSE false END AS task,
 {_any('lower(text)', G.ERROR_WORDS)} AS err FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS low FROM talk))"""
#: What the made-up messages ask and tell, by turn: the tables hold no such sentences.
TALK = ["Please fix the build. ", "It failed with E1234 in module_x. ", "How does this work? ", "Done. ", "빌드 오류를 수정 해주세요. ", "timeout at api/v1 again. "]
TALK_SQL = MSG_SQL.replace("msgs AS", "talk AS").replace(" role, text,", " role, " + f"list_value({', '.join(repr(s) for s in TALK)})[(turn + conv_id) % {len(TALK)} + 1] || text AS text,")


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.get(F.array(*[F.lit(s) for s in TALK]), ((F.col("turn") + F.col("session_id")) % len(TALK)).cast("int"))
    return _msgs(spark, sf_dir).withColumn("text", F.concat(lead, "text"))


@query(rf"""WITH {TALK_SQL}, {_SIGNAL_SQL} SELECT id, task, err AS error, CASE WHEN task THEN substr(t, 1, 140) END AS phrase,
 coalesce(list_filter(regexp_extract_all(text, '[A-Za-z0-9_:/.-]+'), lambda x: regexp_matches(x, '^E[0-9]{{2,}}$'))[1], list_filter(regexp_extract_all(text, '[A-Za-z0-9_:/.-]+'), lambda x: regexp_matches(x, '[_/:]'))[1], list_filter(regexp_extract_all(text, '[A-Za-z0-9_:/.-]+'), lambda x: starts_with(x, 'ERR'))[1]) AS identifier FROM sig""")
def q_message_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task and error signals, the task's phrase and the error's name, of every message."""
    t = F.col("text")
    return _talk(spark, sf_dir).select("id", G.task_signal(T.collapse(t)).alias("task"), G.error_signal(t).alias("error"), G.task_phrase(t).alias("phrase"), G.error_identifier(t).alias("identifier"))


def _reply_sql() -> str:
    out = "CASE prof"
    for name, (plain, named, unnamed) in G.REPLIES.items():
        head, tail = named.split("%s")
        out += f" WHEN '{name}' THEN CASE WHEN error IS NULL THEN '{plain}' WHEN ident IS NOT NULL THEN '{head}' || ident || '{tail}' ELSE '{unnamed}' END"
    return out + " END || last_task"


@query(rf"""WITH {TALK_SQL}, {_SIGNAL_SQL}, l AS (SELECT *, '[' || role || '] ' || t AS line FROM sig), f AS (SELECT l.*, row_number() OVER (PARTITION BY session_id, line ORDER BY turn, id) AS again, line IN (SELECT line FROM l k WHERE k.session_id = l.session_id AND k.turn = 0) AS known FROM l),
g AS (SELECT session_id, string_agg(line, chr(10) ORDER BY turn, id) FILTER (again = 1 AND NOT known AND t <> '') AS new, min_by(line, (turn, id)) FILTER (t <> '') AS first_line, max_by(CASE WHEN task THEN substr(t, 1, 140) ELSE '' END, (turn, id)) FILTER (role = 'user') AS lt, max_by(substr(t, 1, 140), (turn, id)) FILTER (role = 'user' AND task) AS signal, max_by(id, (turn, id)) FILTER (role = 'user' AND task) AS signal_id,
 max_by(text, (turn, id)) FILTER (role = 'assistant' AND err) AS error, max_by(id, (turn, id)) FILTER (role = 'assistant' AND err) AS error_id, max_by(id, (turn, id)) FILTER (t <> '') AS line_id, max_by(text, (turn, id)) FILTER (role = 'user') AS last_user FROM f GROUP BY session_id),
h AS (SELECT *, nullif(lt, '') AS last_task, substr(coalesce(new, first_line), 1, 900) AS obs, CASE WHEN signal IS NULL THEN 0 WHEN contains(signal, '?') THEN 600 ELSE 820 END AS base, coalesce(list_filter(regexp_extract_all(error, '[A-Za-z0-9_:/.-]+'), lambda x: regexp_matches(x, '^E[0-9]{{2,}}$'))[1], list_filter(regexp_extract_all(error, '[A-Za-z0-9_:/.-]+'), lambda x: regexp_matches(x, '[_/:]'))[1]) AS ident FROM g),
c AS (SELECT *, least(greatest(base + CASE WHEN error IS NOT NULL AND base > 0 THEN 120 ELSE 0 END, CASE WHEN trim(obs, ' ') <> '' THEN 320 ELSE 0 END), 1000) AS sure, CASE WHEN regexp_matches(coalesce(last_task, last_user, ''), '[\x{{AC00}}-\x{{D7A3}}]') THEN 'hangul' ELSE 'other' END AS prof FROM h)
SELECT session_id, obs AS observations, CAST(ceil(length(obs) / 4.0) AS BIGINT) AS tokens, CAST(sure AS INTEGER) AS confidence, CASE WHEN sure >= 500 THEN last_task END AS current_task, CASE WHEN sure >= 700 THEN substr({_reply_sql()}, 1, 180) END AS suggested_response, concat_ws(',', 'task:' || signal_id, 'error:' || error_id, 'line:' || line_id) AS evidence FROM c""")
def q_observer_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic observer response of every session; lines of the first turn are active already."""
    m = _talk(spark, sf_dir)
    active = m.where("turn = 0").select("session_id", F.concat(F.lit("["), "role", F.lit("] "), T.collapse(F.col("text"))).alias("line"))
    return Z.respond(m, active, 900, "auto").drop("source")


@query(rf"""WITH {MSG_SQL}, a AS (SELECT session_id, string_agg(text, chr(10) ORDER BY turn, id) AS o FROM msgs GROUP BY session_id), l AS (SELECT session_id, list_filter(list_transform(string_split(replace(o, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS rows FROM a), t AS (SELECT *, trim(regexp_replace(array_to_string(rows, ' '), '\s+', ' ', 'g')) AS t FROM l WHERE len(rows) > 0)
SELECT session_id, substr(t, 1, 300) AS reflection, CAST(ceil(least(length(t), 300) / 4.0) AS BIGINT) AS tokens, array_to_string(rows, chr(10)) AS covered, CAST(ceil(length(t) / 4.0) AS BIGINT) AS input_tokens FROM t""")
def q_reflection_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draft of a reflection on each session's lines."""
    a = _msgs(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id", "text"))), lambda x: x["text"]), "\n").alias("o"))
    return a.select("session_id", Z.reflection_draft(F.col("o"), 300).alias("d")).where("d is not null").select("session_id", "d.*")


@query(f"""WITH {MSG_SQL}, a AS (SELECT session_id, list('m' || turn ORDER BY turn) AS rows FROM msgs GROUP BY session_id) SELECT session_id, CASE WHEN session_id % 3 = 0 THEN array_to_string(rows, chr(10)) WHEN session_id % 3 = 1 THEN CASE WHEN len(rows) > 1 THEN 'short' || chr(10) || chr(10) || array_to_string(rows[2:], chr(10)) ELSE 'short' END ELSE 'short' || chr(10) || chr(10) || array_to_string(rows, chr(10)) END AS merged FROM a""")
def q_reflection_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffered reflections before the lines that they don't cover: none buffered, one line covered, another line first."""
    a = _msgs(spark, sf_dir).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.concat(F.lit("m"), x.cast("string"))).alias("rows"))
    third = F.col("session_id") % 3
    return a.select("session_id", Z.merge_reflection(F.col("rows"), F.when(third == 2, "other").otherwise("m0"), F.when(third == 0, " ").otherwise(" short ")).alias("merged"))


@query(f"""WITH {MSG_SQL}, a AS (SELECT session_id, list('line ' || turn ORDER BY turn) AS rows, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tok FROM msgs GROUP BY session_id), r AS (SELECT *, CAST(tok AS DOUBLE) / len(rows) AS rate FROM a), n AS (SELECT *, CASE WHEN rate > 0 THEN least(floor(200 * 0.5 / rate), len(rows)) ELSE len(rows) END AS n FROM r)
SELECT session_id, array_to_string(rows[1:CAST(n AS BIGINT)], chr(10)) AS lines, CAST(floor(rate * n + 0.5) AS BIGINT) AS tokens, CAST(ceil(least(floor(rate * n + 0.5) * 0.5, 200)) AS BIGINT) AS target FROM n""")
def q_reflection_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each session that a buffered reflection takes, and what it has to shrink them to."""
    rows = F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.concat(F.lit("line "), x.cast("string")))
    a = _msgs(spark, sf_dir).groupBy("session_id").agg(F.array_join(rows, "\n").alias("o"), F.sum(T.estimate_tokens(F.col("text"))).alias("tok"))
    return a.select("session_id", Z.reflection_slice(F.col("o"), F.col("tok"), 200, 0.5).alias("s")).select("session_id", "s.*")


_PAYLOADS = ['{"schema_version": 1, "scope_key": "s", "requested_at": "2024-01-01T00:00:00Z"}', '{"schema_version": 2, "scope_key": " ", "requested_at": "2024-01-01T00:00:00+02:00"}', '{"schema_version": 1, "scope_key": "s", "requested_at": "soon"}', "no json", '{"scope_key": "s"}', "[1]"]
_FAULTS = [[], ["schema_version", "scope_key"], ["requested_at"], ["schema", "schema_version", "scope_key", "requested_at"], ["schema_version", "requested_at"], ["schema", "schema_version", "scope_key", "requested_at"]]


@query("WITH " + OUTBOX_SQL + ", f AS (SELECT id, event_type, [" + ", ".join("[" + ", ".join(f"'{x}'" for x in f) + "]::VARCHAR[]" for f in _FAULTS) + "][id % 6 + 1] AS faults FROM outbox) SELECT id, CASE WHEN event_type IN ('om_observe_buffer_requested', 'om_reflect_requested', 'om_reflect_buffer_requested') THEN faults ELSE [] END AS faults FROM f")
def q_payload_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each memory event's payload."""
    body = F.get(F.array(*[F.lit(p) for p in _PAYLOADS]), (F.col("id") % 6).cast("int"))
    return _outbox(spark, sf_dir).select("id", Z.payload_faults(F.col("event_type"), body).alias("faults"))


@query(f"""WITH {OUTBOX_SQL}, r AS (SELECT * EXCLUDE (status), CASE WHEN status = 'processing' AND created_at <= TIMESTAMP '2024-02-01' - INTERVAL 300 SECOND THEN 'new' ELSE status END AS status FROM outbox), n AS (SELECT * FROM r WHERE status = 'new' AND next_attempt_at <= TIMESTAMP '2024-02-01' ORDER BY id LIMIT 400), o AS (SELECT * FROM n WHERE starts_with(event_type, 'om_') ORDER BY id LIMIT 100)
SELECT id, event_type, attempt + 1 AS attempt, CASE WHEN id % 3 = 0 AND attempt + 1 < 6 THEN 'requeued' WHEN id % 3 = 0 THEN 'dead_letter' ELSE 'done' END AS outcome FROM o""")
def q_replay_om(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay of memory events alone: limit, filter, limit."""
    return Z.replay_om(_outbox(spark, sf_dir), "2024-02-01 00:00:00", 100, F.col("id") % 3 == 0)


@query(f"""WITH {MSG_SQL}, ses AS (SELECT session_id % 5 AS scope_key, session_id, max(created_at) AS updated_at, session_id < 5 AS own FROM msgs GROUP BY session_id), near AS (SELECT scope_key, session_id FROM (SELECT *, row_number() OVER (PARTITION BY scope_key, own ORDER BY updated_at DESC, session_id) AS place FROM ses) WHERE own OR place <= 2),
f AS (SELECT scope_key, m.*, scope_key % 2 = 0 OR created_at > TIMESTAMP '2024-01-01 00:02:00' + CASE WHEN scope_key = 3 THEN INTERVAL 9 DAY ELSE INTERVAL 0 DAY END AS behind FROM msgs m JOIN near USING (session_id)), p AS (SELECT * FROM (SELECT *, bool_or(behind) OVER (PARTITION BY scope_key) AS found FROM f) WHERE (behind OR NOT found) AND turn % 4 <> 1)
SELECT scope_key, session_id, id FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY created_at DESC, session_id DESC, id DESC) AS n FROM p) WHERE n <= 6""")
def q_scope_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each scope's observer looks at: own and peer sessions, behind the cursor, unobserved, the last ones."""
    m = _msgs(spark, sf_dir)
    k = F.col("session_id")
    sessions = m.groupBy("session_id").agg(F.max("created_at").alias("updated_at")).select((k % 5).alias("scope_key"), "session_id", "updated_at", (k < 5).alias("own"))
    at = F.when(F.col("scope_key") == 3, F.lit("2024-01-10 00:02:00").cast("timestamp_ntz")).when(F.col("scope_key") % 2 == 1, F.lit("2024-01-01 00:02:00").cast("timestamp_ntz"))
    cursors = sessions.select("scope_key").distinct().select("scope_key", at.alias("cursor"))
    return Z.scope_messages(m, sessions, cursors, m.where("turn % 4 = 1"), 2, 6, strict=False).select("scope_key", "session_id", "id")


@query(f"""WITH {MSG_SQL}, t AS (SELECT session_id % 9 AS scope_key, session_id AS thread_id, max(CASE WHEN turn = 0 AND session_id % 2 = 0 THEN id END) AS task, max(CASE WHEN turn = 1 AND session_id % 3 = 0 THEN id END) AS reply FROM msgs GROUP BY session_id), p AS (SELECT scope_key, min(thread_id) AS thread_id FROM t GROUP BY scope_key),
j AS (SELECT t.scope_key, t.thread_id, coalesce(task, CASE WHEN p.thread_id IS NOT NULL THEN 'primary' END) AS current_task, coalesce(reply, CASE WHEN p.thread_id IS NOT NULL THEN 'answer' END) AS suggested_response FROM t LEFT JOIN p ON p.scope_key = t.scope_key AND p.thread_id = t.thread_id)
SELECT *, CASE WHEN current_task IS NOT NULL AND suggested_response IS NOT NULL THEN 0.92 ELSE 0.82 END::DOUBLE AS confidence FROM j WHERE current_task IS NOT NULL OR suggested_response IS NOT NULL""")
def q_thread_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuations of a scope's threads; the response's hints fill the primary thread's gaps."""
    k = F.col("session_id")
    t = _msgs(spark, sf_dir).groupBy((k % 9).alias("scope_key"), k.alias("thread_id")).agg(F.max(F.when((F.col("turn") == 0) & (k % 2 == 0), F.col("id"))).alias("current_task"), F.max(F.when((F.col("turn") == 1) & (k % 3 == 0), F.col("id"))).alias("suggested_response"))
    primary = t.groupBy("scope_key").agg(F.min("thread_id").alias("thread_id")).select("scope_key", "thread_id", F.lit("primary").alias("current_task"), F.lit(" answer ").alias("suggested_response"))
    return Z.thread_continuations(t, primary)


@query(f"""WITH {MSG_SQL}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS n FROM msgs WHERE turn % 3 <> 0) WHERE n <= 4), l AS (SELECT *, '[' || role || '] ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY session_id, line ORDER BY turn, id) AS again FROM l),
g AS (SELECT session_id, substr(string_agg(line, chr(10) ORDER BY turn, id) FILTER (again = 1), 1, 500) AS observations, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS message_tokens, max_by(id, (created_at, id)) AS anchor, list_sort(list(DISTINCT id)) AS message_ids, max(created_at) AS newest FROM f GROUP BY session_id)
SELECT session_id, CAST(session_id % 3 + 1 AS BIGINT) AS seq, observations, CAST(ceil(length(observations) / 4.0) AS BIGINT) AS tokens, message_tokens, anchor, message_ids, greatest(newest, CASE WHEN session_id % 2 = 0 THEN TIMESTAMP '2024-01-01 00:03:00' END) AS cursor FROM g""")
def q_observer_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observer pass over all sessions: candidates, response, chunk and cursor."""
    m = _msgs(spark, sf_dir)
    k = F.col("session_id")
    records = m.select("session_id").distinct().select("session_id", (k % 3).alias("last_seq"), F.when(k % 2 == 0, F.lit("2024-01-01 00:03:00").cast("timestamp_ntz")).alias("cursor"))
    nothing = m.select("session_id", F.lit("").alias("line")).limit(0)
    return Z.observer_pass(m, m.where("turn % 3 = 0"), nothing, records, 4, 500).select("session_id", F.col("seq").cast("long").alias("seq"), "observations", "tokens", "message_tokens", "anchor", "message_ids", "cursor")


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'idempotent_event' WHEN event_id % 3 <> user_id % 3 OR user_id % 4 = 0 THEN 'stale_generation' ELSE 'run' END AS outcome FROM events")
def q_observer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to observe: run once, for the present generation."""
    e = table(spark, sf_dir, "events")
    asked = e.select("event_id", F.col("user_id").alias("scope_key"), (F.col("event_id") % 3).alias("expected_generation"))
    records = e.where("user_id % 4 <> 0").select(F.col("user_id").alias("scope_key"), (F.col("user_id") % 3).alias("generation")).distinct()
    return Z.observer_requests(asked, e.where("event_id % 10 = 0").select("event_id"), records).select("event_id", "outcome")


@query("SELECT 'om_observer_failed' AS event_type, 'ctx://session/' || user_id AS uri, CAST(to_json({'session_id': user_id, 'error_code': 'E' || event_id, 'error': event_type, 'om_failure_kind': 'schema', 'om_failure_source': 'observer'}) AS VARCHAR) AS payload_json, 'dead_letter' AS status FROM events WHERE event_type = 'error'")
def q_observer_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed observers as dead letters."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    rows = e.select(F.col("user_id").alias("session_id"), F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("error_code"), F.col("event_type").alias("error"), F.lit("schema").alias("kind"), F.lit("observer").alias("source"), F.col("ts").alias("created_at"))
    return Z.failures(rows).select("event_type", "uri", "payload_json", "status")


@query(f"WITH {MSG_SQL}, k AS (SELECT DISTINCT 's' || session_id AS scope_key, session_id % 3 AS g FROM msgs) SELECT 'om_reflect_requested' AS event_type, 'ctx://agent/om/' || scope_key AS uri, CAST(to_json({{'schema_version': 1, 'scope_key': scope_key, 'expected_generation': g, 'requested_at': '2024-02-01T00:00:00Z'}}) AS VARCHAR) AS payload_json, 'new' AS status, 0 AS attempt, 'semantic' AS lane FROM k")
def q_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for reflections as outbox rows."""
    k = _msgs(spark, sf_dir).select(F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("scope_key"), (F.col("session_id") % 3).alias("expected_generation")).distinct()
    return Z.event_rows(k, "om_reflect_requested", "2024-02-01 00:00:00").select("event_type", "uri", "payload_json", "status", "attempt", "lane")


@query(f"WITH {MSG_SQL}, r AS (SELECT 's' || session_id AS k, string_agg('m' || turn || CASE WHEN turn % 2 = 0 THEN chr(10) ELSE '' END, chr(10) ORDER BY turn, id) AS o FROM msgs GROUP BY session_id), l AS (SELECT k, unnest(string_split(o, chr(10))) AS text, generate_subscripts(string_split(o, chr(10)), 1) - 1 AS n FROM r) SELECT k AS scope_key, 'migrated:' || k || ':' || n AS entry_id, text FROM l WHERE trim(text, ' ') <> ''")
def q_om_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old records' lines as entries; the second run adds none."""
    line = F.concat(F.lit("m"), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, "\n").otherwise(""))
    m = _msgs(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id", line.alias("l")))), lambda x: x["l"]), "\n").alias("active_observations"), F.max("created_at").alias("updated_at"))
    records = m.select(F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("scope_key"), "active_observations", "updated_at")
    none = records.select("scope_key", F.lit("").alias("entry_id"), F.lit("").alias("text"), F.lit("").alias("priority"), F.lit("").alias("origin"), F.lit(None).cast("string").alias("superseded_by"), F.col("updated_at").alias("created_at")).limit(0)
    once, _ = Z.migrate(none, records, apply=True)
    return Z.migrate(once, records, apply=True)[0].select("scope_key", "entry_id", "text")


#: Options of a configuration as expressions over parts, the same text in SQL; null where a part leaves one out.
_OPTIONS = {
    "scope": "CASE WHEN p_size % 7 = 0 THEN 'resource' ELSE 'session' END", "share_token_budget": "p_size % 11 = 0", "message_tokens": "CASE WHEN p_size % 3 = 0 THEN p_size * 10 - 30 END", "observation_tokens": "CASE WHEN p_size % 13 = 0 THEN p_size - 13 END",
    "max_tokens_per_batch": "CASE WHEN p_size % 17 = 0 THEN p_size - 17 END", "buffer_tokens": "CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 400 AS INTEGER) - 20 END", "buffer_ratio": "CASE WHEN p_partkey % 5 = 1 THEN CAST(p_size / 40.0 AS DOUBLE) END", "buffer_off": "p_partkey % 19 = 0",
    "buffer_activation": "CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size / 45.0 AS DOUBLE) END", "block_after": "CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size / 25.0 + 0.5 AS DOUBLE) WHEN p_partkey % 4 = 2 THEN CAST(p_size * 900 AS DOUBLE) END",
    "reflection_activation": "CASE WHEN p_partkey % 9 = 0 THEN CAST(p_size / 48.0 AS DOUBLE) END", "reflection_block_after": "CASE WHEN p_partkey % 8 = 3 THEN CAST(p_size * 1000 AS DOUBLE) END",
}
_OPT_SQL = f"""opt AS (SELECT p_partkey, {", ".join(f"{e} AS {c}" for c, e in _OPTIONS.items())} FROM part),
r1 AS (SELECT *, coalesce(message_tokens, 30000) AS base, coalesce(observation_tokens, 40000) AS refl, buffer_off OR (scope = 'resource' AND coalesce(buffer_tokens, buffer_ratio, buffer_activation, block_after, reflection_activation, reflection_block_after) IS NULL) AS off, CASE WHEN buffer_tokens IS NULL THEN coalesce(buffer_ratio, 0.2::DOUBLE) END AS ratio, coalesce(block_after, 1.2::DOUBLE) AS ba, coalesce(reflection_block_after, 1.2::DOUBLE) AS ra FROM opt),
r2 AS (SELECT *, coalesce(CAST(floor(base * ratio + 0.5) AS INTEGER), buffer_tokens) AS tok, CASE WHEN ba >= 1 THEN CAST(floor(CASE WHEN ba < 2 THEN base * ba ELSE ba END + 0.5) AS INTEGER) END AS b1, CASE WHEN ra >= 1 THEN CAST(floor(CASE WHEN ra < 2 THEN refl * ra ELSE ra END + 0.5) AS INTEGER) END AS b2 FROM r1),
res AS (SELECT *, CASE WHEN base <= 0 THEN 'message_tokens' WHEN refl <= 0 THEN 'observation_tokens' WHEN scope = 'resource' AND NOT off THEN 'resource_scope_async' WHEN share_token_budget AND NOT off THEN 'share_token_budget_async' WHEN coalesce(max_tokens_per_batch, 10000) <= 0 THEN 'max_tokens_per_batch' WHEN off THEN NULL
 WHEN ratio <= 0 OR ratio >= 1 THEN 'buffer_tokens_ratio' WHEN tok <= 0 THEN 'buffer_tokens_absolute' WHEN tok >= base THEN 'buffer_tokens_at_threshold' WHEN b1 IS NULL OR b1 < base THEN 'observation_block_after' WHEN b2 IS NULL OR b2 < refl THEN 'reflection_block_after'
 WHEN buffer_activation <= 0 OR buffer_activation > 1 THEN 'observation_activation' WHEN reflection_activation <= 0 OR reflection_activation > 1 THEN 'reflection_activation' END AS error FROM r2)"""


@query(f"WITH {_OPT_SQL} SELECT p_partkey, error, CASE WHEN error IS NULL THEN base END AS threshold, CASE WHEN error IS NULL AND NOT off THEN tok END AS buffer, CASE WHEN error IS NULL AND NOT off THEN b1 END AS block, CASE WHEN error IS NULL AND NOT off THEN b2 END AS reflection_block FROM res")
def q_om_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration for every part, resolved, or the rule that it breaks."""
    options = table(spark, sf_dir, "part").selectExpr("p_partkey", *[f"{e} AS {c}" for c, e in _OPTIONS.items()])
    return Z.resolve_columns(options).select("p_partkey", "error", "threshold", "buffer", "block", "reflection_block")


_STEP_TOKENS, _STEP_BUFFER, _STEP_BLOCK = 400, 80, 480


@query(f"""WITH {MSG_SQL}, r AS (SELECT session_id, id, turn, CAST(sum(ceil(length(text) / 4.0)) OVER (PARTITION BY session_id ORDER BY turn, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pending FROM msgs), l AS (SELECT *, coalesce(lag(pending) OVER (PARTITION BY session_id ORDER BY turn, id), 0) AS last, session_id % 5 = 0 AS ro, turn % 2 = 0 AS ini, session_id % 3 > 0 AS has FROM r)
SELECT id, pending, NOT ro AND pending >= {_STEP_TOKENS} AND pending >= {_STEP_BLOCK} AS observe, NOT ro AND pending // {_STEP_BUFFER} > last // {_STEP_BUFFER} AND pending < {_STEP_TOKENS} AS buffer, NOT ro AND ini AND has AND pending >= {_STEP_TOKENS} AS activate FROM l""")
def q_process_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is done with every message, by its session's tokens so far and by options."""
    w = Window.partitionBy("session_id").orderBy("turn", "id")
    run = _msgs(spark, sf_dir).withColumn("pending", F.sum(T.estimate_tokens(F.col("text"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = run.withColumn("last", F.coalesce(F.lag("pending").over(w), F.lit(0)))
    does = Z.step_columns(F.col("pending"), F.col("last"), F.lit(_STEP_TOKENS), F.lit(_STEP_BUFFER), F.lit(_STEP_BLOCK), F.col("turn") % 2 == 0, F.col("session_id") % 5 == 0, F.col("session_id") % 3 > 0)
    return last.select("id", "pending", *[c.alias(n) for n, c in does.items()])


_REPLIES = [
    '{"memories": [{"category": "Persona", "text": " Kim  is here ", "source_message_id": "%s", "confidence": 0.9}, {"category": "rules", "memory": "always test", "confidence": 300}]}', '{"result": [{"category": "weird", "content": "odd one", "source_message_ids": ["%s", "nobody"]}, {"text": "no category"}]}',
    '{"data": {"memories": [{"category": "events", "text": "deployed", "source_ids": ["nobody"]}, {"category": "events", "text": " ", "confidence": 1}]}}', "no json", '[{"category": "cases", "text": "fixed", "confidence": "x"}, {"category": "cases", "text": "fixed", "confidence": 0.2}]',
]


@query(f"""WITH {MSG_SQL}, r AS (SELECT id, (turn + session_id) % 5 AS k FROM msgs) SELECT id AS reply_id, 'profile' AS category, 'Kim is here' AS text, [id] AS sources, 900 AS confidence FROM r WHERE k = 0 UNION ALL SELECT id, 'patterns', 'always test', ['fallback'], 300 FROM r WHERE k = 0
UNION ALL SELECT id, 'patterns', 'odd one', [id], 700 FROM r WHERE k = 1 UNION ALL SELECT id, 'cases', 'fixed', ['fallback'], 700 FROM r WHERE k = 4""")
def q_parse_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories from models' replies in several shapes; unknown sources don't count."""
    m = _msgs(spark, sf_dir)
    body = F.get(F.array(*[F.lit(r) for r in _REPLIES]), ((F.col("turn") + F.col("session_id")) % 5).cast("int"))
    replies = m.select(F.col("id").alias("reply_id"), F.replace(body, F.lit("%s"), F.col("id")).alias("body"))
    return M.parse_memories(replies, m.select("id"), m.select(F.col("id").alias("reply_id"), F.lit("fallback").alias("id")))


_CKPT = """ck AS (SELECT user_id AS session_id, event_id AS checkpoint_id, 'h' || event_id % 4 AS request_hash, ['pending', 'applying', 'applied'][event_id % 3 + 1] AS phase, 1 AS attempts, TIMESTAMP '2024-02-01' - to_seconds(event_id % 2 * 100 + 10) AS updated_at FROM events WHERE event_id % 5 <> 0),
j AS (SELECT e.user_id AS session_id, e.event_id AS checkpoint_id, 'h' || e.event_id % 3 AS new_hash, ck.request_hash, attempts, CASE WHEN phase = 'applying' AND updated_at <= TIMESTAMP '2024-02-01' - INTERVAL 60 SECOND THEN 'pending' ELSE phase END AS phase FROM events e LEFT JOIN ck ON ck.checkpoint_id = e.event_id),
o AS (SELECT *, CASE WHEN checkpoint_id % 7 = 0 THEN NULL WHEN phase IS NULL THEN 'claimed' WHEN request_hash <> new_hash THEN 'conflict' WHEN phase = 'applied' THEN 'replayed' WHEN phase = 'applying' THEN 'busy' ELSE 'claimed' END AS outcome FROM j)"""


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    h = lambda n: F.concat(F.lit("h"), (k % n).cast("string")).alias("request_hash")
    at = F.lit("2024-02-01").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 2 * 100 + 10).cast("decimal(18,6)"))
    ck = e.where("event_id % 5 <> 0").select(F.col("user_id").alias("session_id"), k.alias("checkpoint_id"), h(4), F.get(F.array(F.lit("pending"), F.lit("applying"), F.lit("applied")), (k % 3).cast("int")).alias("phase"), F.lit(1).alias("attempts"), at.alias("updated_at"))
    return M.claim_checkpoints(ck, e.where("event_id % 7 <> 0").select(F.col("user_id").alias("session_id"), k.alias("checkpoint_id"), h(3)), "2024-02-01 00:00:00")


@query(f"WITH {_CKPT} SELECT session_id, checkpoint_id, outcome FROM o WHERE outcome IS NOT NULL")
def q_claim_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of promotion requests: claimed, replayed, busy or a conflict."""
    return _claims(spark, sf_dir)[1]


@query(f"WITH {_CKPT} SELECT session_id, checkpoint_id, CASE WHEN outcome = 'claimed' THEN CASE WHEN checkpoint_id % 2 = 0 THEN 'applied' ELSE 'pending' END WHEN phase = 'applying' THEN CASE WHEN checkpoint_id % 2 = 0 THEN 'applied' ELSE 'pending' END ELSE phase END AS phase, CAST(coalesce(attempts, 0) + CASE WHEN outcome = 'claimed' THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM o WHERE phase IS NOT NULL OR outcome IS NOT NULL")
def q_finish_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints after their facts have been applied, or not."""
    after, _ = _claims(spark, sf_dir)
    done = after.select("session_id", "checkpoint_id", (F.col("checkpoint_id") % 2 == 0).alias("ok"))
    return M.finish_checkpoints(after, done, "2024-02-01 00:00:00").select("session_id", "checkpoint_id", "phase", "attempts")


@query(f"WITH {SAID_SQL} SELECT category, count(*) AS memories, CAST(sum(len(sources)) AS BIGINT) AS sources, CAST(min(archive) AS INTEGER) AS first_archive FROM (SELECT category, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, list(DISTINCT id) AS sources, min(CASE WHEN session_id % 2 = 0 THEN 4 ELSE 1 END) AS archive FROM ({_category_sql()}) GROUP BY ALL) GROUP BY category")
def q_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions committed: their messages as the next archive, and the memories in them."""
    m = _said(spark, sf_dir)
    old = m.where("session_id % 2 = 0").select("session_id", F.lit(3).alias("archive")).distinct()
    rows, memories = M.commit(m, old)
    own = memories.select("category", "text", F.explode("sources").alias("id")).join(rows.select("id", "archive"), "id").groupBy("category", "text").agg(F.count("*").alias("n"), F.min("archive").alias("a"))
    return own.groupBy("category").agg(F.count("*").alias("memories"), F.sum("n").alias("sources"), F.min("a").alias("first_archive"))


@query(rf"""WITH {MSG_SQL}, c AS (SELECT *, rtrim(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 40)) AS h FROM msgs), om AS (SELECT session_id, min_by(h, turn) AS om FROM c WHERE session_id % 2 = 0 GROUP BY session_id),
r AS (SELECT * FROM (SELECT c.*, om, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS n FROM c LEFT JOIN om USING (session_id) WHERE om IS NULL OR turn % 2 = 1) WHERE n <= 2), g AS (SELECT s.session_id, om.om, coalesce(rc, []) AS rc FROM (SELECT DISTINCT session_id FROM msgs) s LEFT JOIN om USING (session_id) LEFT JOIN (SELECT session_id, list(h ORDER BY n) AS rc FROM r GROUP BY session_id) USING (session_id)),
l AS (SELECT session_id, CASE WHEN om IS NOT NULL THEN list_concat(rc[1:1], [om], ['one', 'two words'], rc[2:]) ELSE list_concat(['one', 'two words'], rc) END AS line FROM g), d AS (SELECT session_id, list_filter(line, lambda x, i: x <> '' AND list_position(line, x) = i) AS hs FROM l) SELECT session_id, hs[1:4] AS hints FROM d""")
def q_search_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search in each session adds to its query: recent messages, the memory hint, runtime hints."""
    m = _msgs(spark, sf_dir)
    om = m.where("session_id % 2 = 0").groupBy("session_id").agg(F.min_by("text", "turn").alias("hint"))
    return K.resolve_hints(m, m.where("turn % 2 = 0"), om, ["one", " two   words ", "one"], 4, 1, 2, 40)


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN [0.5, 1.0] WHEN event_id % 4 = 1 THEN [CAST(event_id AS FLOAT)] END::FLOAT[] AS vector, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'c' || event_id END AS answer, CASE WHEN event_id % 2 = 0 THEN '{\"a\": [1]}' END AS fragment, CASE WHEN event_id % 2 = 0 THEN CAST(round(value) AS BIGINT) ELSE 0 END AS number FROM events")
def q_model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, answers, fragments and numbers dug out of replies."""
    k, text = F.col("event_id"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    vector = F.when(k % 4 == 0, '{"embedding": [0.5, 1]}').when(k % 4 == 1, text('{"data": [{"embedding": [', k, "]}]}")).when(k % 4 == 2, '{"embedding": []}').otherwise('{"embedding": ["x"]}')
    answer = F.when(k % 3 == 0, text('{"message": {"content": "', F.col("event_type"), '"}}')).when(k % 3 == 1, text('{"choices": [{"message": {"content": "c', k, '"}}]}')).otherwise('{"response": 3}')
    part = F.when(k % 2 == 0, 'so: {"a": [1]} there').otherwise("none")
    number = F.when(k % 2 == 0, F.col("value").cast("string")).otherwise(text("-", k + 1))
    return table(spark, sf_dir, "events").select("event_id", S.embedding_from_json(vector).alias("vector"), S.content_from_json(answer).alias("answer"), S.json_fragment(part).alias("fragment"), S.whole_number(number).alias("number"))


@query(f"WITH {MSG_SQL}, l AS (SELECT id, string_split('- a ' || turn || chr(10) || text || chr(10) || '  2. b' || chr(10) || '* c', chr(10)) AS rows FROM msgs) SELECT id, trim(array_to_string(list_filter(rows, lambda x: regexp_matches(ltrim(x), '^([-*] |[0-9]+\\. )')), chr(10)), ' ') AS items FROM l")
def q_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bullet and numbered lines of texts."""
    text = F.concat(F.lit("- a "), F.col("turn").cast("string"), F.lit("\n"), "text", F.lit("\n  2. b\n* c"))
    return _msgs(spark, sf_dir).select("id", G.list_items(text).alias("items"))
