"""The write path over the conversations, in one pass and as a stream, with a recursive SQL form of its rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import om as Z
from tessera.operators.memory import messages
from tessera.sources.shared import drop_at_exit, shared_dir
from tessera.streaming import writepath as S

from .memory import MSG_SQL, _msgs
from .registry import query, table

CONFIG = Z.resolve(message_tokens=300, buffer_tokens=60, observation_tokens=150)
_FLAT = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_LINE = f"CASE WHEN {_FLAT('x.role')} = '' THEN '' ELSE '[' || {_FLAT('x.role')} || '] ' END || {_FLAT('x.text')}"
_JOIN = "trim(concat_ws(chr(10) || chr(10), nullif({}, ''), nullif({}, '')), chr(10))"


def _over(inner: str, **put: str) -> str:
    """A level over a level: its columns, some of them replaced."""
    return f"SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in put.items())}) FROM ({inner})"


def _with(inner: str, **new: str) -> str:
    return f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in new.items())} FROM ({inner})"


def _observe(rows: str, when: str, pool: str, tag: str) -> str:
    """A pass over the last eight of ``pool`` where ``when`` holds."""
    rows = _with(rows, **{f"pick{tag}": f"CASE WHEN {when} THEN ({pool})[-8:] ELSE [] END"})
    known = "string_split(substr(" + _JOIN.format("active", "array_to_string(list_transform(chunks, lambda c: c.text), chr(10) || chr(10))") + ", 1, 16000), chr(10))"
    rows = _with(rows, **{f"known{tag}": known, f"lines{tag}": f"list_transform(list_filter(pick{tag}, lambda x: {_FLAT('x.text')} <> ''), lambda x: {_LINE})"})
    fresh = f"list_filter(lines{tag}, lambda x, i: list_position(lines{tag}, x) = i AND NOT list_contains(known{tag}, x))"
    rows = _with(rows, **{f"new{tag}": fresh})
    rows = _with(rows, **{f"text{tag}": f"rtrim(substr(array_to_string(CASE WHEN len(new{tag}) > 0 THEN new{tag} ELSE lines{tag}[1:1] END, chr(10)), 1, 4000))", f"mtok{tag}": f"coalesce(list_sum(list_transform(pick{tag}, lambda x: (length(x.text) + 3) // 4)), 0)"})
    rows = _with(rows, **{f"made{tag}": f"text{tag} <> '' AND mtok{tag} > 0"})
    return _over(
        rows, chunks=f"CASE WHEN made{tag} THEN list_append(chunks, {{'text': text{tag}, 'tok': CAST((length(text{tag}) + 3) // 4 AS BIGINT), 'mtok': CAST(mtok{tag} AS BIGINT), 'tm': pick{tag}[-1].tm}}) ELSE chunks END",
        fresh=f"CASE WHEN made{tag} THEN list_filter(fresh, lambda x: NOT list_contains(list_transform(pick{tag}, lambda y: y.id), x.id)) ELSE fresh END", lb=f"CASE WHEN made{tag} THEN p ELSE lb END", bat=f"CASE WHEN made{tag} THEN pick{tag}[-1].tm ELSE bat END",
    )


def _activate(rows: str, when: str, tag: str) -> str:
    """Chunks up to the boundary become active where ``when`` holds and there are any."""
    keep = CONFIG.message_tokens * (1 - 0.800000011920929)  # the ratio has four bytes
    rows = _with(rows, **{f"sums{tag}": "list_transform(chunks, lambda c, i: CAST(list_sum(list_transform(chunks[1:i], lambda d: d.mtok)) AS BIGINT))"})
    rows = _with(rows, **{f"under{tag}": f"list_filter(sums{tag}, lambda x: x <= greatest(p - {keep!r}, 0))"})
    rows = _with(rows, **{f"n{tag}": f"CASE WHEN NOT ({when}) OR len(chunks) = 0 THEN 0 WHEN len(under{tag}) > 0 THEN list_position(sums{tag}, list_max(under{tag})) ELSE 1 END"})
    rows = _with(rows, **{f"left{tag}": f"chunks[n{tag} + 1:]", f"went{tag}": f"chunks[1:n{tag}]", f"ap{tag}": f"CASE WHEN n{tag} > 0 THEN greatest(p - sums{tag}[n{tag}], 0) ELSE p END"})
    did = f"n{tag} > 0"
    return _over(
        rows, active=f"CASE WHEN {did} THEN " + _JOIN.format("active", f"array_to_string(list_transform(went{tag}, lambda c: c.text), chr(10) || chr(10))") + " ELSE active END",
        o=f"CASE WHEN {did} THEN CAST(o + list_sum(list_transform(went{tag}, lambda c: c.tok)) AS BIGINT) ELSE o END", p=f"ap{tag}", cur=f"CASE WHEN {did} THEN went{tag}[-1].tm ELSE cur END",
        lb=f"CASE WHEN NOT ({did}) THEN lb WHEN len(left{tag}) = 0 THEN 0 ELSE least(lb, ap{tag}) END", bat=f"CASE WHEN {did} AND len(left{tag}) = 0 THEN NULL ELSE bat END", chunks=f"CASE WHEN {did} THEN left{tag} ELSE chunks END",
    )


def _steps_sql(cut: str) -> str:
    """A row a message: each round takes the next message of every session, after the requests of the one before it."""
    c = CONFIG
    cursor = "greatest(coalesce(cur, -1), coalesce(bat, -1))"
    rows = f"SELECT s.* EXCLUDE (k, id, tm, activated, asked), m.k, m.id, m.role, m.text, m.tm, CAST(0 AS BIGINT) AS activated, s.asked AS before, CAST(NULL AS VARCHAR) AS asked FROM s JOIN m ON m.session_id = s.session_id AND m.k = s.k + 1"
    rows = _observe(rows, "queued", f"list_filter(fresh, lambda x: x.tm > {cursor})", "_a")
    draft = f"substr({_FLAT('active')}, 1, 1200)"
    rows = _with(rows, waits="refl IS NOT NULL AND refl <> ''")
    rows = _with(rows, next_active=f"CASE WHEN before = 'reflect' AND waits THEN " + _JOIN.format("trim(refl)", "trim(substr(active, covered + 1), chr(10))") + f" WHEN before = 'reflect' THEN trim({draft}) ELSE active END")
    rows = _over(
        rows, refl=f"CASE WHEN before = 'reflect' THEN NULL WHEN before = 'buffer' AND NOT waits THEN {draft} ELSE refl END", covered="CASE WHEN before = 'buffer' AND NOT waits THEN CAST(length(active) AS BIGINT) ELSE covered END",
        o="CASE WHEN before = 'reflect' THEN CAST((length(next_active) + 3) // 4 AS BIGINT) ELSE o END", gen="gen + CASE WHEN before = 'reflect' THEN 1 ELSE 0 END", active="next_active",
    )
    rows = _over(rows, p="p + CAST((length(text) + 3) // 4 AS BIGINT)", fresh="list_append(fresh, {'tm': tm, 'id': id, 'role': role, 'text': text})")
    rows = _over(rows, lb="least(lb, p)")

    def judge(rows: str, tag: str) -> str:
        rows = _with(rows, **{f"rea{tag}": f"p >= {c.message_tokens}", f"blk{tag}": f"p >= {c.observation_block_after}"})
        return _with(rows, **{f"crs{tag}": f"p // {c.buffer_tokens} > lb // {c.buffer_tokens} AND (rea{tag} OR p - lb >= {max(c.buffer_tokens // 2, 1)})"})

    rows = judge(rows, "1")
    rows = _activate(rows, "rea1", "_b")
    rows = judge(rows, "2")
    rows = _with(rows, busy="rea1 OR crs1")
    rows = _over(rows, queued="busy AND crs2 AND NOT blk2", oruns="oruns + CASE WHEN busy AND (crs2 OR (rea2 AND blk2)) THEN 1 ELSE 0 END", lb="CASE WHEN busy AND crs2 AND NOT blk2 THEN p ELSE lb END")
    now = "busy AND NOT queued AND (crs2 OR (rea2 AND blk2))"
    rows = _observe(rows, now, "CASE WHEN cur IS NULL OR tm <= cur THEN fresh ELSE list_filter(fresh, lambda x: x.tm > cur) END", "_c")
    rows = _activate(rows, "busy AND rea2 AND blk2", "_d")
    rows = _with(rows, waits2="refl IS NOT NULL AND refl <> ''")
    over = f"o > {c.observation_tokens}"
    kind = f"CASE WHEN {over} THEN CASE WHEN waits2 OR o >= {c.reflection_block_after} THEN 'reflect' ELSE 'buffer' END WHEN NOT waits2 AND o >= {c.observation_tokens * c.reflection_activation} THEN 'buffer' END"
    rows = _over(rows, asked=kind, activated="n_b + n_d", outcome=f"CASE WHEN NOT busy THEN 'quiet' WHEN queued THEN 'queued' WHEN {now} THEN CASE WHEN made_c THEN 'observed' ELSE 'nothing_new' END ELSE 'waits' END")
    rows = _over(rows, rruns="rruns + CASE WHEN asked IS NOT NULL THEN 1 ELSE 0 END", reached="rea1", crossed="crs1", blocked="blk1")
    state = "session_id, k, id, tm, p, o, lb, gen, oruns, rruns, active, cur, bat, refl, covered, chunks, fresh, queued, activated, asked, outcome, reached, crossed, blocked"
    chunk, message = "STRUCT(text VARCHAR, tok BIGINT, mtok BIGINT, tm BIGINT)[]", "STRUCT(tm BIGINT, id VARCHAR, role VARCHAR, text VARCHAR)[]"
    first = (
        "SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS id, CAST(0 AS BIGINT) AS tm, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS o, CAST(0 AS BIGINT) AS lb, CAST(0 AS BIGINT) AS gen, CAST(0 AS BIGINT) AS oruns, CAST(0 AS BIGINT) AS rruns, "
        f"CAST('' AS VARCHAR) AS active, CAST(NULL AS BIGINT) AS cur, CAST(NULL AS BIGINT) AS bat, CAST(NULL AS VARCHAR) AS refl, CAST(0 AS BIGINT) AS covered, CAST([] AS {chunk}) AS chunks, CAST([] AS {message}) AS fresh, "
        "false AS queued, CAST(0 AS BIGINT) AS activated, CAST(NULL AS VARCHAR) AS asked, CAST('' AS VARCHAR) AS outcome, false AS reached, false AS crossed, false AS blocked FROM m"
    )
    ordered = f"r AS (SELECT DISTINCT session_id, id, coalesce(role, '') AS role, coalesce(text, '') AS text, created_at, CAST(turn AS BIGINT) AS tm FROM msgs WHERE session_id IS NOT NULL AND turn IS NOT NULL{cut}), u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session_id, tm, id ORDER BY role, text) = 1), m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tm, id) AS k FROM u)"
    return (
        f"WITH RECURSIVE {MSG_SQL}, {ordered}, s AS ({first} UNION ALL SELECT {state} FROM ({rows})) SELECT session_id, id, outcome, reached AS threshold_reached, crossed AS interval_triggered, blocked AS block_after_exceeded, CAST(activated AS INTEGER) AS activated, asked AS reflection, CAST(p AS INTEGER) AS pending, "
        "CAST(o AS INTEGER) AS observed, CAST(len(chunks) AS INTEGER) AS chunks, CAST(len(fresh) AS INTEGER) AS unobserved, CAST(gen AS INTEGER) AS generation, CAST(oruns AS INTEGER) AS observer_runs, CAST(rruns AS INTEGER) AS reflector_runs, sha256(active) AS active_sha256 FROM s WHERE k > 0"
    )


def _written(steps: DataFrame) -> DataFrame:
    """The steps of messages; those of requests show in what the next message finds."""
    return steps.where("kind = 'message'").withColumnRenamed("ref", "id").drop("step", "kind", "at")


@query(_steps_sql(""))
def q_write_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every message does to its session's memory."""
    return _written(S.steps(_msgs(spark, sf_dir), CONFIG))


@query(_steps_sql(" AND created_at < (SELECT max(created_at) FROM msgs)"))
def q_stream_write_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream over the conversation files, up to the newest message's time, where the watermark stands in the end."""
    schema = table(spark, sf_dir, "conversations").schema
    base = f"{shared_dir(spark)}/writes-{uuid.uuid4().hex}"
    drop_at_exit(spark, base)
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/conversations.parque[t]")
    with S.state_store(spark):
        steps = S.step_stream(messages(source), CONFIG)
        out = steps.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True)
        out.start().awaitTermination()
    return _written(spark.read.schema(steps.schema).parquet(f"{base}/out"))
