"""Observational memory: compare-and-set writes, reflections, observer responses, event payloads, configuration.

Writes are batch folds: a table of requests meets the keyed state by an equality
join, and every request gets an outcome. A scope's entries make one text by
definition, so what is collected a scope is bounded by that text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import signals as G
from tessera.functions import text as T
from tessera.operators import memory as M

#: Least confidence for a task and for a suggested response. Fixed values.
LEAST_TASK, LEAST_REPLY = 500, 700
SCHEMA_VERSION = 1
EVENT_TYPES = ("om_observe_buffer_requested", "om_reflect_requested", "om_reflect_buffer_requested")


# Compare-and-set writes


def buffer_reflection(records: DataFrame, requests: DataFrame) -> DataFrame:
    """The records after requests to buffer a reflection, with ``outcome``.

    ``requests``: scope_key, expected_generation, reflection, input_tokens. One
    of another generation changes nothing; where a reflection waits already,
    only the flag goes. Records without a request have no outcome.
    """
    asked = requests.select("scope_key", "expected_generation", F.col("reflection").alias("new"), "input_tokens", F.lit(True).alias("asked"))
    both = records.join(asked, "scope_key", "left")
    waits = F.trim(F.coalesce("buffered_reflection", F.lit(""))) != ""
    outcome = F.when(F.col("asked").isNull(), F.lit(None).cast("string")).when(F.col("generation") != F.col("expected_generation"), "stale_generation").when(waits, "already_buffered").otherwise("buffered")
    both = both.withColumn("outcome", outcome)
    done = F.col("outcome") == "buffered"
    new = {
        "is_buffering": F.when(F.col("outcome").isin("buffered", "already_buffered"), False).otherwise(F.col("is_buffering")), "buffered_reflection": F.when(done, F.col("new")).otherwise(F.col("buffered_reflection")),
        "buffered_tokens": F.when(done, T.estimate_tokens(F.col("new"))).otherwise(F.col("buffered_tokens")), "buffered_input_tokens": F.when(done, F.col("input_tokens")).otherwise(F.col("buffered_input_tokens")),
    }
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in records.columns], "outcome")


def clear_flags(records: DataFrame, requests: DataFrame) -> DataFrame:
    """The records with both reflection flags off where a request names their generation."""
    asked = requests.select("scope_key", F.col("expected_generation").alias("g"))
    both = records.join(asked, "scope_key", "left")
    hit = F.coalesce(F.col("g") == F.col("generation"), F.lit(False))
    return both.select(*[F.when(hit, False).otherwise(F.col(c)).alias(c) if c in ("is_reflecting", "is_buffering") else c for c in records.columns])


def apply_reflections(records: DataFrame, entries: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, entries, outcomes) after reflections with compare-and-set.

    ``requests``: scope_key, event_id, expected_generation, reflection, covers;
    one a scope counts, the first by event. It is applied, or refused as
    ``idempotent_event`` (the record's last) or ``stale_generation``. An applied
    one adds an entry of high priority, supersedes the active entries that it
    covers, and the record's text becomes the reflection and the entries that
    stay, newest first; a blank one supersedes nothing and adds none.
    """
    first = requests.groupBy("scope_key").agg(F.min_by(F.struct("event_id", "expected_generation", "reflection", "covers"), "event_id").alias("r")).select("scope_key", "r.*")
    met = first.join(records.select("scope_key", "generation", "last_event"), "scope_key")
    outcome = F.when(F.col("last_event") == F.col("event_id"), "idempotent_event").when(F.col("generation") != F.col("expected_generation"), "stale_generation").otherwise("applied")
    judged = met.select("scope_key", "event_id", F.trim("reflection").alias("reflection"), "covers", outcome.alias("outcome"))
    applied = judged.where("outcome = 'applied'").withColumn("by", F.concat_ws(":", F.lit("reflection"), "scope_key", "event_id"))
    full = applied.where("reflection <> ''")
    cover = full.select("scope_key", "by", F.explode(F.array_distinct(F.filter(F.transform("covers", lambda x: F.trim(x)), lambda x: x != ""))).alias("entry_id"))
    old = entries.join(cover, ["scope_key", "entry_id"], "left").withColumn("superseded_by", F.coalesce("superseded_by", "by")).select(*entries.columns)
    values = {"entry_id": F.col("by"), "text": F.col("reflection"), "priority": F.lit("high"), "origin": F.lit("reflection"), "superseded_by": F.lit(None).cast("string"), "created_at": F.lit(None).cast(entries.schema["created_at"].dataType)}
    new = full.select("scope_key", *[values[c].alias(c) for c in entries.columns if c != "scope_key"]).select(*entries.columns)
    after = old.unionByName(new)
    left = old.where("superseded_by is null").groupBy("scope_key").agg(F.collect_list(F.struct("created_at", "entry_id", "text")).alias("l"))
    newest = lambda a, b: F.when(a["created_at"] > b["created_at"], -1).when(a["created_at"] < b["created_at"], 1).when(a["entry_id"] < b["entry_id"], -1).when(a["entry_id"] > b["entry_id"], 1).otherwise(0)
    rest = F.transform(F.array_sort("l", newest), lambda x: x["text"])
    parts = F.filter(F.concat(F.array("reflection"), F.coalesce(rest, F.array().cast("array<string>"))), lambda x: F.trim(x) != "")
    text = applied.join(left, "scope_key", "left").select("scope_key", F.col("event_id").alias("new_event"), F.array_join(parts, "\n\n").alias("new_text"))
    both = records.join(text, "scope_key", "left")
    hit = F.col("new_event").isNotNull()
    put = {
        "generation": F.when(hit, F.col("generation") + 1).otherwise(F.col("generation")), "last_event": F.when(hit, F.col("new_event")).otherwise(F.col("last_event")),
        "active_observations": F.when(hit, F.col("new_text")).otherwise(F.col("active_observations")), "observation_tokens": F.when(hit, T.estimate_tokens(F.col("new_text"))).otherwise(F.col("observation_tokens")),
        "is_reflecting": F.when(hit, False).otherwise(F.col("is_reflecting")), "is_buffering": F.when(hit, False).otherwise(F.col("is_buffering")),
        "buffered_reflection": F.when(~hit, F.col("buffered_reflection")), "buffered_tokens": F.when(~hit, F.col("buffered_tokens")), "buffered_input_tokens": F.when(~hit, F.col("buffered_input_tokens")),
    }
    return both.select(*[put.get(c, F.col(c)).alias(c) for c in records.columns]), after, judged.select("scope_key", "event_id", "outcome")


# Reflections as text


def reflection_draft(observations: Column, most: int) -> Column:
    """(reflection, tokens, covered lines, tokens of the input) of active observations; null where there are none."""
    rows = F.filter(F.transform(T.lines(observations), lambda x: F.trim(x)), lambda x: x != "")
    text = T.collapse(F.array_join(rows, " "))
    cut = F.substring(text, 1, most)
    out = F.struct(cut.alias("reflection"), T.estimate_tokens(cut).alias("tokens"), F.array_join(rows, "\n").alias("covered"), T.estimate_tokens(text).alias("input_tokens"))
    return F.when((F.size(rows) > 0) & (F.lit(most) > 0), out)


def merge_reflection(active: Column, covered: Column, reflection: Column) -> Column:
    """A buffered reflection followed by the active lines that it doesn't cover; lines are covered from the first on."""
    old = F.filter(F.transform(T.lines(covered), lambda x: F.trim(x)), lambda x: x != "")
    met = F.transform(F.zip_with(active, old, lambda a, c: F.coalesce(F.trim(a) == c, F.lit(False))), lambda x: x)
    wrong = F.array_position(met, False).cast("int")
    at = F.least(F.when(wrong > 0, wrong - 1).otherwise(F.size(met)), F.size(active))
    rest = F.trim(F.array_join(F.slice(active, at + 1, F.greatest(F.size(active) - at, F.lit(0))), "\n"))
    text = F.trim(reflection)
    return F.when(text == "", F.trim(F.array_join(active, "\n"))).when(rest == "", text).otherwise(F.concat(text, F.lit("\n\n"), rest))


def reflection_slice(observations: Column, tokens: Column, threshold: int, activation: float) -> Column:
    """(lines to reflect on, their estimated tokens, tokens to compress to): the lines that hold the activation's share."""
    rows = T.lines(observations)
    rate = tokens / F.size(rows)
    n = F.when(rate > 0, F.least(F.floor(F.lit(threshold * activation) / rate), F.size(rows).cast("long"))).otherwise(F.size(rows).cast("long"))
    share = F.floor(rate * n + 0.5)
    return F.struct(F.array_join(F.slice(rows, F.lit(1), n.cast("int")), "\n").alias("lines"), share.alias("tokens"), F.ceil(F.least(share * activation, F.lit(float(threshold)))).alias("target"))


def compressed(tokens: Column, target: Column) -> Column:
    return tokens < target


# The observer


def observer_response(msgs: DataFrame, active: DataFrame, most: int) -> DataFrame:
    """The deterministic response of each session to its pending messages.

    ``msgs``: session_id, id, turn, role, text; ``active``: session_id, line.
    New lines become the observations; if none is new, the first line stands for
    progress. The task is that of the last user message, and the reply answers
    the latest error first. What is below its least confidence is left out. A
    session's pending messages are one response by definition.
    """
    role, body = F.lower(T.collapse(F.col("role"))), T.collapse(F.col("text"))
    line = F.when(role == "", body).otherwise(F.concat(F.lit("["), T.collapse(F.col("role")), F.lit("] "), body))
    own = msgs.select("session_id", "id", "turn", role.alias("role"), "text", F.when(body != "", line).alias("line"))
    known = active.select("session_id", F.col("line").alias("k"), F.lit(True).alias("known")).distinct()
    order = F.struct("turn", "id")
    user, tool = F.col("role").isin(*G.USER_ROLES), F.col("role").isin(*G.TOOL_ROLES)
    own = own.withColumn("o", order).withColumn("task", F.when(user, G.task_phrase(F.col("text")))).withColumn("err", tool & G.error_signal(F.col("text"))).withColumn("user", user)
    seen = own.join(known, (own["session_id"] == known["session_id"]) & (own["line"] == known["k"]), "left").select(own["*"], "known")
    first = seen.withColumn("again", F.row_number().over(Window.partitionBy("session_id", "line").orderBy("o")))
    fresh = F.col("line").isNotNull() & F.col("known").isNull() & (F.col("again") == 1)
    by = lambda c, test: F.max_by(c, F.when(test, F.col("o")))
    group = first.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(fresh, F.struct("o", "line")))), lambda x: x["line"]).alias("new"), F.min_by("line", F.when(F.col("line").isNotNull(), F.col("o"))).alias("first_line"),
        by("task", F.col("user")).alias("last_task"), by("text", F.col("user")).alias("last_user"), by("task", F.col("task").isNotNull()).alias("signal"), by("id", F.col("task").isNotNull()).alias("signal_id"),
        by("text", F.col("err")).alias("error"), by("id", F.col("err")).alias("error_id"), by("id", F.col("line").isNotNull()).alias("line_id"),
    )
    text = F.substring(F.array_join(F.when(F.size("new") > 0, F.col("new")).otherwise(F.array_compact(F.array("first_line"))), "\n"), 1, most)
    has_error = F.col("error").isNotNull()
    base = F.when(F.col("signal").isNull(), 0).when(F.col("signal").rlike("[?？]"), 600).otherwise(820)
    sure = base + F.when(has_error & (base > 0), 120).otherwise(0)
    sure = F.least(F.greatest(sure, F.when(F.trim(text) != "", 320).otherwise(0)), F.lit(1000))
    script = T.language_profile(F.coalesce("last_task", "last_user", F.lit("")))
    answer = G.reply(script, F.col("last_task"), has_error, G.error_identifier(F.col("error")))
    kind = lambda name, i: F.when(i.isNotNull(), F.concat_ws(":", F.lit(name), i))
    return group.select(
        "session_id", text.alias("observations"), T.estimate_tokens(text).alias("tokens"), sure.alias("confidence"), F.when(sure >= LEAST_TASK, F.col("last_task")).alias("current_task"),
        F.when(sure >= LEAST_REPLY, answer).alias("suggested_response"), F.array_join(F.array_compact(F.array(kind("task", F.col("signal_id")), kind("error", F.col("error_id")), kind("line", F.col("line_id")))), ",").alias("evidence"),
    )


def respond(msgs: DataFrame, active: DataFrame, most: int, mode: str = "deterministic", model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The response by mode: deterministic, by a model, or by a model with the deterministic one where it gives none.

    ``model`` is an injected function from the messages to rows of the same
    columns; there is none by default. ``source`` says where a row comes from.
    """
    if mode not in ("deterministic", "model", "auto"):
        raise ValueError(f"unknown mode {mode}")
    plain = observer_response(msgs, active, most).withColumn("source", F.lit("deterministic"))
    if mode == "deterministic" or (mode == "auto" and model is None):
        return plain
    if model is None:
        raise ValueError("mode model needs a model")
    made = model(msgs).withColumn("source", F.lit("model")).select(*plain.columns)
    return made if mode == "model" else made.unionByName(plain.join(made.select("session_id"), "session_id", "left_anti"))


def scope_messages(msgs: DataFrame, sessions: DataFrame, cursors: DataFrame, observed: DataFrame, peers: int, last: int, strict: bool) -> DataFrame:
    """The messages that each scope's observer looks at: its newest sessions', behind its cursor, unobserved, the last ones.

    ``sessions``: scope_key, session_id, updated_at, own. The own session and up
    to ``peers`` others count. Without strictness a scope with nothing behind
    its cursor looks at all its messages again.
    """
    w = Window.partitionBy("scope_key", "own").orderBy(F.desc("updated_at"), "session_id")
    near = sessions.withColumn("place", F.row_number().over(w)).where(F.col("own") | (F.col("place") <= peers)).select("scope_key", "session_id")
    found = msgs.join(near, "session_id").join(cursors.select("scope_key", "cursor"), "scope_key", "left")
    behind = F.col("cursor").isNull() | (F.col("created_at") > F.col("cursor"))
    marked = found.withColumn("behind", behind)
    if strict:
        pool = marked.where("behind")
    else:
        pool = marked.withColumn("some", F.max("behind").over(Window.partitionBy("scope_key"))).where("behind or not some")
    fresh = pool.join(observed.select("id").distinct(), "id", "left_anti")
    order = Window.partitionBy("scope_key").orderBy(F.desc("created_at"), F.desc("session_id"), F.desc("id"))
    return fresh.withColumn("n", F.row_number().over(order)).where(F.col("n") <= last).select("scope_key", "session_id", "id", "role", "text", "created_at")


def merged_cursor(a: Column, b: Column) -> Column:
    """The later of two times; a null never wins."""
    return F.greatest(a, b)


def continuation_confidence(task: Column, reply: Column) -> Column:
    has = lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "").cast("int")
    n = has(task) + has(reply)
    return F.when(n == 2, 0.92).when(n == 1, 0.82).otherwise(0.0)


def thread_continuations(threads: DataFrame, primary: DataFrame, with_reply: bool = True) -> DataFrame:
    """Continuation rows of a scope's threads: each thread's own hints; the response's hints fill the primary thread's gaps only.

    ``threads``: scope_key, thread_id, current_task, suggested_response;
    ``primary``: the same, a row a scope. Threads without a hint have no row.
    """
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    reply = clean(F.col("suggested_response")) if with_reply else F.lit(None).cast("string")
    cols = ["scope_key", "thread_id", clean(F.col("current_task")).alias("current_task"), reply.alias("suggested_response")]
    a, b = threads.select(*cols), primary.select(*cols).toDF("scope_key", "thread_id", "t", "r")
    both = a.join(b, ["scope_key", "thread_id"], "full_outer").select("scope_key", "thread_id", F.coalesce("current_task", "t").alias("current_task"), F.coalesce("suggested_response", "r").alias("suggested_response"))
    some = both.where("current_task is not null or suggested_response is not null")
    return some.withColumn("confidence", continuation_confidence(F.col("current_task"), F.col("suggested_response")))


def fold_continuations(updates: DataFrame, key: str = "session_id") -> DataFrame:
    """Confidence-gated continuation state of each key after its updates in time order.

    ``updates``: key, created_at, id, task, reply, confidence. A task counts
    from 500 on and is never lost to a weaker update. A reply counts from 700
    on and replaces another unless the state is surer. The confidence is that of the last
    update that gave either. A key's updates are folded in one row, so their
    number a key and batch bounds the memory.
    """
    start = F.struct(F.lit(None).cast("string").alias("task"), F.lit(None).cast("string").alias("reply"), F.lit(0).alias("confidence"), F.lit(0).alias("applied"))
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))

    def step(s: Column, u: Column) -> Column:
        c = F.least(u["confidence"], F.lit(1000))
        task, reply = F.when(c >= LEAST_TASK, clean(u["task"])), F.when(c >= LEAST_REPLY, clean(u["reply"]))
        adopt = reply.isNotNull() & (s["reply"].isNull() | (s["confidence"] <= c))
        gave = task.isNotNull() | adopt
        return F.struct(
            F.coalesce(task, s["task"]).alias("task"), F.when(adopt, reply).otherwise(s["reply"]).alias("reply"), F.when(gave, c).otherwise(s["confidence"]).cast("int").alias("confidence"),
            (s["applied"] + gave.cast("int")).alias("applied"),
        )

    own = updates.select(key, F.struct("created_at", "id", "task", "reply", F.col("confidence").cast("int").alias("confidence")).alias("u"))
    return own.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list("u")), start, step).alias("s")).select(key, "s.*")


def observer_pass(msgs: DataFrame, observed: DataFrame, active: DataFrame, records: DataFrame, last: int, most: int) -> DataFrame:
    """One observer pass over all sessions: candidates, response, chunk and the record's new cursor, a row a session with new text.

    ``records``: session_id, last_seq, cursor, generation. Sessions without a
    candidate or without text have no row.
    """
    picked = M.observer_candidates(msgs, observed, last)
    response = observer_response(picked, active, most)
    body = picked.where(F.trim("text") != "").groupBy("session_id").agg(
        F.sum(T.estimate_tokens(F.col("text"))).alias("message_tokens"), F.max_by("id", F.struct("created_at", "id")).alias("anchor"), F.max("created_at").alias("newest"), F.array_sort(F.collect_set("id")).alias("message_ids")
    )
    both = response.join(body, "session_id").join(records, "session_id", "left").where("tokens > 0 and message_tokens > 0")
    return both.select(
        "session_id", (F.coalesce("last_seq", F.lit(0)) + 1).alias("seq"), "observations", "tokens", "message_tokens", "anchor", "message_ids", merged_cursor(F.col("cursor"), F.col("newest")).alias("cursor"),
        "current_task", "suggested_response", continuation_confidence(F.col("current_task"), F.col("suggested_response")).alias("confidence"),
    )


# Events


def payload_faults(event_type: Column, payload: Column) -> Column:
    """What is wrong with an event's payload: schema, schema_version, scope_key, requested_at; nothing for other events."""
    v = F.try_parse_json(payload)
    get = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
    at = get("requested_at", "string")
    timed = at.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$") & F.try_to_timestamp(at).isNotNull()
    rules = [
        (v.isNull() | ~F.coalesce(payload.rlike(r"^\s*\{"), F.lit(False)), "schema"), (~F.coalesce(get("schema_version", "int") == SCHEMA_VERSION, F.lit(False)), "schema_version"),
        (F.trim(F.coalesce(get("scope_key", "string"), F.lit(""))) == "", "scope_key"), (~F.coalesce(timed, F.lit(False)), "requested_at"),
    ]
    own = F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))
    return F.when(event_type.isin(*EVENT_TYPES), own).otherwise(F.array().cast("array<string>"))


def replay_om(outbox: DataFrame, as_of: str, limit: int, failed: Column) -> DataFrame:
    """A replay of memory events alone: four times the limit is fetched first, then memory events are kept, then the limit counts.

    An event that nothing handles is done and skipped here; others are as in ``outbox.replay``.
    """
    from tessera.operators import outbox as O

    near = O.fetch(O.recover_stale(outbox, as_of, 300), "new", as_of, 4 * limit)
    own = near.where(F.col("event_type").isin(*EVENT_TYPES) | F.startswith("event_type", F.lit("om_"))).orderBy("id").limit(limit)
    attempt = F.col("attempt") + 1
    outcome = F.when(~F.col("event_type").isin(*EVENT_TYPES), "skipped").when(failed & O.should_retry(F.col("event_type"), attempt), "requeued").when(failed, "dead_letter").otherwise("done")
    return own.select("id", "event_type", outcome.alias("outcome"), attempt.alias("attempt"))


def observer_requests(events: DataFrame, applied: DataFrame, records: DataFrame) -> DataFrame:
    """Requests to observe with what becomes of them: run, idempotent_event or stale_generation; the latter two do nothing."""
    seen = applied.select("event_id", F.lit(True).alias("seen")).distinct()
    now = records.select("scope_key", F.col("generation").alias("now"))
    both = events.join(seen, "event_id", "left").join(now, "scope_key", "left")
    outcome = F.when(F.col("seen"), "idempotent_event").when(~F.coalesce(F.col("now") == F.col("expected_generation"), F.lit(False)), "stale_generation").otherwise("run")
    return both.select(*events.columns, outcome.alias("outcome"))


def failures(errors: DataFrame) -> DataFrame:
    """Dead-letter rows that tell of failed observers, from ``errors(session_id, error_code, error, kind, source, created_at)``."""
    payload = F.to_json(F.struct("session_id", "error_code", "error", F.col("kind").alias("om_failure_kind"), F.col("source").alias("om_failure_source")))
    uri = F.concat(F.lit("ctx://session/"), F.col("session_id").cast("string"))
    return errors.select(F.lit("om_observer_failed").alias("event_type"), uri.alias("uri"), payload.alias("payload_json"), F.lit("dead_letter").alias("status"), "created_at")


def event_rows(requests: DataFrame, event_type: str, as_of: str) -> DataFrame:
    """Outbox rows that ask for a memory event, due at once, from ``requests(scope_key, expected_generation)``."""
    if event_type not in EVENT_TYPES:
        raise ValueError(f"unknown event {event_type}")
    at = F.lit(as_of).cast("timestamp_ntz")
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "scope_key", "expected_generation", F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("requested_at"))
    uri = F.concat(F.lit("ctx://agent/om/"), "scope_key")
    return requests.select(F.lit(event_type).alias("event_type"), uri.alias("uri"), F.to_json(body).alias("payload_json"), F.lit("new").alias("status"), F.lit(0).alias("attempt"), at.alias("created_at"), at.alias("next_attempt_at"), F.lit("semantic").alias("lane"))


def migrate(entries: DataFrame, records: DataFrame, apply: bool) -> tuple[DataFrame, DataFrame]:
    """(entries, one report row) of moving old records' observation lines into entries; running it again adds nothing.

    Without ``apply`` the entries stay as they are and only the report is made.
    """
    rows = records.select("scope_key", F.posexplode(T.lines(F.col("active_observations"))).alias("n", "text"), F.col("updated_at").alias("created_at")).where(F.trim("text") != "")
    made = rows.select("scope_key", F.concat_ws(":", F.lit("migrated"), "scope_key", "n").alias("entry_id"), F.trim("text").alias("text"), F.lit("medium").alias("priority"), F.lit("chunk").alias("origin"), F.lit(None).cast("string").alias("superseded_by"), "created_at")
    new = made.join(entries.select("entry_id"), "entry_id", "left_anti").select(*entries.columns)
    report = made.agg(F.count("*").alias("lines")).crossJoin(F.broadcast(new.agg(F.count("*").alias("added"))))  # one row each
    return (entries.unionByName(new) if apply else entries), report


# Configuration


class ConfigError(ValueError):
    """A configuration that can't be meant; its text names the rule."""


@dataclass(frozen=True)
class Config:
    scope: str
    share_token_budget: bool
    async_disabled: bool
    message_tokens: int
    total_budget: int | None
    max_tokens_per_batch: int
    buffer_tokens: int | None
    observation_activation: float | None
    observation_block_after: int | None
    observation_tokens: int
    reflection_activation: float | None
    reflection_block_after: int | None

    def threshold(self, observed: int) -> int:
        """Tokens at which the observer runs: under a shared budget what observations leave of it, at least the base."""
        return self.message_tokens if self.total_budget is None else max(self.message_tokens, self.total_budget - observed)


#: Defaults of the configuration. Fixed values.
MESSAGE_TOKENS, OBSERVATION_TOKENS, BATCH_TOKENS = 30_000, 40_000, 10_000
BUFFER_SHARE, OBSERVATION_ACTIVATION, REFLECTION_ACTIVATION, BLOCK_AFTER = 0.2, 0.8, 0.5, 1.2
DISABLED = "disabled"


def resolve(
    scope: str = "session", share_token_budget: bool = False, message_tokens: int | None = None, max_tokens_per_batch: int | None = None, buffer_tokens: int | float | str | None = None, buffer_activation: float | None = None,
    block_after: float | None = None, observation_tokens: int | None = None, reflection_activation: float | None = None, reflection_block_after: float | None = None,
) -> Config:
    """The configuration with its defaults, or a ``ConfigError``.

    ``buffer_tokens`` is ``DISABLED``, a whole number, or a share of the message
    threshold below 1; ``block_after`` a multiple from 1 to under 2, or tokens.
    The resource scope buffers nothing unless that is asked for, which is then an error.
    """
    base = MESSAGE_TOKENS if message_tokens is None else message_tokens
    reflect = OBSERVATION_TOKENS if observation_tokens is None else observation_tokens
    batch = BATCH_TOKENS if max_tokens_per_batch is None else max_tokens_per_batch
    for value, name in ((base, "message_tokens"), (reflect, "observation_tokens")):
        if value <= 0:
            raise ConfigError(name)
    explicit = any(x is not None for x in (buffer_tokens, buffer_activation, block_after, reflection_activation, reflection_block_after))
    off = buffer_tokens == DISABLED or (scope == "resource" and not explicit)
    if scope == "resource" and not off:
        raise ConfigError("resource_scope_async")
    if share_token_budget and not off:
        raise ConfigError("share_token_budget_async")
    if batch <= 0:
        raise ConfigError("max_tokens_per_batch")
    budget = base + reflect if share_token_budget else None
    if off:
        return Config(scope, share_token_budget, True, base, budget, batch, None, None, None, reflect, None, None)
    tokens = _buffer(BUFFER_SHARE if buffer_tokens is None else buffer_tokens, base)
    if tokens >= base:
        raise ConfigError("buffer_tokens_at_threshold")
    first, second = _block(block_after, base, "observation_block_after"), _block(reflection_block_after, reflect, "reflection_block_after")
    activations = []
    for given, default, name in ((buffer_activation, OBSERVATION_ACTIVATION, "observation_activation"), (reflection_activation, REFLECTION_ACTIVATION, "reflection_activation")):
        value = default if given is None else given
        if not 0 < value <= 1:
            raise ConfigError(name)
        activations.append(value)
    return Config(scope, share_token_budget, False, base, budget, batch, tokens, activations[0], first, reflect, activations[1], second)


def _buffer(value: int | float | str, base: int) -> int:
    if isinstance(value, float):
        if not 0 < value < 1:
            raise ConfigError("buffer_tokens_ratio")
        value = math.floor(base * value + 0.5)
    if not isinstance(value, int) or value <= 0:
        raise ConfigError("buffer_tokens_absolute")
    return value


def _block(value: float | None, threshold: int, name: str) -> int:
    value = BLOCK_AFTER if value is None else value
    if not math.isfinite(value) or value < 1:
        raise ConfigError(name)
    out = math.floor(threshold * value + 0.5) if value < 2 else math.floor(value + 0.5)
    if out < threshold:
        raise ConfigError(name)
    return out


def process_step(record: dict, config: Config, initial: bool, read_only: bool, has_chunks: bool) -> dict[str, bool]:
    """What to do with a message: run the observer now, buffer in the background, activate what is buffered.

    A read-only step does nothing. Without background buffering the observer
    runs at its threshold; with it, at ``block_after``, and a crossed interval buffers.
    """
    pending, observed, last = record["pending_tokens"], record["observation_tokens"], record["last_buffered_tokens"]
    threshold = config.threshold(observed)
    reached = pending >= threshold
    if read_only:
        return {"observe": False, "buffer": False, "activate": False}
    blocked = config.observation_block_after is not None and pending >= config.observation_block_after
    crossed = bool(config.buffer_tokens) and pending // config.buffer_tokens > last // config.buffer_tokens
    return {"observe": reached and (config.async_disabled or blocked), "buffer": crossed and not reached, "activate": initial and has_chunks and reached}


def step_columns(pending: Column, last: Column, threshold: Column, buffer: Column, block_after: Column, initial: Column, read_only: Column, has_chunks: Column) -> dict[str, Column]:
    """``process_step`` over rows: observe, buffer and activate. A null ``block_after`` means no background buffering, a null ``buffer`` no interval."""
    reached = pending >= threshold
    crossed = F.coalesce(F.floor(pending / buffer) > F.floor(last / buffer), F.lit(False))
    steps = {"observe": reached & F.coalesce(pending >= block_after, F.lit(True)), "buffer": crossed & ~reached, "activate": initial & has_chunks & reached}
    return {name: ~read_only & does for name, does in steps.items()}


def resolve_columns(rows: DataFrame) -> DataFrame:
    """``resolve`` over rows: their columns with ``error`` and what a configuration resolves to, null where there is an error.

    ``rows`` has scope, share_token_budget, message_tokens, observation_tokens, max_tokens_per_batch, buffer_tokens,
    buffer_ratio, buffer_off, buffer_activation, block_after, reflection_activation and reflection_block_after; nulls take the defaults.
    ``buffer_ratio`` is a share of the message threshold, ``buffer_off`` turns background buffering off.
    """
    given = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    half = lambda x: F.floor(x + 0.5).cast("int")
    base, reflect = given("message_tokens", MESSAGE_TOKENS), given("observation_tokens", OBSERVATION_TOKENS)
    explicit = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ("buffer_tokens", "buffer_ratio", "buffer_activation", "block_after", "reflection_activation", "reflection_block_after")])
    turned_off = F.coalesce("buffer_off", F.lit(False))
    off = turned_off | ((F.col("scope") == "resource") & ~explicit)
    ratio = F.when(F.col("buffer_tokens").isNull(), given("buffer_ratio", BUFFER_SHARE))
    tokens = F.when(ratio.isNotNull(), half(base * ratio)).otherwise(F.col("buffer_tokens"))

    def block(column: str, threshold: Column) -> Column:
        value = given(column, BLOCK_AFTER)
        return F.when((value >= 1) & (value < float("inf")), F.when(value < 2, half(threshold * value)).otherwise(half(value)))

    first, second = block("block_after", base), block("reflection_block_after", reflect)
    outside = lambda c, default: ~((given(c, default) > 0) & (given(c, default) <= 1))
    rules = [
        (base <= 0, "message_tokens"), (reflect <= 0, "observation_tokens"), ((F.col("scope") == "resource") & ~off, "resource_scope_async"), (F.coalesce("share_token_budget", F.lit(False)) & ~off, "share_token_budget_async"),
        (given("max_tokens_per_batch", BATCH_TOKENS) <= 0, "max_tokens_per_batch"), (~off & F.coalesce(~((ratio > 0) & (ratio < 1)), F.lit(False)), "buffer_tokens_ratio"), (~off & (tokens <= 0), "buffer_tokens_absolute"), (~off & (tokens >= base), "buffer_tokens_at_threshold"),
        (~off & F.coalesce(first < base, F.lit(True)), "observation_block_after"), (~off & F.coalesce(second < reflect, F.lit(True)), "reflection_block_after"), (~off & outside("buffer_activation", OBSERVATION_ACTIVATION), "observation_activation"), (~off & outside("reflection_activation", REFLECTION_ACTIVATION), "reflection_activation"),
    ]
    error = F.lit(None).cast("string")
    for bad, name in reversed(rules):
        error = F.when(bad, name).otherwise(error)
    judged = rows.withColumns({"error": error, "__base": base, "__tokens": tokens, "__first": first, "__second": second, "__off": off})
    fine = lambda c: F.when(F.col("error").isNull(), F.col(c))
    on = lambda c: F.when(F.col("error").isNull() & ~F.col("__off"), F.col(c))
    return judged.select(*rows.columns, "error", fine("__base").alias("threshold"), on("__tokens").cast("int").alias("buffer"), on("__first").alias("block"), on("__second").alias("reflection_block"))


def saves_output(read_only: bool, unsaved: int) -> bool:
    return not read_only and unsaved > 0


def status(records: DataFrame) -> DataFrame:
    """The nine measures of all records as one row; 0 where there are none, nulls as 0."""
    some = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"{c.removeprefix('is_')}_count")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    flags = ("is_observing", "is_reflecting", "is_buffering_observation", "is_buffering_reflection")
    sums = (("observation_token_count", "observation_tokens_active"), ("pending_message_tokens", "pending_message_tokens"), ("observer_trigger_count_total",) * 2, ("reflector_trigger_count_total",) * 2)
    return records.agg(F.count("*").alias("records_total"), *[some(c) for c in flags], *[total(c, name) for c, name in sums])
