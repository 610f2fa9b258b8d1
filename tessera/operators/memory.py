"""Observational memory and session memories as batch folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that speak for a memory category; the first three count for user messages only. Fixed values.
CATEGORIES = {
    "profile": ["my name is", "i am ", "call me ", "내 이름"],
    "preferences": ["prefer", "preference", "avoid", "i like", "i dislike", "i don't like", "선호", "피해", "싫어", "좋아"],
    "entities": ["project", "repository", "repo", "service", "team", "프로젝트"],
    "events": [
        "today", "yesterday", "tomorrow", "incident", "outage", "deploy", "deployed", "release", "released", "meeting", "deadline", "milestone", "happened", "occurred",
        "failed at", "rolled back", "오늘", "어제", "내일", "발생", "배포", "릴리스", "회의",
    ],
    "cases": [
        "root cause", "rca", "postmortem", "fixed", "resolved", "workaround", "repro", "reproduced", "solution", "solved", "debugged", "troubleshoot", "investigation",
        "원인", "해결", "재현", "대응",
    ],
    "patterns": [
        "always", "never", "whenever", "if we", "if you", "checklist", "playbook", "rule", "guideline", "best practice", "pattern", "must", "should always",
        "항상", "절대", "반드시", "체크리스트", "원칙",
    ],
}
USER_ONLY = ("profile", "preferences", "entities")
CONFIDENCE = 550


def messages(conversations: DataFrame) -> DataFrame:
    """Session messages from ``conversations``: a minute passes each turn."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))
    return conversations.select(F.col("conv_id").alias("session_id"), F.concat_ws(":", "conv_id", "turn").alias("id"), "turn", "role", "text", at.alias("created_at"))


def heuristic_categories(role: Column, text: Column) -> Column:
    """All categories that a message speaks for."""
    low = F.lower(text)
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    own = [F.when(any_of(words) & ((role == "user") if c in USER_ONLY else F.lit(True)), c) for c, words in CATEGORIES.items()]
    return F.filter(F.array(*own), lambda c: c.isNotNull())


def extract_memories(msgs: DataFrame) -> DataFrame:
    """A row for each category of each message."""
    return msgs.select("session_id", "id", "role", "text", F.explode(heuristic_categories(F.col("role"), F.col("text"))).alias("category"))


def merge_memories(memories: DataFrame) -> DataFrame:
    """One memory for each category and normalised text: most confidence, all sources."""
    norm = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    return memories.groupBy("category", norm.alias("text")).agg(F.lit(CONFIDENCE).alias("confidence"), F.array_sort(F.collect_set("id")).alias("sources"))


def activation_boundary(chunks: DataFrame, key: str, order: str, tokens: str, target: Column) -> DataFrame:
    """How many leading chunks of each key to activate.

    The longest prefix whose tokens stay within the target, else the first
    chunk alone, the smallest prefix over it.
    """
    run = chunks.withColumn("run", F.sum(tokens).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by("run", order)
    fit = F.count_if(F.col("run") <= target)
    best = F.max(F.when(F.col("run") <= target, F.col("run")))
    return run.groupBy(key).agg(F.greatest(fit, F.lit(1)).alias("chunks"), F.coalesce(best, first).alias("tokens"))


def reflection_action(tokens: Column, threshold: Column, activation: Column, block_after: Column, buffered: Column, buffering: Column, reflecting: Column) -> Column:
    """none, buffer or reflect. The threshold is strict; without an activation ratio nothing is buffered."""
    reached = tokens > threshold
    off = ~((activation > 0) & (activation <= 1))
    return (
        F.when(reflecting, "none").when(activation.isNull(), F.when(reached, "reflect").otherwise("none")).when(off, "none")
        .when(reached, F.when(buffered, "reflect").when(F.coalesce(tokens >= block_after, F.lit(False)), "reflect").when(buffering, "none").otherwise("buffer"))
        .when(buffered | buffering, "none").when(tokens >= threshold * activation, "buffer").otherwise("none")
    )


def observer_write(pending: Column, observed: Column, last_buffered: Column, base: int, budget: int | None, buffer: int | None, block_after: int | None) -> dict[str, Column]:
    """Threshold reached, interval crossed and block-after exceeded, by name."""
    threshold = F.greatest(F.lit(base), F.lit(budget) - observed) if budget is not None else F.lit(base)
    interval = (F.floor(pending / buffer) > F.floor(last_buffered / buffer)) if buffer else F.lit(False)
    reached = pending >= threshold
    return {
        "threshold": threshold.cast("long"), "threshold_reached": reached, "interval_triggered": interval & ~reached,
        "block_after_exceeded": (pending >= block_after) if block_after is not None else F.lit(False),
    }


def observer_candidates(msgs: DataFrame, observed: DataFrame, last: int) -> DataFrame:
    """The last ``last`` messages of each session that aren't observed yet."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    fresh = msgs.join(observed.select("id").distinct(), "id", "left_anti")
    return fresh.withColumn("place", F.row_number().over(w)).where(F.col("place") <= last)


def apply_reflection(entries: DataFrame, reflections: DataFrame) -> DataFrame:
    """Persisted reflection: covered entries are superseded, the merged entry is added at high priority, the generation grows.

    ``entries``: scope, entry_id, text, superseded_by. ``reflections``: scope,
    event_id, text, covers. It is inserted even if it covers nothing.
    """
    cover = reflections.select("scope", F.col("event_id").alias("by"), F.explode("covers").alias("entry_id"))
    old = entries.join(cover, ["scope", "entry_id"], "left").select("scope", "entry_id", "text", "priority", F.coalesce("superseded_by", "by").alias("superseded_by"))
    new = reflections.select("scope", F.col("event_id").alias("entry_id"), "text", F.lit("high").alias("priority"), F.lit(None).cast("string").alias("superseded_by"))
    return old.unionByName(new)


def resolve_candidates(candidates: DataFrame, threshold: float = 0.9, existing: DataFrame | None = None) -> DataFrame:
    """Greedy memory resolution within a category, in input order, against existing memories and those that it makes.

    A candidate merges into the most similar earlier memory (full cosine, at
    least ``threshold``), else it becomes one and later ones may match it.
    ``candidates``: category, id, vec; ``existing``: category, memory_id, vec. See ``resolution.resolve``.
    """
    from tessera.operators import resolution

    return resolution.resolve(candidates, threshold, existing)


def parse_sections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tagged sections of a response, tag by tag; the last unclosed one runs to the end."""
    import re

    tag = re.compile(r"<(/?)([a-z][a-z0-9_-]*)>", re.I)
    for pdf in batches:
        out = []
        for row in pdf.itertuples():
            open_, at = None, 0
            for m in tag.finditer(row.text or ""):
                name = m[2].lower()
                if not m[1] and open_ is None:
                    open_, at = name, m.end()
                elif m[1] and name == open_:
                    out.append((row.id, name, row.text[at : m.start()].strip()))
                    open_ = None
            if open_ is not None:
                out.append((row.id, open_, row.text[at:].strip()))
        yield pd.DataFrame(out, columns=["id", "section", "body"])


def parse_memories(replies: DataFrame, known: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """``(reply_id, category, text, sources, confidence)`` from models' replies, JSON in ``body``.

    Items stand in an array, under ``memories``, and either may lie in
    ``result`` or ``data``. An item needs a category and a text; sources that
    are named must be ``known(id)``, and an item whose named ones all aren't goes. Items without
    named sources take the reply's ``fallback(reply_id, id)`` and go without
    one. Equal items are merged: the highest confidence, all sources.
    """
    from tessera.operators import chunks as C

    v = F.try_parse_json("body")
    at = lambda x, path, kind: F.try_variant_get(x, path, kind)
    root = F.coalesce(at(v, "$.result", "variant"), at(v, "$.data", "variant"), v)
    items = F.coalesce(at(root, "$", "array<variant>"), at(root, "$.memories", "array<variant>"))
    one = replies.select("reply_id", F.posexplode(items).alias("n", "item"))
    is_text = lambda path: F.schema_of_variant(at(F.col("item"), path, "variant")) == "STRING"
    text = F.coalesce(*[F.when(is_text(f"$.{k}"), at(F.col("item"), f"$.{k}", "string")) for k in ("text", "memory", "content", "overview", "abstract")])
    many = F.coalesce(at(F.col("item"), "$.source_message_ids", "array<string>"), at(F.col("item"), "$.source_ids", "array<string>"))
    single = F.when(is_text("$.source_message_id"), at(F.col("item"), "$.source_message_id", "string"))
    named = F.coalesce(at(F.col("item"), "$.source_message_ids", "variant"), at(F.col("item"), "$.source_ids", "variant"), at(F.col("item"), "$.source_message_id", "variant")).isNotNull()
    name = F.when(is_text("$.category"), at(F.col("item"), "$.category", "string"))
    rows = one.select(
        "reply_id", "n", F.when(name.isNotNull(), F.coalesce(C.category_of(name), F.lit("patterns"))).alias("category"), F.trim(F.regexp_replace(text, r"(?U)\s+", " ")).alias("text"),
        C.confidence_of(at(F.col("item"), "$.confidence", "string")).alias("confidence"), named.alias("named"), F.transform(F.concat(F.coalesce(many, F.array().cast("array<string>")), F.array_compact(F.array(single))), lambda x: F.trim(x)).alias("ids"),
    ).where("category is not null and text <> ''")
    ids = rows.where("named").select("reply_id", "n", F.explode(F.array_distinct("ids")).alias("id")).join(known.select("id").distinct(), "id", "left_semi")
    if fallback is not None:
        ids = ids.unionByName(rows.where("not named").select("reply_id", "n").join(fallback.select("reply_id", "id"), "reply_id"))
    sources = rows.join(ids, ["reply_id", "n"]).groupBy("reply_id", "category", "text").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("id")).alias("sources"))
    return sources.select("reply_id", "category", "text", "sources", "confidence")


#: Seconds after which an applying checkpoint counts as given up. A fixed value.
STALE_SECONDS = 60


def claim_checkpoints(checkpoints: DataFrame, requests: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(checkpoints, outcomes) after promotion requests: the first half of an idempotent apply.

    ``checkpoints``: session_id, checkpoint_id, request_hash, phase, attempts,
    updated_at. ``requests``: session_id, checkpoint_id, request_hash. Stale
    applying ones are pending again first. A request is ``claimed`` (new or
    pending; its facts are then applied), ``replayed`` (applied before),
    ``busy`` (applying) or a ``conflict`` (another hash under its id); of
    several requests for one checkpoint the smallest hash counts.
    """
    keys = ["session_id", "checkpoint_id"]
    now = F.lit(as_of).cast("timestamp_ntz")
    stale = (F.col("phase") == "applying") & (F.col("updated_at") <= now - F.expr(f"interval {STALE_SECONDS} second"))
    held = checkpoints.withColumn("phase", F.when(stale, "pending").otherwise(F.col("phase")))
    asked = requests.groupBy(*keys).agg(F.min("request_hash").alias("new_hash"))
    both = held.join(asked, keys, "full_outer")
    outcome = (
        F.when(F.col("new_hash").isNull(), F.lit(None).cast("string")).when(F.col("phase").isNull(), "claimed").when(F.col("request_hash") != F.col("new_hash"), "conflict")
        .when(F.col("phase") == "applied", "replayed").when(F.col("phase") == "applying", "busy").otherwise("claimed")
    )
    both = both.withColumn("outcome", outcome)
    claimed = F.coalesce(F.col("outcome") == "claimed", F.lit(False))
    after = both.select(
        *keys, F.coalesce("request_hash", "new_hash").alias("request_hash"), F.when(claimed, "applying").otherwise(F.col("phase")).alias("phase"),
        (F.coalesce("attempts", F.lit(0)) + claimed.cast("int")).alias("attempts"), F.when(claimed, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return after.select(*checkpoints.columns), both.where("outcome is not null").select(*keys, "outcome")


def finish_checkpoints(checkpoints: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """The second half: applying checkpoints named in ``results(session_id, checkpoint_id, ok)`` are applied, or pending again where it failed."""
    keys = ["session_id", "checkpoint_id"]
    both = checkpoints.join(results.select(*keys, "ok"), keys, "left")
    hit = (F.col("phase") == "applying") & F.col("ok").isNotNull()
    phase = F.when(hit & F.col("ok"), "applied").when(hit, "pending").otherwise(F.col("phase"))
    at = F.when(hit, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at"))
    return both.withColumn("updated_at", at).withColumn("phase", phase).select(*checkpoints.columns)


def commit(msgs: DataFrame, archives: DataFrame, extract: bool = True) -> tuple[DataFrame, DataFrame]:
    """(archive rows, memories) of committing sessions: each session's messages become its next archive.

    ``archives``: session_id, archive. The memories are the heuristic ones, merged;
    none if they aren't asked for.
    """
    last = archives.groupBy("session_id").agg(F.max("archive").alias("last"))
    rows = msgs.join(last, "session_id", "left").withColumn("archive", (F.coalesce("last", F.lit(0)) + 1).cast("int")).drop("last")
    found = merge_memories(extract_memories(msgs))
    return rows, found if extract else found.limit(0)


def archive_context(msgs: DataFrame, query: str, archives: int, messages: int) -> DataFrame:
    """The messages of each session's archives that speak to a query, with their ``place``, the most relevant last.

    ``msgs``: session_id, archive, id, text, created_at. Relevance is the number
    of the query's terms that a text contains. The best archives by their best
    message come first, newer ones on ties; those without relevance count only
    where a session has none with it, and so do messages.
    """
    from tessera.functions import text as T

    terms = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if len(w.encode()) >= 2]
    known = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    rows = msgs.withColumn("rel", T.message_relevance(F.col("text"), known))
    session = Window.partitionBy("session_id")
    best = rows.groupBy("session_id", "archive").agg(F.max("rel").alias("score")).withColumn("top", F.max("score").over(session)).where("top = 0 or score > 0")
    near = best.withColumn("n", F.row_number().over(session.orderBy(F.desc("score"), F.desc("archive")))).where(F.col("n") <= archives).select("session_id", "archive")
    found = rows.join(near, ["session_id", "archive"]).withColumn("top", F.max("rel").over(session)).where("top = 0 or rel > 0")
    kept = found.withColumn("n", F.row_number().over(session.orderBy(F.desc("rel"), F.desc("archive"), F.desc("created_at"), "id"))).where(F.col("n") <= messages)
    return kept.withColumn("place", F.row_number().over(session.orderBy("rel", "created_at", F.desc("n")))).select("session_id", "archive", "id", "rel", "place")
