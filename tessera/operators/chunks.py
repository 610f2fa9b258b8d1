"""Observation chunks, memory keys and configuration rules."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Start and factor of the 64-bit text hash. Fixed values.
HASH_START, HASH_FACTOR = 0xCBF29CE484222325, 0x1000000001B3
#: Documents of a category.
SHARDS = 64
#: Key prefixes by memory category; profile has one key, others are patterns. Fixed values.
KEY_PREFIX = {"preferences": "pref", "entities": "entity", "events": "event", "cases": "case"}
#: Names that stand for a category. Fixed values.
CATEGORY_NAMES = {
    "profile": ["profile", "persona", "user_profile"], "preferences": ["preference", "preferences", "likes", "dislikes"], "entities": ["entity", "entities", "fact", "facts"],
    "events": ["event", "events", "timeline"], "cases": ["case", "cases", "incident", "incidents"], "patterns": ["pattern", "patterns", "rule", "rules", "playbook"],
}


def text_key(text: str) -> str:
    """12 hex digits of the hash of a text's lower-case ASCII words."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    h = HASH_START
    for b in " ".join(words).encode():
        h = (h ^ b) * HASH_FACTOR & (1 << 64) - 1
    return f"{h:016x}"[:12]


def with_memory_keys(memories: DataFrame) -> DataFrame:
    """``memories`` (category, text, …) with the key under which each is stored."""
    prefix = F.coalesce(*[F.when(F.col("category") == c, p) for c, p in KEY_PREFIX.items()], F.lit("pattern"))

    @F.pandas_udf("string")
    def key(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(text_key)

    return memories.withColumn("key", F.when(F.col("category") == "profile", "profile").otherwise(F.concat(prefix, F.lit("-"), key("text"))))


def category_of(name: Column) -> Column:
    """The category that a free name stands for, or null."""
    low = F.lower(F.trim(name))
    return F.coalesce(*[F.when(low.isin(words), c) for c, words in CATEGORY_NAMES.items()])


def confidence_of(value: Column) -> Column:
    """Thousandths from a share or a number of thousandths; 700 where there is none."""
    v = value.try_cast("double")
    scaled = F.when(v <= 1, v * 1000).otherwise(v)
    return F.when(v.isNull() | F.isnan(v), 700).otherwise(F.round(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1000.0))).cast("int"))


def continuation_confidence(task: Column, error: Column, observed: Column) -> Column:
    base = F.when(task.isNull(), 0).when(F.contains(task, F.lit("?")) | F.contains(task, F.lit("？")), 600).otherwise(820)
    own = base + F.when(error & (base > 0), 120).otherwise(0)
    return F.least(F.greatest(own, F.when(observed, 320).otherwise(0)), F.lit(1000))


def buffer_tokens(value: float | None, message_tokens: int) -> int:
    """Tokens to buffer: none, a share of the message threshold below 1, or a number."""
    if value is None:
        return 0
    out = math.floor(message_tokens * value + 0.5) if 0 < value < 1 else int(value) if value >= 1 else 0
    if out == 0:
        raise ValueError("buffer tokens must be a share in 0 to 1 or a positive number")
    return out


def block_after(value: float, threshold: int) -> int:
    """A multiple of the threshold from 1 to under 2, else tokens."""
    if not math.isfinite(value) or value < 1:
        raise ValueError("block_after must be 1 or more")
    return math.floor((threshold * value if value < 2 else value) + 0.5)


def append_chunks(new: DataFrame, applied: DataFrame, generations: DataFrame) -> DataFrame:
    """``new`` with an outcome: applied, idempotent_event (seen before) or stale_generation; the first of an event counts."""
    first = new.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "event_id"]), "seq").alias("r")).select("event_id", "r.*")
    seen = applied.select("event_id", F.lit(True).alias("seen")).distinct()
    now = generations.select("scope", F.col("generation").alias("current"))
    both = first.join(seen, "event_id", "left").join(now, "scope", "left")
    outcome = F.when(F.col("seen"), "idempotent_event").when(~F.col("generation").eqNullSafe(F.col("current")), "stale_generation").otherwise("applied")
    return both.withColumn("outcome", outcome).drop("seen", "current")


def build_chunks(msgs: DataFrame) -> DataFrame:
    """One chunk a session from its selected messages: tokens, newest message, ids; none without text."""
    last = F.max_by("id", F.struct("created_at", "id"))
    own = msgs.where(F.trim("text") != "").groupBy("session_id").agg(
        F.sum(F.ceil(F.length("text") / 4)).alias("tokens"), last.alias("anchor"), F.max("created_at").alias("last_observed"), F.array_sort(F.collect_set("id")).alias("message_ids")
    )
    return own.where("tokens > 0")


def observed_ids(activated: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids of activated messages and of those in buffered chunks."""
    return activated.select("id").unionByName(chunks.select(F.explode("message_ids").alias("id"))).distinct()


def chunk_faults(chunks: DataFrame) -> DataFrame:
    """Chunks that break a rule, with the rules: order, tokens, ids."""
    rules = [(F.col("seq") < 1, "seq"), (F.col("tokens") <= 0, "tokens"), (F.size("message_ids") == 0, "no_messages"), (F.size("message_ids") != F.size(F.array_distinct("message_ids")), "repeated_ids")]
    return chunks.withColumn("faults", F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))).where(F.size("faults") > 0)


def thread_id(*candidates: Column) -> Column:
    """The first identifier that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def _behind(value: Column, prefix: str) -> Column:
    """What follows a prefix, trimmed; null without it or if nothing follows."""
    return F.when(F.startswith(value, F.lit(prefix)), F.nullif(F.trim(F.substring(value, len(prefix) + 1, 1 << 30)), F.lit("")))


def _plain(value: Column) -> Column:
    """An identifier without the kind that it may begin with; null if it is blank."""
    own = F.nullif(F.trim(value), F.lit(""))
    return F.coalesce(_behind(own, "thread:"), _behind(own, "session:"), own)


def canonical_thread_id(scope: Column, scope_key: Column, thread: Column, session: Column, fallback: Column) -> Column:
    """The runtime's identifier of a thread, without its kind.

    The scope key's own name comes first in the scopes thread and session, then
    the thread, the session and the fallback; else it is the scope key.
    """
    named = F.when(scope == "thread", _behind(scope_key, "thread:")).when(scope == "session", _behind(scope_key, "session:"))
    return F.coalesce(named, _plain(thread), _plain(session), _plain(fallback), F.trim(scope_key))


def canonical_thread_ref(scope: Column, scope_key: Column, source_thread: Column, source_session: Column, thread: Column, session: Column, resource: Column) -> Column:
    """The engine's reference: canonical id with its kind, and where it comes from.

    Sources come before plain identifiers, and those before the scope key's
    name. A session scope prefers the session, other ones the thread; without any the
    scope's own default is taken.
    """
    key = F.trim(scope_key)
    origin_thread, origin_session = thread_id(source_thread, thread), thread_id(source_session, session)
    own_resource = F.coalesce(thread_id(resource), F.when(scope == "resource", _behind(key, "resource:")))
    kinds = {"thread": F.coalesce(origin_thread, _behind(key, "thread:")), "session": F.coalesce(origin_session, _behind(key, "session:")), "resource": own_resource}
    named = {k: F.concat(F.lit(f"{k}:"), v) for k, v in kinds.items()}
    by_session, by_thread = (F.coalesce(*[named[k] for k in order]) for order in (("session", "thread", "resource"), ("thread", "session", "resource")))
    canonical = F.coalesce(F.when(scope == "session", by_session).otherwise(by_thread), F.concat(scope, F.lit(":default")))
    return F.struct(canonical.alias("canonical_thread_id"), scope.alias("scope"), key.alias("scope_key"), origin_thread.alias("origin_thread_id"), origin_session.alias("origin_session_id"), own_resource.alias("resource_id"))


def scope_key(scope: Column, session: Column, thread: Column, resource: Column) -> Column:
    """A scope's key from its own identifier; null if that is blank."""
    own = F.when(scope == "session", thread_id(session)).when(scope == "thread", thread_id(thread)).when(scope == "resource", thread_id(resource))
    return F.concat(scope, F.lit(":"), own)


def parse_entries(content: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(text, [(session, message)]) of a memory document."""
    out: list[tuple[str, list[tuple[str, str]]]] = []
    mark = "  - source: session "
    for line in content.splitlines():
        if line.startswith("- "):
            out.append((" ".join(line[2:].split()), []))
        elif line.startswith(mark) and " message " in line and out:
            session, message = line[len(mark) :].split(" message ", 1)
            out[-1][1].append((session.strip(), message.strip()))
    return out


def render_entries(memories: DataFrame) -> DataFrame:
    """Memory documents from ``category, text, session_id, id``, texts and sources sorted within each.

    A category is written as ``SHARDS`` documents, by the hash of the text, so
    that no document grows with a category's share of all memories alone.
    """
    source = F.concat(F.lit("  - source: session "), F.col("session_id").cast("string"), F.lit(" message "), F.col("id"))
    shard = F.pmod(F.xxhash64("text"), F.lit(SHARDS)).cast("int").alias("shard")
    entry = memories.groupBy("category", shard, "text").agg(F.array_join(F.array_sort(F.collect_set(source)), "\n").alias("s"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("text", "s"))), lambda x: F.concat(F.lit("- "), x["text"], F.lit("\n"), x["s"]))
    return entry.groupBy("category", "shard").agg(F.array_join(lines, "\n").alias("document"))


def parse_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(category, text, session_id, id) rows of memory documents, the inverse of ``render_entries``."""
    for pdf in batches:
        rows = [(c, t, s, m) for c, doc in zip(pdf["category"], pdf["document"]) for t, sources in parse_entries(doc) for s, m in sources]
        yield pd.DataFrame(rows, columns=["category", "text", "session_id", "id"])
