"""The event outbox: lanes, due events, retries, recovery, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Attempts and the longest wait in seconds by event type, fixed values; others have DEFAULT.
POLICY = {"semantic_scan": (5, 60), "om_reflect_requested": (6, 120), "om_reflect_buffer_requested": (6, 120), "om_observe_buffer_requested": (6, 120)}
DEFAULT = (3, 30)


def from_events(events: DataFrame) -> DataFrame:
    """The outbox that the ``events`` table stands for."""
    kind = F.col("event_type")
    typed = F.when(kind == "view", "embedding_upsert").when(kind == "click", "semantic_scan").when(kind == "purchase", "om_reflect_requested").when(kind == "signup", "upsert").otherwise("om_observe_buffer_requested")
    status = F.when(kind == "error", "dead_letter").when(kind == "signup", "done").when(kind == "view", "processing").otherwise("new")
    wait = F.make_dt_interval(F.lit(0), (F.col("event_id") % 240).cast("int"))
    return events.select(
        F.col("event_id").alias("id"), typed.alias("event_type"), F.col("ts").alias("created_at"), status.alias("status"), (F.col("event_id") % 7).cast("int").alias("attempt"),
        (F.col("ts") + wait).alias("next_attempt_at"), F.col("props").alias("payload_json"), lane(typed).alias("lane"),
    )


def lane(event_type: Column) -> Column:
    return F.when((event_type == "upsert") | event_type.startswith("embedding_"), "embedding").otherwise("semantic")


def _as_of(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def fetch(outbox: DataFrame, status: str, as_of: str, limit: int) -> DataFrame:
    """The first events of a status by id; new ones only when due. Limit 0 gives none."""
    ok = F.col("status") == status
    if status == "new":
        ok = ok & (F.col("next_attempt_at") <= _as_of(as_of))
    return outbox.where(ok).orderBy("id").limit(limit)


def recover_stale(outbox: DataFrame, as_of: str, seconds: int) -> DataFrame:
    stale = (F.col("status") == "processing") & (F.col("created_at") <= _as_of(as_of) - F.expr(f"interval {seconds} second"))
    return outbox.withColumn("status", F.when(stale, "new").otherwise(F.col("status")))


def _policy(event_type: Column, place: int) -> Column:
    out = F.lit(DEFAULT[place])
    for kind, values in POLICY.items():
        out = F.when(event_type == kind, values[place]).otherwise(out)
    return out


def should_retry(event_type: Column, attempt: Column) -> Column:
    return attempt < _policy(event_type, 0)


def backoff(event_type: Column, attempt: Column, seed: Column | None = None) -> Column:
    """Seconds to wait: powers of two up to the policy's most; with a seed, jitter of up to a quarter from its hash."""
    base = F.least(F.pow(F.lit(2), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(6))).cast("long"), _policy(event_type, 1).cast("long"))
    if seed is None:
        return base
    bound = F.greatest(F.floor(base / 4), F.lit(1))
    jitter = F.pmod(F.xxhash64(F.concat_ws(":", event_type, attempt, seed)), bound + 1)
    return F.least(base + jitter, _policy(event_type, 1).cast("long"))


def snapshot(outbox: DataFrame, as_of: str) -> DataFrame:
    """Counts by lane and, in a row with a null lane, over all: one rollup."""
    is_ = lambda s: F.col("status") == s
    known = F.when(F.col("lane").isin("semantic", "embedding"), F.col("lane")).otherwise("semantic")
    return outbox.withColumn("lane", known).rollup("lane").agg(
        F.count_if(is_("new")).alias("new_total"), F.count_if(is_("new") & (F.col("next_attempt_at") <= _as_of(as_of))).alias("new_due"), F.count_if(is_("processing")).alias("processing"),
        F.count_if(is_("done")).alias("processed"), F.count_if(is_("dead_letter")).alias("dead"), F.min(F.when(is_("new"), F.col("next_attempt_at"))).alias("earliest"),
    )


def latency_report(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Count, rounded-rank percentiles and mean of the whole number ``v`` by keys.

    Values are counted first; running counts then tell which value has the
    rank. So no group is collected, whatever its size.
    """
    hist = traces.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    run = hist.withColumn("upto", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    at = lambda bp: F.floor(((F.col("all") - 1) * bp + 5000) / 10000)
    pick = lambda bp: F.min(F.when(F.col("upto") > at(bp), F.col("v")))
    return run.groupBy(*keys).agg(
        F.sum("n").alias("traces"), pick(5000).alias("p50"), pick(9500).alias("p95"), pick(9900).alias("p99"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 4).alias("mean")
    )


#: Words with their counterparts in stress variants, both ways. Fixed values.
ALIASES = {"token": "토큰", "session": "세션", "memory": "메모리", "queue": "큐", "benchmark": "벤치마크"}
AUTH_WORDS = ["auth", "oauth", "authentication", "authorization", "login", "signin"]
AUTH_ALIAS = "인증"


def stress_variants(query: Column) -> Column:
    """An array of (kind, variant): a misspelt longest word, known aliases, a paraphrase."""
    words = F.filter(F.split(query, r"(?U)\s+"), lambda x: x != "")
    longest = F.array_max(F.transform(words, F.length))
    at = F.size(words) - F.array_position(F.reverse(F.transform(words, F.length)), longest)  # the last of the longest, from 0
    cut = F.transform(words, lambda x, i: F.when(i == at, F.concat(F.substring(x, F.lit(1), F.floor(F.length(x) / 2).cast("int")), F.substring(x, F.floor(F.length(x) / 2).cast("int") + 2, F.length(x)))).otherwise(x))
    pairs = {**{w: AUTH_ALIAS for w in AUTH_WORDS}, AUTH_ALIAS: "auth", **ALIASES, **{v: k for k, v in ALIASES.items()}}
    known = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    low = F.transform(words, F.lower)
    bare = lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    alias = F.transform(low, lambda x: F.coalesce(F.try_element_at(known, bare(x)), x))
    changed = F.exists(low, lambda x: F.try_element_at(known, bare(x)).isNotNull())
    item = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("variant"))
    all_ = F.array(
        F.when(longest >= 5, item("typo", F.array_join(cut, " "))), F.when(changed, item("alias", F.array_join(alias, " "))),
        F.when((F.size(words) >= 2) & ~F.lower(F.trim(query)).startswith("how to "), item("paraphrase", F.concat(F.lit("how to "), query))),
    )
    return F.filter(all_, lambda x: x.isNotNull())


#: Event types that have a handler, fixed values; others go to dead letter.
HANDLED = ("semantic_scan", "upsert", "embedding_upsert", "om_reflect_requested", "om_reflect_buffer_requested", "om_observe_buffer_requested")


def replay(outbox: DataFrame, as_of: str, limit: int, failed: Column, include_dead: bool = False) -> DataFrame:
    """One pass over due events: ``(id, outcome, attempt, next_attempt_at)``.

    Stale events are recovered first. Handled ones are done; a failed one is
    put back with its backoff while attempts are left, else it is dead, as is
    one that nothing handles. ``failed`` says which handler calls fail.
    """
    ready = fetch(recover_stale(outbox, as_of, 300), "new", as_of, limit)
    if include_dead:
        ready = ready.unionByName(fetch(outbox, "dead_letter", as_of, limit)).orderBy("id").limit(limit)
    attempt = F.col("attempt") + 1
    again = failed & should_retry(F.col("event_type"), attempt)
    outcome = F.when(~F.col("event_type").isin(*HANDLED), "dead_letter").when(again, "requeued").when(failed, "dead_letter").otherwise("done")
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff(F.col("event_type"), attempt).cast("decimal(18,6)"))
    due = F.when(outcome == "requeued", _as_of(as_of) + wait).otherwise(F.col("next_attempt_at"))
    return ready.select("id", outcome.alias("outcome"), attempt.alias("attempt"), due.alias("next_attempt_at"))


def replay_report(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("outcome").agg(F.count("*").alias("events"))
