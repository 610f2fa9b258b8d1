"""Observation text, visible entries, hints, batching, promotion and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Bounds of a promotion request, fixed values.
MOST_FACTS, MOST_CHARS, MOST_IDS, MOST_MILLI = 64, 512, 32, 1000


def synthesize(msgs: DataFrame, active: DataFrame, limit: int = 240) -> DataFrame:
    """``(session_id, id, line)``: one "[role] text" line a message, none that is active or repeats an earlier one."""
    line = F.concat(F.lit("["), "role", F.lit("] "), T.clip_words(F.col("text"), limit))
    own = msgs.where(F.trim("text") != "").select("session_id", "id", "turn", line.alias("line"))
    first = own.groupBy("session_id", "line").agg(F.min(F.struct("turn", "id")).alias("f"))
    return first.join(active.select("session_id", "line").distinct(), ["session_id", "line"], "left_anti").select("session_id", F.col("f.id").alias("id"), "line")


def visible_entries(activated: DataFrame, buffered: DataFrame) -> DataFrame:
    """Activated and buffered entries, one for each id; the activated one wins."""
    both = activated.withColumn("origin", F.lit(0)).unionByName(buffered.withColumn("origin", F.lit(1)))
    rest = [c for c in activated.columns if c not in ("scope", "entry_id")]
    first = both.groupBy("scope", "entry_id").agg(F.min_by(F.struct(*rest, "origin"), "origin").alias("e"))
    return first.select("scope", "entry_id", "e.*")


def reserved(entries: DataFrame, most: int) -> DataFrame:
    """The entries of high priority that a hint keeps room for: newest first, then by id."""
    w = Window.partitionBy("scope").orderBy(F.desc("created_at"), "entry_id")
    return entries.where("priority = 'high'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def bounded_hint(lines: DataFrame, budget: int) -> DataFrame:
    """Lines of each scope within a character budget, high priority first, then the newest.

    Running lengths decide, so a line that doesn't fit ends the hint.
    """
    order = Window.partitionBy("scope").orderBy((F.col("priority") != "high").cast("int"), F.desc("created_at"), "entry_id")
    used = F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used).where(F.col("used") <= budget)


def pack(rows: DataFrame, key: str, order: list[str], tokens: str, most: int) -> DataFrame:
    """Sequential batches: a row opens a new batch where the running sum would pass ``most``; a key may be of any size."""
    from tessera.operators.packing import batches

    return batches(rows, key, order, tokens, most)


def fact_faults(text: Column, ids: Column, confidence: Column) -> Column:
    """What is wrong with a fact to be promoted, as an array of names."""
    rules = [(F.trim(text) == "", "empty"), (F.length(text) > MOST_CHARS, "too_long"), (F.size(ids) > MOST_IDS, "too_many_ids"), (confidence > MOST_MILLI, "confidence")]
    return F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))


def promote(facts: DataFrame, existing: DataFrame, best_effort: bool) -> DataFrame:
    """Facts to add: valid, new, and one of each category and text. All or nothing, unless best effort is asked for."""
    judged = facts.withColumn("faults", fact_faults(F.col("text"), F.col("ids"), F.col("confidence")))
    ok = judged.where(F.size("faults") == 0)
    if not best_effort:
        bad = judged.agg(F.count_if(F.size("faults") > 0).alias("bad"))
        ok = ok.crossJoin(F.broadcast(bad)).where("bad = 0").drop("bad")  # one row is broadcast
    one = ok.groupBy("category", "text").agg(F.min("id").alias("id"), F.max("confidence").alias("confidence"))
    return one.join(existing.select("category", "text").distinct(), ["category", "text"], "left_anti")


def reflect_pure(entries: DataFrame, reflections: DataFrame) -> DataFrame:
    """The pure form of a reflection: medium priority, and nothing happens where it covers no entry."""
    cover = reflections.select("scope", F.col("event_id").alias("by"), F.explode("covers").alias("entry_id"))
    met = cover.join(entries.select("scope", "entry_id"), ["scope", "entry_id"], "left_semi").select("scope", F.col("by").alias("event_id")).distinct()
    old = entries.join(cover, ["scope", "entry_id"], "left").select("scope", "entry_id", "text", "priority", F.coalesce("superseded_by", "by").alias("superseded_by"))
    new = reflections.join(met, ["scope", "event_id"], "left_semi").select("scope", F.col("event_id").alias("entry_id"), "text", F.lit("medium").alias("priority"), F.lit(None).cast("string").alias("superseded_by"))
    return old.unionByName(new)


def drift(ledger: DataFrame, listing: DataFrame) -> DataFrame:
    """``(uri, drift)``: missing on disk, not in the ledger, or changed."""
    a, b = ledger.select("uri", F.col("hash").alias("lh")), listing.select("uri", F.col("hash").alias("fh"))
    both = a.join(b, "uri", "full_outer")
    kind = F.when(F.col("fh").isNull(), "missing").when(F.col("lh").isNull(), "untracked").when(F.col("lh") != F.col("fh"), "changed")
    return both.select("uri", kind.alias("drift")).where("drift is not null")


def trace_join(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts of an index against the documents that it names: found, missing, invalid."""
    both = index.select("trace_id").join(documents.select("trace_id", "payload"), "trace_id", "left")
    return both.agg(
        F.count_if(F.col("payload").isNotNull() & F.try_parse_json("payload").isNotNull()).alias("found"), F.count_if(F.col("payload").isNull()).alias("missing"),
        F.count_if(F.col("payload").isNotNull() & F.try_parse_json("payload").isNull()).alias("invalid"),
    )
