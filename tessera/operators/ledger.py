"""Keyed state tables and their readers: checkpoints, index ledger, traces, memory records, chunks, thread states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def put(table: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """Replace rows by key; of several updates of a key the last by ``updated_at`` counts."""
    w = Window.partitionBy(*keys).orderBy(F.desc("updated_at"))
    last = update.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return table.join(last.select(*keys), keys, "left_anti").select(*table.columns).unionByName(last.select(*table.columns))


def checkpoints(table: DataFrame) -> DataFrame:
    """All checkpoints by worker."""
    return table.orderBy("worker_name")


def advance(table: DataFrame, worker: str, processed: DataFrame) -> DataFrame:
    """The checkpoint table after a pass: the worker stands at the largest event that it has processed, never further back."""
    now = processed.agg(F.lit(worker).alias("worker_name"), F.max("id").alias("last_event_id"), F.max("created_at").alias("updated_at")).where("last_event_id is not null")
    both = table.unionByName(now.select(*table.columns))
    return both.groupBy("worker_name").agg(F.max("last_event_id").alias("last_event_id"), F.max("updated_at").alias("updated_at")).select(*table.columns)


def point(table: DataFrame, **keys: object) -> DataFrame:
    """The row of a key."""
    for name, value in keys.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def index_state(docs: DataFrame) -> DataFrame:
    """The ledger of a document table: uri, content hash, time."""
    return docs.select("uri", F.sha2("content", 256).alias("hash"), "updated_at")


def under_scope(table: DataFrame, scope_key: str) -> DataFrame:
    """A scope's thread states or continuations: newest first, then confidence if there is one, then thread."""
    order = [F.desc("updated_at")] + ([F.desc("confidence")] if "confidence" in table.columns else []) + [F.asc("thread_id")]
    return table.where(F.col("scope_key") == scope_key).orderBy(*order)


def newest_by_scope(table: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` rows a scope in that order: a bounded top-k after no more than one shuffle."""
    order = [F.desc("updated_at")] + ([F.desc("confidence")] if "confidence" in table.columns else []) + [F.asc("thread_id")]
    return table.withColumn("place", F.row_number().over(Window.partitionBy("scope_key").orderBy(*order))).where(F.col("place") <= most)


def record_chunks(chunks: DataFrame, record_id: object) -> DataFrame:
    return chunks.where(F.col("record_id") == record_id).orderBy("seq")


def append_chunks(chunks: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with the new ones numbered on, an entry for each new chunk).

    A record's new chunks follow its last seq in order of their time.
    """
    last = chunks.groupBy("record_id").agg(F.max("seq").alias("last"))
    w = Window.partitionBy("record_id").orderBy("created_at", "id")
    numbered = new.join(last, "record_id", "left").withColumn("seq", (F.coalesce("last", F.lit(0)) + F.row_number().over(w)).cast("int")).drop("last")
    entry = F.concat_ws(":", F.lit("observation"), "record_id", "seq")
    entries = numbered.select("record_id", entry.alias("entry_id"), F.lit("medium").alias("priority"), F.col("observations").alias("text"), "message_ids", F.lit("chunk").alias("origin"), "created_at")
    return chunks.unionByName(numbered.select(*chunks.columns)), entries


def clear_chunks(chunks: DataFrame, through: DataFrame) -> DataFrame:
    """The chunks behind ``through(record_id, seq)``; records that aren't named keep all."""
    cut = through.select("record_id", F.col("seq").alias("upto"))
    return chunks.join(cut, "record_id", "left").where(F.col("upto").isNull() | (F.col("seq") > F.col("upto"))).select(*chunks.columns)


def trace_documents(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trace_id with its JSON document, index rows) of traces."""
    body = F.to_json(F.struct(*[c for c in traces.columns]))
    uri = F.concat(F.lit("ctx://queue/traces/"), F.col("trace_id").cast("string"), F.lit(".json"))
    return traces.select("trace_id", uri.alias("uri"), body.alias("payload")), traces.select("trace_id", uri.alias("uri"), "request_type", "query", "target_uri", "created_at")


def write_traces(traces: DataFrame, folder: str) -> DataFrame:
    """Append trace documents as text files of one JSON value a line, and return their index rows."""
    documents, index = trace_documents(traces)
    documents.select(F.col("payload").alias("value")).write.mode("append").text(folder)
    return index
