"""Streaming queries, checked against their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.streaming import outbox as S

from .registry import query, table


@query("SELECT user_id, max_by(event_type, event_id) AS last_type, max(event_id) AS last_event, count(*) AS events FROM events GROUP BY user_id")
def q_stream_outbox_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each user, by a stream over the event files."""
    schema = table(spark, sf_dir, "events").schema
    return S.fold_stream(spark, f"{sf_dir}/events.parque[t]", schema)
