"""The outbox as a stream: events fold into the latest state of each key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import drop_at_exit, shared_dir


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The latest status of each key, and how many distinct events it has had."""
    return events.groupBy(key).agg(F.max_by("event_type", order).alias("last_type"), F.max(order).alias("last_event"), F.count("*").alias("events"))


def fold_stream(spark: SparkSession, folder: str, schema: str, key: str = "user_id", order: str = "event_id", files_a_batch: int = 4, name: str | None = None, time: str | None = None, late: str = "1 day") -> DataFrame:
    """Replay a folder of event files through Structured Streaming and return the folded state.

    Repeated event ids are dropped by the stream's state; with a ``time`` column
    they are forgotten once the watermark, ``late`` behind the newest event, has passed
    them, which bounds the state. Each micro-batch writes its partial maxima
    under its number, so one that is run again replaces itself, and reading
    folds those. Checkpoint and output are in the shared folder under
    ``name``: a second call with the same name reads only what is new since
    the first. Without a name the fold begins anew.
    """
    base = f"{shared_dir(spark)}/outbox-{name or uuid.uuid4().hex}"
    if name is None:
        drop_at_exit(spark, base)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").parquet(folder)
    source = source.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([order]) if time else source.dropDuplicates([order])

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(f"{base}/out")
    return parts.groupBy(key).agg(F.max_by("last_type", "last_event").alias("last_type"), F.max("last_event").alias("last_event"), F.sum("events").alias("events"))
