"""Running sums and sequential batches of keys of any size, without one task for a key.

Rows are sorted by range, so a large key lies in several partitions. Sums run within a key's part of a
partition, and a few rows for each of these parts carry the totals on. A batch is full
where the running sum passes a bound, so the start of the batch behind one that starts at a row is
found by a search in the running sums: the part by its last sum, the row within the part. Following these
jumps from a key's first row gives the batches; pointer doubling needs a number of
joins that goes with the logarithm of the number of batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import drop_at_exit, shared_dir


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: numbers of rows hold from here on."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, a number that grows with key and order; the partition's number is in its upper bits."""
    salt = F.monotonically_increasing_id()  # equal rows are dealt over partitions
    by = rows.withColumn("__salt", salt).repartitionByRange(key, *order, "__salt").sortWithinPartitions(key, *order, "__salt")
    return _kept(by.withColumn("place", F.monotonically_increasing_id()).drop("__salt"), "placed")


def running(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``rows(key, place)`` with the sum of ``value`` so far in the column ``name``, nulls as 0."""
    part = F.shiftright("place", 33)
    own = rows.withColumn("__part", part).withColumn("__v", F.coalesce(value, F.lit(0)).cast("long"))
    totals = own.groupBy(key, "__part").agg(F.sum("__v").alias("t"))
    earlier = F.coalesce(F.sum("t").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = totals.select(F.col(key).alias("__k"), F.col("__part").alias("__p"), earlier.alias("__before"))  # a row for each part of a key
    met = own.join(offset, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")))
    inside = F.sum("__v").over(Window.partitionBy(key, "__part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return met.select(*[c for c in rows.columns if c != name], (F.col("__before") + inside).alias(name))


def _first_over(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """``(at, next)``: for each of ``probes(k, at, bound)`` the first place of ``rows(k, place, run)`` whose running sum is over the bound, null if none is."""
    parts = rows.groupBy("k", F.shiftright("place", 33).alias("part")).agg(F.max("run").alias("last"))
    listed = parts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "last"))).alias("parts"))  # a few numbers for each part
    aimed = probes.join(listed.withColumnRenamed("k", "lk"), F.col("k").eqNullSafe(F.col("lk"))).select("k", "at", "bound", F.get(F.filter("parts", lambda p: p["last"] > F.col("bound")), F.lit(0))["part"].alias("part"))
    both = rows.select("k", F.shiftright("place", 33).alias("part"), F.col("run").alias("v"), "place", F.lit(None).cast("long").alias("at"))
    both = both.unionByName(aimed.where("part is not null").select("k", "part", F.col("bound").alias("v"), F.lit(None).cast("long").alias("place"), "at"))
    # behind the rows of its own value, a probe looks ahead to the next row
    ahead = Window.partitionBy("k", "part").orderBy("v", F.col("at").isNotNull().cast("int"), F.coalesce("place", "at")).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("next", F.first("place", ignorenulls=True).over(ahead)).where("at is not null").select("at", "next")
    return found.unionByName(aimed.where("part is null").select("at", F.lit(None).cast("long").alias("next")))


def batches(rows: DataFrame, key: str, order: list[str], tokens: str, most: int) -> DataFrame:
    """``rows`` with ``batch`` from 0: a row opens a new batch where the batch before it holds something and would pass ``most``.

    Null and negative token counts are 0. Rows that ``order`` leaves equal come in any order.
    """
    kept = [c for c in rows.columns if c not in ("batch", "place")]
    own = placed(rows.select(*kept), key, order)
    size = F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long")
    sums = _kept(running(own.select(F.col(key).alias("k"), "place", size.alias("n")), "k", F.col("n"), "run"), "sums")
    before = F.col("run") - F.col("n")
    # the row that passes the bound; if it is the first one that holds anything, the row behind it
    over = _first_over(sums, sums.select("k", F.col("place").alias("at"), (before + most).alias("bound")))
    filled = _first_over(sums, sums.select("k", F.col("place").alias("at"), before.alias("bound"))).withColumnRenamed("next", "some")
    behind = _first_over(sums.withColumn("run", F.col("place")).select("k", "place", "run"), sums.select("k", F.col("place").alias("at"), F.col("place").alias("bound"))).select(F.col("at").alias("here"), F.col("next").alias("behind"))
    jumps = over.join(filled, "at").join(behind, F.col("some") == F.col("here"), "left").select(F.col("at").alias("a"), F.when(F.col("next") == F.col("some"), F.col("behind")).otherwise(F.col("next")).alias("b")).where("b is not null")
    jumps = _kept(jumps, "jumps")
    starts = _kept(sums.groupBy("k").agg(F.min("place").alias("place")).select("place"), "starts")
    while True:  # after round i all starts that 2 ** i - 1 jumps reach are known
        new = starts.join(jumps, F.col("place") == F.col("a")).select(F.col("b").alias("place"))
        grown = _kept(starts.unionByName(new).distinct(), "starts")
        if grown.count() == starts.count():
            break
        starts = grown
        jumps = _kept(jumps.join(jumps.select(F.col("a").alias("c"), F.col("b").alias("d")), F.col("b") == F.col("c")).select("a", F.col("d").alias("b")), "jumps")
    marked = sums.select("k", "place").join(starts.withColumn("first", F.lit(1)), "place", "left")
    numbered = running(marked, "k", F.col("first"), "batch").select(F.col("place").alias("p"), (F.col("batch") - 1).cast("int").alias("batch"))
    return own.join(numbered, F.col("place") == F.col("p")).select(*kept, "batch")
