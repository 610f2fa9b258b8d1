"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_dir


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    name = "__" + name
    while name in df.columns:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    This cuts lineage and survives lost executors: a later failure rereads the
    files instead of running the whole plan again. Results read the files, so
    they stay until ``clear`` is called or the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that ``stored`` has written in this process.
_WRITTEN: list[str] = []


def clear(spark: SparkSession) -> None:
    """Remove what ``stored`` has written in this process; call it when all results are written elsewhere."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def crc_of(column: Column | str) -> Column:
    """crc32 of a value's text; nulls count as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def unit_hash(column: Column | str, salt: str) -> Column:
    """A reproducible number in [0, 1) from a value's text."""
    c = F.col(column) if isinstance(column, str) else column
    h = F.xxhash64(F.coalesce(c.cast("string"), F.lit("")), F.lit(salt))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_rows_by_hash(df: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """At most ``n`` rows, a reproducible random choice by the hash of ``key``.

    Only for samples whose bound is a documented parameter: the top-n keeps n
    rows a partition and n on the last task.
    """
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.col(key)).limit(n)


#: One finding in a text; sorted, findings go by start, then by their kind's place in the list of kinds.
FINDING = "struct<start:int,rank:int,end:int,kind:string,base:boolean,score:double>"


def span_columns(findings: Column, kinds: list[str]) -> list[Column]:
    """``n_<kind>`` and ``base_sha256`` of the base findings, ``spans`` of all.

    ``findings`` is a sorted array of ``FINDING``. Spans are written
    kind:start:end and joined by commas, in code points, end exclusive.
    """
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter(findings, lambda x: x["base"])
    of = lambda k: F.size(F.filter(base, lambda x: x["kind"] == F.lit(k)))
    counts = [of(k).cast("long").alias(f"n_{k}") for k in kinds]
    sha = F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256)
    return [*counts, sha.alias("base_sha256"), F.array_join(F.transform(findings, text), ",").alias("spans")]


def score_column(findings: Column) -> Column:
    """``scores`` of all findings, in thousandths, in the order of ``spans``."""
    return F.array_join(F.transform(findings, lambda x: F.round(x["score"] * 1000).cast("int").cast("string")), ",").alias("scores")
