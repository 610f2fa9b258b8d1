"""The corpus pipeline: five stages over ``documents``, each one operator of ``tessera.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns that they got.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, mixing, pii, simhash
from tessera.llm.common import fresh, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a learned language is recognised.

    Texts without letters, nulls included, go, and so do those that fit no
    learned language (``langid.floors``). If no row has a language, nothing can
    be told and only texts without letters go. Repeated rows are judged alike.
    """
    models = (langid.floors(docs, m) for m in langid.train(docs))
    first = next(models, None)
    if first is None:
        return docs.where(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    lang, score = fresh(docs, "lang"), fresh(docs, "score")
    return langid.identify(docs, chain([first], models), (lang, score)).where(F.col(lang) != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component, the one with the smallest id; a row is a document."""
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null and empty texts hold none."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind, and bring ``n_chars`` up to date; null texts keep theirs."""
    out = pii.redacted(docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the mix takes, with how often it takes them in ``repeats``, in place of a column of that name."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
]

#: SQL can't train or score the classifiers; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every result but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
