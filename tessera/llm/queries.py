"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_digests

    return secret_digests(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out_scores

    return held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import audio_digests

    return audio_digests(table(spark, sf_dir, "documents"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeat_digests

    return repeat_digests(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out_identify

    return held_out_identify(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_digests

    return personal_digests(table(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dialogues import repair_digests

    return repair_digests(table(spark, sf_dir, "conversations"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import infill_digests

    return infill_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_secrets, op3_toxicity, op4_audio, op5_suffixes, op6_mixing, op7_langid, op8_pii, op9_decontam, op10_tokens, op11_vectors, op12_dialogues, op13_infill)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL for those that it can express; the others are tested against brute force, round trips or held-out rows."""
    from . import oracle

    return oracle.oracle_sql()
