"""All registered queries of the engine's own operators with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("retrieval", "documents", "analytics", "state", "memory", "parsing", "streams", "indexing", "search", "versions", "threads", "observations", "evaluation", "writes", "trees")
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> dict[str, tuple[Query, str | None]]:
    for m in MODULES:
        importlib.import_module(f"tessera.plans.{m}")
    return _FOUND


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _load().items() if sql}
