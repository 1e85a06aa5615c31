"""All registered queries of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import memory_queries, session_queries, source_queries  # noqa: F401  register their queries
from .plans.queries import QUERIES, SQL, recall_topk_conversations


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall_topk_conversations(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
