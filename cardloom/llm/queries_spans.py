"""Queries on long exact spans that documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .spans import shared_share, span_pairs


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share a run of at least 200 characters."""
    return span_pairs(table(spark, d, "documents"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is shared with others."""
    return shared_share(table(spark, d, "documents"))


QUERIES = {"p9_found": p9_found, "p9_shared": p9_shared}
SQL: dict[str, str] = {}
