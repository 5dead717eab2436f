"""Queries on token ids and on mixtures measured in tokens. SQL has no BPE, so tests compare with public encoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .bpe import encode_column
from .mixture import mix


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document in byte_bpe_50k."""
    return encode_column(table(spark, d, "documents"), ["doc_id"], "text", "ids")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in the largest mixture of ``source_targets`` in which every share is reached."""
    return mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached share of each source in it."""
    return mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p8_mixture_full(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of as many tokens as the listed sources have; sources too small for their share fall short."""
    return mix(table(spark, d, "documents"), table(spark, d, "source_targets"), strict=False)[0]


def p8_shares_full(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached share of each source in that."""
    return mix(table(spark, d, "documents"), table(spark, d, "source_targets"), strict=False)[1]


QUERIES = {"p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_mixture_full": p8_mixture_full, "p8_shares_full": p8_shares_full}
SQL: dict[str, str] = {}
