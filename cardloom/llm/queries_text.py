"""Queries on single texts: pieces of oversized chunks, markup residue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .markup import cleaned, markup_kinds
from .pieces import oversized_pieces


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks over the limit: those that came out as pieces."""
    return oversized_pieces(table(spark, d, "text_chunks")).where("piece = 0").select("id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of the chunks over the limit."""
    return oversized_pieces(table(spark, d, "text_chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of markup in each chunk."""
    return markup_kinds(table(spark, d, "text_chunks"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk without its markup."""
    return cleaned(table(spark, d, "text_chunks"))


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean, "p1_found": p1_found, "p1_pieces": p1_pieces}
SQL = {
    # strlen counts UTF-8 bytes; a character has 2 UTF-16 units exactly when it has 4 UTF-8 bytes
    "p1_found": "SELECT DISTINCT id FROM text_chunks WHERE (length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) // 4 > 700",
}
