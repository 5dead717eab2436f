"""Queries on question-answer cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..session import table
from .defects import cut_share, defects, truncated
from .nearcopies import near_copy_groups, near_copy_pairs


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective cards with their defect."""
    return defects(table(spark, d, "flash_cards"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Number of defective cards per preset and defect."""
    cards = table(spark, d, "flash_cards")
    presets = cards.groupBy("id").agg(F.first("preset", ignorenulls=True).alias("preset"))
    return defects(cards).join(presets, "id").groupBy("preset", "defect").agg(F.count("*").alias("n_cards"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Cards whose answer stops before its end."""
    return truncated(table(spark, d, "flash_cards"))


def p6_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut answers per preset."""
    return cut_share(table(spark, d, "flash_cards"), "preset")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cards whose words are at least 0.7 the same."""
    return near_copy_pairs(table(spark, d, "flash_cards"), ["question", "answer"])


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class and number of near copies of each card."""
    return near_copy_groups(table(spark, d, "flash_cards"), ["question", "answer"])


QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p6_found": p6_found, "p6_share": p6_share, "p5_found": p5_found, "p5_groups": p5_groups}
SQL: dict[str, str] = {}
