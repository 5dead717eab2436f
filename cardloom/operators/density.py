"""Density of cards: counts per chunk, percentile thresholds and intensity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 4


def card_counts(chunks: DataFrame, cards: DataFrame) -> DataFrame:
    """``file_id, chunk_id, flash_card_count``: 0 for a chunk without cards. Exact repeats of a row count once.

    The cards are counted per chunk before they meet the chunks: a chunk that holds a large part of all cards is one
    row by then, and the join carries one row per chunk.
    """
    per_chunk = cards.where("origin_id is not null").select("id", "origin_id").distinct().groupBy(F.col("origin_id").alias("chunk_id")).agg(F.count("*").alias("n"))
    unique = chunks.select("file_id", F.col("id").alias("chunk_id")).distinct()
    return unique.join(per_chunk, "chunk_id", "left").select("file_id", "chunk_id", F.coalesce("n", F.lit(0)).alias("flash_card_count"))


def thresholds(counts: DataFrame, column: str = "flash_card_count") -> DataFrame:
    """One row with ``limits``: the values at 20, 40, 60 and 80 % of the sorted non-zero counts, at the 0-based index
    max(0, floor(n * share) - 1). Null without non-zero counts.

    Only the distribution (a row per different count) is sorted, never the counts themselves.
    """
    spread = counts.where(F.col(column) > 0).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = spread.agg(F.sum("n").alias("total"))
    order = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = spread.withColumn("upto", F.sum("n").over(order)).crossJoin(F.broadcast(total))
    at = [F.min(F.when(F.col("upto") > F.greatest(F.lit(0), F.floor(F.col("total") * (i * F.lit(0.2))) - 1), F.col("value"))) for i in range(1, LEVELS + 1)]
    return ranked.agg(*[x.alias(f"p{i + 1}") for i, x in enumerate(at)]).select(F.when(F.col("p1").isNotNull(), F.array(*[f"p{i + 1}" for i in range(LEVELS)])).alias("limits"))


def intensity(counts: DataFrame, column: str = "flash_card_count") -> DataFrame:
    """Adds ``intensity`` 0-5: 0 for 0, else the number of the first threshold not below the count, 5 beyond all."""
    level = F.when(F.col(column) == 0, 0)
    for i in range(LEVELS):
        level = level.when(F.col(column) <= F.get("limits", F.lit(i)), i + 1)
    return counts.crossJoin(F.broadcast(thresholds(counts, column))).withColumn("intensity", level.otherwise(LEVELS + 1)).drop("limits")
