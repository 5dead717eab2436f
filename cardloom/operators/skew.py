"""Joins that survive a hot key: the few keys that hold a large part of the rows are joined by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A key is hot when it holds more than one row in HOT_SHARE of the left side, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 200


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE, least: int = 1000) -> DataFrame:
    """Keys with more than 1/``share`` of all rows (and more than ``least``): by counting at most ``share`` keys."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).where((F.col("_n") * share > F.col("_total")) & (F.col("_n") > least)).select(key)


def skew_left_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Left or inner join on one column where ``right`` has at most one row per key.

    The rows of hot keys meet their right rows by broadcast: fewer than ``HOT_SHARE`` keys, each with at most one
    right row, so the broadcast side is bounded whatever the data. All other rows use a normal shuffle join. The hot
    keys are counted once and written down, as both sides of the union and the right table ask for them.
    """
    hot = F.broadcast(cut(hot_keys(left.select(key), key)))
    tagged = left.join(hot.withColumn("_hot", F.lit(True)), key, "left")
    cold_part = tagged.where(F.col("_hot").isNull()).drop("_hot").join(right, key, how)
    hot_right = right.join(hot, key, "left_semi")
    hot_part = tagged.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot_right), key, how)
    return cold_part.unionByName(hot_part)
