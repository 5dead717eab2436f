"""Burst rates: tokens per second of each run of work, starting anew after a pause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def burst_rates(events: DataFrame, key: str, at: str, tokens: str, gap: str) -> DataFrame:
    """``key, started_at, ended_at, n_tokens, tokens_per_second`` of each session; null rate for a single moment or no
    tokens. On a stream the same call needs ``withWatermark`` on ``at`` before it."""
    told = events.groupBy(key, F.session_window(at, gap)).agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.sum(tokens).alias("n_tokens"))
    seconds = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("ended_at")) / 1_000_000
    rate = F.when((seconds > 0) & (F.col("n_tokens") > 0), F.round(F.col("n_tokens") / seconds, 6))
    return told.select(key, "started_at", "ended_at", "n_tokens", rate.alias("tokens_per_second"))
