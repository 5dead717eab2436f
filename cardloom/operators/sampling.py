"""Sampling filters over logits: top-k, top-p, min-p, temperature, greedy and a seeded draw, one window per step."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _step(keys: list[str]) -> Window:
    return Window.partitionBy(*keys)


def ranked(logits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``rank`` by falling logit, ties by token id. The candidates of a step are a vocabulary at most."""
    return logits.withColumn("rank", F.row_number().over(_step(keys).orderBy(F.desc("logit"), "token_id")))


def softmax(logits: DataFrame, keys: list[str], temperature: float = 1.0) -> DataFrame:
    """Adds ``p``: the probabilities of what is left of each step."""
    scaled = F.exp((F.col("logit") - F.max("logit").over(_step(keys))) / temperature)
    weighed = logits.withColumn("__w", scaled)
    return weighed.withColumn("p", F.col("__w") / F.sum("__w").over(_step(keys))).drop("__w")


def top_k(logits: DataFrame, keys: list[str], k: int = 40) -> DataFrame:
    return ranked(logits, keys).where(F.col("rank") <= k).drop("rank")


def top_p(logits: DataFrame, keys: list[str], p: float = 0.9) -> DataFrame:
    """Keeps the likeliest tokens while the sum of those before is below ``p``; at least one."""
    before = F.sum("p").over(_step(keys).orderBy(F.desc("logit"), "token_id").rowsBetween(Window.unboundedPreceding, -1))
    return softmax(logits, keys).withColumn("__before", F.coalesce(before, F.lit(0.0))).where(F.col("__before") < p).drop("__before", "p")


def min_p(logits: DataFrame, keys: list[str], p: float = 0.1) -> DataFrame:
    """Keeps tokens with at least ``p`` times the probability of the likeliest: a difference of logits, so nothing has
    to be summed."""
    top = F.max("logit").over(_step(keys))
    return logits.withColumn("__top", top).where(F.col("logit") >= F.col("__top") + math.log(p)).drop("__top")


def typical(logits: DataFrame, keys: list[str], p: float = 1.0) -> DataFrame:
    """Keeps the tokens whose surprise is nearest to the expected one until their probabilities sum to ``p``; all at 1,
    at least one always. Ties by token id."""
    if p >= 1:
        return logits
    weighed = softmax(logits, keys).withColumn("__s", -F.log("p"))
    weighed = weighed.withColumn("__d", F.round(F.abs(F.col("__s") - F.sum(F.col("p") * F.col("__s")).over(_step(keys))), 12))
    before = F.sum("p").over(_step(keys).orderBy("__d", "token_id").rowsBetween(Window.unboundedPreceding, -1))
    return weighed.withColumn("__before", F.coalesce(before, F.lit(0.0))).where(F.col("__before") < p).drop("__before", "__s", "__d", "p")


def until_stop(tokens: DataFrame, key: str, stops: list[str]) -> DataFrame:
    """``key, n_tokens, stopped``: how many tokens come before the first stop token, and whether there is one. A partial
    aggregate: no order is needed to find the first."""
    first = F.min(F.when(F.col("token").isin(stops), F.col("idx")))
    return tokens.groupBy(key).agg(F.coalesce(first, F.count("*").cast("int")).alias("n_tokens"), first.isNotNull().alias("stopped"))


def greedy(logits: DataFrame, keys: list[str]) -> DataFrame:
    """The likeliest token of each step: an aggregate without a sort."""
    best = F.max(F.struct("logit", (-F.col("token_id")).alias("t"))).alias("best")
    return logits.groupBy(*keys).agg(best).select(*keys, (-F.col("best.t")).alias("token_id"), F.col("best.logit").alias("logit"))


def draw(logits: DataFrame, keys: list[str], temperature: float = 0.6, seed: int = 0) -> DataFrame:
    """One token of each step with the softmax probabilities: the greatest logit plus seeded Gumbel noise."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), *keys, "token_id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    noisy = logits.withColumn("__score", F.col("logit") / temperature - F.log(-F.log(unit)))
    best = F.max(F.struct("__score", (-F.col("token_id")).alias("t"))).alias("best")
    return noisy.groupBy(*keys).agg(best).select(*keys, (-F.col("best.t")).alias("token_id"))


def sample(logits: DataFrame, keys: list[str], banned: Column | None = None, k: int = 40, p: float = 0.9, least: float = 0.1, temperature: float = 0.6, seed: int = 0, typical_p: float = 1.0) -> DataFrame:
    """The whole chain: bans, top-k, typical, top-p, min-p, temperature and draw; greedy if the temperature is 0."""
    left = logits if banned is None else logits.where(~banned)
    if temperature <= 0:
        return greedy(left, keys).select(*keys, "token_id")
    return draw(min_p(top_p(typical(top_k(left, keys, k), keys, typical_p), keys, p), keys, least), keys, temperature, seed)
