"""Mixing sources to target shares of all tokens: subset-sum budget fitting over exact document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .bpe import TOKENIZERS, encode_column

#: Tokens left to exact subset-sum fitting at first, and the most it is widened to where that does not reach the budget.
EXACT_WINDOW, WIDEST_WINDOW = 1 << 12, 1 << 22
SEED = 17


def _reach(sizes: np.ndarray, left: np.ndarray, target: int) -> tuple[np.ndarray, int]:
    """How many of each size make the largest sum up to ``target``, and that sum: a bounded knapsack.

    Counts are split into powers of two. Sizes come in a seeded order, not the longest first, as the search ends with the
    first sizes that meet the target and these should not all be long. For each sum the item that reached it first is kept; the sum before it was
    reached by earlier items, so following these back uses every item once.
    """
    first = np.full(target + 1, -1, np.int32)
    reached = np.zeros(target + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in np.random.default_rng(SEED).permutation(np.argsort(sizes)):
        if not left[i]:
            continue
        rest, step = min(int(left[i]), target // int(sizes[i])), 1
        while rest > 0:
            n = min(step, rest)
            weight = n * int(sizes[i])
            new = reached[: target + 1 - weight] & ~reached[weight:]
            first[weight:][new] = len(items)
            reached[weight:] |= new
            items.append((int(i), n))
            rest, step = rest - n, step * 2
        if reached[target]:
            break
    total = at = int(np.flatnonzero(reached)[-1])
    taken = np.zeros(len(sizes), np.int64)
    while at:
        i, n = items[first[at]]
        taken[i] += n
        at -= n * int(sizes[i])
    return taken, total


def fit_subset(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = EXACT_WINDOW) -> np.ndarray:
    """How many documents of each size to take so that their sizes sum to ``budget`` or as little below as possible.

    The same proportion of the documents is taken all along the sizes for all of the budget but a window, however few
    documents one size has; the window is filled by a bounded knapsack over what is left of every size. If that does not
    meet the budget (or the nearest multiple of the sizes' common divisor below it, which nothing can pass) the window is
    widened, up to the whole budget: the result is the optimum for budgets up to ``WIDEST_WINDOW`` tokens, and beyond
    wherever it meets the budget.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    step = int(np.gcd.reduce(sizes[counts > 0]))
    # budgets count in units of the common divisor
    sizes, budget, total = sizes // step, budget // step, total // step
    window = max(window, 2 * int(sizes[counts > 0].max()))
    by_size = np.argsort(-sizes)
    while True:
        # one share of the running count, longest first: lengths that one document has get their turn too, and the sum
        # stays below the share by less than the longest length
        upto = (np.cumsum(counts[by_size]).astype(object) * max(0, budget - window) // total).astype(np.int64)
        even = np.zeros_like(counts)
        even[by_size] = np.diff(upto, prepend=0)
        rest = budget - int((sizes * even).sum())
        taken, reached = _reach(sizes, counts - even, rest)
        if reached == rest or window >= budget or 4 * window > WIDEST_WINDOW:
            return even + taken
        window *= 4


def _plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per document size of one source: copies of every document, and how many documents get one copy more.

    Documents are repeated evenly; only where that misses the budget some sizes are repeated more than others.
    """
    sizes, counts = pdf["n_tokens"].to_numpy(), pdf["n_documents"].to_numpy()
    budget, most, total = int(pdf["budget_tokens"].iloc[0]), int(pdf["max_repeats"].iloc[0]), int((sizes * counts).sum())
    base = min(budget // total, most)
    rest, more = budget - base * total, np.zeros_like(counts)
    for repeats in sorted({1, most - base}) if base < most else ():
        tried = fit_subset(sizes, counts * repeats, rest)
        if (sizes * tried).sum() > (sizes * more).sum():
            more = tried
    return pd.DataFrame({"source": pdf["source"], "n_tokens": sizes, "base": base + more // counts, "extra": more % counts, "budget_tokens": budget, "used_tokens": sizes * (base * counts + more)})


def budgets(sized: DataFrame, targets: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Document counts by source and exact length, and each source's budget.

    With ``strict`` the whole is the largest number of tokens at which no source that has any falls short of its share
    with all its repeats, so all shares are reached. Without it the whole is as many tokens as the listed sources have
    together: larger, but sources that are too small for it give all they may and fall short.
    """
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    lengths = sized.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("n_documents"))
    held = lengths.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_documents")).alias("held_tokens"), F.sum("n_documents").alias("held_documents"))
    per_source = wanted.join(held, "source", "left").fillna(0, ["held_tokens", "held_documents"])
    if strict:
        whole = F.min(F.when((F.col("target_share") > 0) & (F.col("held_tokens") > 0), F.floor(F.col("held_tokens") * F.col("max_repeats") / F.col("target_share"))))
    else:
        whole = F.sum("held_tokens")
    whole = F.coalesce(whole, F.lit(0))
    total = per_source.agg(whole.alias("whole_tokens"))
    per_source = per_source.crossJoin(F.broadcast(total)).withColumn("budget_tokens", F.round(F.col("target_share") * F.col("whole_tokens")).cast("long"))
    return lengths, per_source


def mix(documents: DataFrame, targets: DataFrame, strict: bool = True, seed: int = SEED, tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The mixture (``doc_id``, ``source``, ``n_tokens``, ``copies``) and the shares really reached.

    See ``budgets`` for ``strict``. A source whose share needs more than ``max_repeats`` copies of all it has gives
    those and falls short; the report says so. Documents without tokens (null, empty) and sources that are not listed are left out; a listed source
    without documents reaches 0. Which documents of one length get the extra copy follows a seeded hash of the id, so
    the result is the same in every run. The documents of one length may be very many: they are counted in 256
    buckets of that hash, and only the one bucket in which the choice ends is ordered.
    """
    names = targets.where("source is not null").select("source").distinct()
    sized = cut(encode_column(documents.join(names, "source", "left_semi"), ["doc_id", "source"], "text", "n_tokens", counts=True, tokenizers=tokenizers))
    lengths, per_source = budgets(sized, targets, strict)
    plan = cut(
        lengths.join(per_source.select("source", "max_repeats", "budget_tokens"), "source")
        .groupBy("source")
        .applyInPandas(_plan_source, "source string, n_tokens long, base long, extra long, budget_tokens long, used_tokens long")
    )
    drawn = sized.where("n_tokens > 0").withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.shiftrightunsigned("draw", 56))
    by_bucket = drawn.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    quota = (
        by_bucket.withColumn("before", F.coalesce(before, F.lit(0)))
        .join(plan, ["source", "n_tokens"])
        .select("source", "n_tokens", "bucket", "base", "n", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("quota"))
    )
    placed = drawn.join(quota, ["source", "n_tokens", "bucket"])
    whole = placed.where("quota = 0 or quota = n").withColumn("copies", F.col("base") + (F.col("quota") > 0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "bucket").orderBy("draw", "doc_id"))
    parted = placed.where("quota > 0 and quota < n").withColumn("copies", F.col("base") + (rank <= F.col("quota")).cast("long"))
    columns = ["doc_id", "source", "n_tokens", "copies"]
    mixture = whole.select(columns).unionByName(parted.select(columns)).where("copies > 0")
    used = plan.groupBy("source").agg(F.sum("used_tokens").alias("used_tokens"))
    report = per_source.join(used, "source", "left").fillna(0, ["used_tokens"])
    everything = report.agg(F.sum("used_tokens").alias("all_tokens"))
    shares = report.crossJoin(F.broadcast(everything)).select(
        "source", "target_share", "max_repeats", "held_documents", "held_tokens", "budget_tokens", "used_tokens",
        F.when(F.col("all_tokens") > 0, F.col("used_tokens") / F.col("all_tokens")).otherwise(0.0).alias("reached_share"),
        (F.col("budget_tokens") - F.col("used_tokens")).alias("short_tokens"),
    )
    return mixture, shares
