"""The work queue: first-in batches, admission by a budget, the minimum-batch gate and shared contexts."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .store import blocks, number_rows


def fifo_batches(requests: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds ``batch_no``: requests in arrival order in batches of ``size``. Numbers come from ``number_rows``, so no
    task holds the whole queue."""
    return number_rows(requests, order, "queue_no").withColumn("batch_no", F.floor((F.col("queue_no") - 1) / size).cast("long"))


def admit(requests: DataFrame, key: str, queue: str, order: list[str], cost: Column, budget: int, slots: int, slack: int = 1000) -> DataFrame:
    """The requests of each queue that fit at once: a prefix in order whose running cost plus ``slack`` stays within
    ``budget``, at most ``slots`` of them. The head of a queue blocks those behind it. A request that can never fit
    has ``fits_alone`` false instead of blocking for good. ``key`` names a request.

    Only the first ``slots`` requests of a queue can be admitted. Spark takes them in every map task already, so a
    queue with very many requests sends few rows to the running sum.
    """
    costed = requests.withColumn("cost", cost.cast("long")).withColumn("fits_alone", F.col("cost") + slack <= budget)
    w = Window.partitionBy(queue).orderBy(*order)
    head = costed.where("fits_alone").select(key, queue, *[c for c in order if c not in (key, queue)], "cost").withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= slots)
    running = F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = head.withColumn("__run", running).where(F.col("__run") + slack <= budget).select(key, F.lit(True).alias("__taken"))
    return costed.join(taken, key, "left").withColumn("admitted", F.coalesce("__taken", F.lit(False))).drop("__taken")


def room(width: int, in_flight: int) -> int:
    """How many requests may be taken: up to twice the batch width in work at once."""
    return max(0, 2 * width - in_flight)


def next_batch(waiting: DataFrame, order: list[str], width: int, in_flight: int) -> DataFrame:
    """The requests to take now, first in first out: as many as there is room for."""
    return waiting.orderBy(*order).limit(room(width, in_flight))


def _starts(times: np.ndarray, first: int, stop: int, minimum: int, wait: int) -> tuple[list[int], int]:
    """The first arrivals of the groups that begin in ``[first, stop)``, and where the group after them begins."""
    out, at = [], first
    while at < stop:
        out.append(at)
        head = times[at : at + minimum]
        at += int(np.searchsorted(head, head[0] + wait, side="right"))
    return out, at


def gate(arrivals: DataFrame, at: str, tie: str, minimum: int, wait_seconds: int) -> DataFrame:
    """When each request of one queue passes the minimum-batch gate: adds ``group_no`` and ``released_at``.

    Requests wait until there are ``minimum`` of them, and are then released with the last; or until ``wait_seconds``
    have passed since the first of them came, and are then released as they are. The wait starts anew with the next
    arrival. Arrivals at the same moment come one after the other by ``tie``; ``released_at`` is never before ``at``.
    Null times are left out.

    Where a group begins depends on all groups before, but no task reads the whole queue: a group has at most
    ``minimum`` requests, so the first group that begins in a block of the queue begins at one of its first
    ``minimum`` arrivals. Each block tells for every such beginning where the first group of the next block begins;
    these few numbers per block are put together on the driver, and every block then marks its groups alone.
    """
    placed = blocks(arrivals.where(F.col(at).isNotNull()).withColumn("__us", F.unix_micros(F.col(at).cast("timestamp"))), [at, tie])
    ahead = placed.where(F.col("__row") < minimum).select("__block", "__row", "__us").union(placed.groupBy("__block").agg(F.lit(-1).cast("long"), F.count("*")))
    sizes: dict[int, int] = {}
    heads: dict[int, list[int]] = defaultdict(list)
    for block, row, value in sorted(map(tuple, ahead.collect())):  # up to ``minimum`` + 1 numbers a block
        if row < 0:
            sizes[block] = value
        else:
            heads[block].append(value)
    order, wait = sorted(sizes), wait_seconds * 1_000_000
    following: dict[int, list[int]] = {}
    after: list[int] = []
    for block in reversed(order):
        following[block] = after
        after = (heads[block] + after)[:minimum]

    def whole(block: int, rows) -> np.ndarray:
        return np.array([*rows, *following[block]], np.int64)

    def tell(batches):
        for block, rows in _whole(batches):
            times, n = whole(block, rows["__us"]), len(rows)
            told = [_starts(times, first, n, minimum, wait) for first in range(min(minimum, n))]
            yield pd.DataFrame({"block": block, "first": range(len(told)), "next": [k - n for _, k in told], "groups": [len(x) for x, _ in told]})

    steps = {(r.block, r.first): (r.next, r.groups) for r in placed.select("__block", "__us").mapInPandas(tell, "block long, first long, next long, groups long").collect()}
    entry, first, groups = {}, 0, 0
    for block in order:
        entry[block] = (first, groups)
        if first >= sizes[block]:  # a block so short that a group of an earlier one passes over it
            first -= sizes[block]
            continue
        first, more = steps[block, first]
        groups += more

    def mark(batches):
        for block, rows in _whole(batches):
            first, group = entry[block]
            begins = np.zeros(len(rows), np.int64)
            begins[_starts(whole(block, rows["__us"]), first, len(rows), minimum, wait)[0]] = 1
            yield rows.drop(columns=["__block", "__row", "__us"]).assign(group_no=group + np.cumsum(begins) - 1)

    held = placed.drop("__block", "__row", "__us").schema
    marked = placed.mapInPandas(mark, StructType([*held.fields, StructField("group_no", LongType())]))
    group = Window.partitionBy("group_no")  # at most ``minimum`` rows
    expiry = F.min(at).over(group) + F.make_dt_interval(secs=F.lit(wait_seconds))
    return marked.withColumn("released_at", F.when(F.count("*").over(group) == minimum, F.max(at).over(group)).otherwise(expiry))


def _whole(batches):
    """The rows of a task, which are one block; nothing for an empty one."""
    if parts := [b for b in batches if len(b)]:
        rows = pd.concat(parts, ignore_index=True)
        yield int(rows["__block"].iloc[0]), rows


def context_groups(requests: DataFrame, context: str = "extra_context") -> DataFrame:
    """Requests and estimated tokens per shared context; null and empty contexts are one group."""
    return requests.groupBy(F.coalesce(context, F.lit("")).alias("context")).agg(F.count("*").alias("n_requests"), F.sum("n_tokens").alias("n_tokens"))
