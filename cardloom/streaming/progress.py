"""Streams: the gate in front of the model, progress of generated text, and status pushes."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.queue import room
from ..operators.store import number_rows
from ..session import cut

DONE = "Processing complete"


def live_progress(events: DataFrame, timeout_ms: int = 5000) -> DataFrame:
    """Text of each item while it grows: ``chunk_id, text, status``, in update mode.

    ``events`` is a stream of ``chunk_id long, seq long, token string, rewind_chars int, status string``. An event
    first takes back ``rewind_chars`` characters, then appends its token; a sequence number counts once, and after
    the final status nothing is appended. The state of an item goes ``timeout_ms`` after its last event. State is one
    short text per live item.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        text, last, status = state.get if state.exists else ("", -1, "")
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"chunk_id": [key[0]], "text": [text], "status": ["Removed"]})
            return
        for pdf in batches:
            for _, seq, token, rewind, said in pdf.sort_values("seq")[["chunk_id", "seq", "token", "rewind_chars", "status"]].itertuples(index=False, name=None):
                if seq <= last or status == DONE:
                    continue
                text, last, status = text[: max(0, len(text) - (rewind or 0))] + (token or ""), seq, said or ""
        state.update((text, last, status))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"chunk_id": [key[0]], "text": [text], "status": [status]})

    return events.groupBy("chunk_id").applyInPandasWithState(fold, "chunk_id long, text string, status string", "text string, last long, status string", "update", GroupStateTimeout.ProcessingTimeTimeout)


class Gate:
    """Holds the requests of a stream back until there are ``minimum`` of them or ``wait_seconds`` have passed since the
    first; used as ``foreachBatch``.

    What waits lies in the folder ``pending``, each part under the number of its micro-batch and the time it came, so a
    new ``Gate`` on the same folder goes on where a lost driver stopped, with the wait as it was. At most twice
    ``width`` requests may be in work: ``in_flight`` tells how many are, and ``release`` gets as many as there is room
    for, in the order of ``order``; the rest waits on. A release that a crash cuts short is made once more.
    ``watch`` looks for expired waits by itself, so the last small group leaves without a new arrival.
    """

    def __init__(self, pending: str, release: Callable[[DataFrame], None], minimum: int, wait_seconds: float, clock: Callable[[], float] = time.time, order: tuple[str, ...] = (), width: int = 1 << 30, in_flight: Callable[[], int] = lambda: 0):
        self.pending, self.release, self.minimum, self.wait, self.clock = pending, release, minimum, wait_seconds, clock
        self.order, self.width, self.in_flight = order, width, in_flight
        self.lock = threading.RLock()
        self.since: float | None = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        with self.lock:
            spark = batch.sparkSession
            if not any(n == number for n, _, _ in self.parts(spark)):  # a batch that comes again is there already
                self._put(batch, number)
            self.poll(spark)

    def _put(self, rows: DataFrame, number: int) -> None:
        # a name of its own: what is left of a part is written before the part is deleted
        rows.write.mode("overwrite").parquet(f"{self.pending}/part-{number}-{int(self.clock() * 1000)}-{uuid4().hex}")

    def parts(self, spark: SparkSession) -> list[tuple[int, float, str]]:
        """Number, time and path of all that waits, in order; parts that were not written to their end do not count."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.pending)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            name = status.getPath().getName().split("-")
            if name[0] == "part" and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append((int(name[1]), int(name[2]) / 1000, status.getPath().toString()))
        return sorted(found)

    def poll(self, spark: SparkSession) -> bool:
        """Releases what waits if it is due; says whether it did."""
        with self.lock:
            parts = self.parts(spark)
            parts = [p for p in parts if not spark.read.parquet(p[2]).isEmpty()]
            free = room(self.width, self.in_flight())
            if not parts or not free:
                return False
            self.since = min(at for _, at, _ in parts)
            waiting = spark.read.parquet(*[path for *_, path in parts])
            if waiting.limit(self.minimum).count() < self.minimum and self.clock() - self.since <= self.wait:
                return False
            if self.width < 1 << 30:
                numbered = cut(number_rows(waiting, list(self.order), "__n"))
                self.release(numbered.where(F.col("__n") <= free).drop("__n"))
                rest = numbered.where(F.col("__n") > free).drop("__n")
                if not rest.isEmpty():
                    self._put(rest, parts[-1][0])  # the wait starts anew
            else:
                self.release(waiting)
            fs = spark._jvm.org.apache.hadoop.fs.Path(self.pending).getFileSystem(spark._jsc.hadoopConfiguration())
            for *_, path in parts:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
            self.since = None
            return True

    def watch(self, spark: SparkSession, stop: threading.Event, every: float = 1.0) -> threading.Thread:
        """Polls in a thread of its own until ``stop`` is set."""

        def run():
            while not stop.wait(every):
                self.poll(spark)

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread


def status_counts(work: DataFrame) -> DataFrame:
    """Processed and remaining items, tokens and tokens per second: what a status push carries. ``work`` has ``status,
    n_cards, n_tokens, at``; the rate is null for a single moment or without tokens."""
    total = F.coalesce(F.sum("n_tokens"), F.lit(0))
    seconds = F.timestamp_diff("MICROSECOND", F.min("at"), F.max("at")) / 1_000_000
    return work.agg(
        F.count_if(F.col("n_cards") > 0).alias("processed"), F.count_if(F.col("status") == "Queued").alias("remaining"), total.alias("total_tokens"),
        F.when((seconds > 0) & (total > 0), F.round(total / seconds, 6)).alias("tokens_per_second"),
    )


def work_list(work: DataFrame) -> DataFrame:
    """The items in work as a push names them: all that are not queued."""
    return work.where("status <> 'Queued'").select("id", "status", "response", "rewind_chars")


def push_status(work: DataFrame, send: Callable[[dict], None], checkpoint: str, interval: str = "1 second", items: Callable[[], list[dict]] = list):
    """Starts a query that sends the counts of all work so far after every micro-batch, with the items in work."""

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.collect():  # one row
            send({**row.asDict(), "items": items()})

    return status_counts(work).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(each).start()
