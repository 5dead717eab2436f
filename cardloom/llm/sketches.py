"""Counts over a whole collection in arrays of fixed length: each task counts its rows, the arrays are added up."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
COUNTS = "kind int, chunk int, counts binary"
#: Arrays that are merged at once.
FAN_IN = 64


def chunks(counts: np.ndarray, kind: int) -> pd.DataFrame:
    """An array of counts of one task as rows of COUNTS."""
    parts = [counts[i : i + CHUNK] for i in range(0, len(counts), CHUNK)]
    return pd.DataFrame({"kind": kind, "chunk": range(len(parts)), "counts": [zlib.compress(p.astype(np.int64).tobytes(), 1) for p in parts]})


def bit_chunks(bits: np.ndarray, kind: int = 0) -> pd.DataFrame:
    """A bit array of one task as rows of COUNTS."""
    parts = [bits[i : i + 8 * CHUNK] for i in range(0, len(bits), 8 * CHUNK)]
    return pd.DataFrame({"kind": kind, "chunk": range(len(parts)), "counts": [zlib.compress(np.packbits(p).tobytes(), 1) for p in parts]})


def _merged(counted: DataFrame, dtype: type, combine: np.ufunc, finish: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """The arrays of all tasks combined, by kind.

    A tree: groups of FAN_IN tasks are combined first, then groups of these, so that no task ever reads more than FAN_IN
    arrays of one chunk, however many tasks there are. ``finish`` is applied to the whole chunks before they go to the
    driver, which gets as many bytes for any input: the length of the arrays is fixed.
    """

    def merge(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.frombuffer(zlib.decompress(pdf["counts"].iloc[0]), dtype).copy()
            for packed in pdf["counts"].iloc[1:]:
                combine(total, np.frombuffer(zlib.decompress(packed), dtype), out=total)
            kind = int(pdf["kind"].iloc[0])
            body = finish(kind, total).tobytes() if last else zlib.compress(total.tobytes(), 1)
            return pdf.iloc[:1].assign(counts=[body])

        return run

    schema = f"{COUNTS}, slot int"
    rows = counted.withColumn("slot", F.spark_partition_id())
    left = counted._jdf.rdd().getNumPartitions()
    while True:
        left = -(-left // FAN_IN)
        rows = rows.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("int")).groupBy("kind", "chunk", "slot").applyInPandas(merge(left <= 1), schema)
        if left <= 1:
            break
    out: dict[int, list] = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r.kind, r.chunk)):
        out[r.kind].append(r.counts)
    return {k: np.frombuffer(b"".join(v), finish(k, np.zeros(0, dtype)).dtype) for k, v in out.items()}


def summed(counted: DataFrame, finish: Callable[[int, np.ndarray], np.ndarray] = lambda _, x: x) -> dict[int, np.ndarray]:
    """The sums by kind, in the form that ``finish`` gives them. Empty if there was no task."""
    return _merged(counted, np.int64, np.add, finish)


def united(counted: DataFrame, lengths: list[int]) -> list[np.ndarray]:
    """The unions of the bit arrays of all tasks, packed, for the kinds 0, 1, ...; empty ones if there was no task."""
    found = _merged(counted, np.uint8, np.bitwise_or, lambda _, x: x)
    return [found.get(k, np.zeros(n // 8, np.uint8)) for k, n in enumerate(lengths)]
