"""Batched generation step by step: all items in work advance by one token per step."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

FAILED = "Inference Failed"


def stub_step(items: list[tuple[str, str]]) -> list[str | None]:
    """The default model: says the words of the prompt again; None at the end. A pure function of prompt and text."""
    out = []
    for prompt, text in items:
        words = prompt.split()
        n = len(text.split())
        out.append((" " if n else "") + words[n] if n < len(words) else None)
    return out


def run_steps(requests: DataFrame, key: str, prompt: str, step: Callable[[list[tuple[str, str]]], list[str | None]] = stub_step, width: int = 4, max_tokens: int = 1024, continuous: bool = True) -> DataFrame:
    """``key, response, n_tokens, error`` of every request.

    ``step`` gets the prompts and texts of the items in work and returns the next token of each, None where an item is
    done. Up to ``width`` items are in work: with ``continuous`` a free place is filled at once, without it only when
    all are done. When a step fails, the first item in work is dropped with ``error`` and keeps its text so far; the
    others go on. A partition is a queue of its own, so nothing is shuffled and only items in work are held.
    """
    read = requests.select(key, prompt)

    def run(batches):
        waiting = (row for pdf in batches for row in pdf.itertuples(index=False, name=None))
        active: list[list] = []  # key, prompt, text, tokens
        done: list[tuple] = []
        more = True
        while True:
            while more and len(active) < width and (continuous or not active or active[0][3] == 0):
                row = next(waiting, None)
                more = row is not None
                if more:
                    active.append([row[0], row[1] or "", "", 0])
            if not active:
                break
            try:
                told = step([(x[1], x[2]) for x in active])
            except Exception:  # noqa: BLE001 - any failure of the model
                first = active.pop(0)
                done.append((first[0], first[2], first[3], FAILED))
                continue
            left = []
            for item, token in zip(active, told):
                if token is not None:
                    item[2], item[3] = item[2] + token, item[3] + 1
                if token is None or item[3] >= max_tokens:
                    done.append((item[0], item[2], item[3], None))
                else:
                    left.append(item)
            active = left
            if len(done) >= 1000:
                yield pd.DataFrame(done, columns=[key, "response", "n_tokens", "error"])
                done = []
        yield pd.DataFrame(done, columns=[key, "response", "n_tokens", "error"]).astype({"n_tokens": "int32"})

    return read.mapInPandas(run, f"`{key}` {read.schema[key].dataType.simpleString()}, response string, n_tokens int, error string")
