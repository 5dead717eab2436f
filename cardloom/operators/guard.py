"""Guards on generated text: repetition stops, banned texts and tokens, allowed texts, rewinding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT, LEAST_DISTINCT = 20, 5


def tokens_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, idx, token``: the words of each text as its tokens."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n]+", -1), lambda w: w != "")
    return texts.select(key, F.posexplode(words).alias("idx", "token"))


def low_diversity_stop(texts: DataFrame, key: str, text: str | Column, recent: int = RECENT, least: int = LEAST_DISTINCT) -> DataFrame:
    """``key, stop_idx``: the first token, from number ``recent`` + 1 on, at which the last ``recent`` tokens have fewer
    than ``least`` different ones. The token there is not part of the text any more. Texts that never stop are absent.

    ``text`` is a column's name, whose words are the tokens, or an array of tokens. Each text is one row; no window and
    no shuffle.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n]+", -1), lambda w: w != "") if isinstance(text, str) else text

    def first(w: Column) -> Column:
        at = F.sequence(F.lit(recent), F.size(w) - 1)
        low = F.filter(at, lambda i: F.size(F.array_distinct(F.slice(w, i - (recent - 2), F.lit(recent)))) < least)
        return F.when(F.size(w) > recent, F.get(low, F.lit(0)))

    # the tokens as a variable of their own: as a column the optimizer would put their making into each step
    return texts.select(key, F.get(F.transform(F.array(words), first), F.lit(0)).alias("stop_idx")).where("stop_idx is not null")


def immediate_repeats(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens equal to the one before: ``key, idx, token``. They are banned for the next three steps."""
    before = F.lag("token").over(Window.partitionBy(key).orderBy("idx"))
    return tokens.withColumn("__before", before).where(F.col("token") == F.col("__before")).select(key, "idx", "token", (F.col("idx") + 3).alias("banned_until"))


def line_repeat_stop(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, stop_line``: the first line that repeats an earlier one, ignoring case.

    Lines of up to two characters and those that begin with ``A:`` do not count. Inside ``<think>`` a line may come
    three times; at ``</think>`` the count starts anew. Works on one text at a time, in its own row.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    line = F.posexplode(lines).alias("line_no", "line")
    w = Window.partitionBy(key).orderBy("line_no")
    told = texts.select(key, line).withColumn("line", F.trim("line"))
    mode = F.sum(F.when(F.col("line").contains("</think>"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.last(F.when(F.col("line").contains("</think>"), False).when(F.col("line").contains("<think>"), True), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    moded = told.withColumn("segment", F.coalesce(mode, F.lit(0))).withColumn("thinking", F.coalesce(opened, F.lit(False)))
    counted = moded.where((F.length("line") > 2) & ~F.col("line").startswith("A:"))
    nth = F.row_number().over(Window.partitionBy(key, "segment", F.lower("line")).orderBy("line_no"))
    return counted.withColumn("nth", nth).where(F.col("nth") >= F.when(F.col("thinking"), 4).otherwise(2)).groupBy(key).agg(F.min("line_no").alias("stop_line"))


_SPANS = "array<struct<phrase: string, match_start: int, first_idx: int, last_idx: int, rewind: int>>"


def banned_spans(tokens: DataFrame, key: str, phrases: list[str], separator: str = " ") -> DataFrame:
    """Where banned phrases end in a token stream: ``key, phrase, match_start, first_idx, last_idx, rewind``.

    Each text is put together once; texts without any phrase never leave the JVM. In the others all phrases are looked
    for in one pass over Arrow batches, and the tokens that an occurrence overlaps come from the running lengths by
    bisection. The rewind is the number of those tokens. Occurrences of one phrase do not overlap.
    """
    told = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "token"))).alias("t"))
    joined = told.select(key, F.transform("t", lambda t: t["token"]).alias("w"), F.transform("t", lambda t: t["idx"]).alias("n")).withColumn("body", F.array_join("w", separator))
    held = F.array(*[F.lit(p) for p in phrases]).cast("array<string>")
    gap = len(separator)

    @F.pandas_udf(_SPANS)
    def spans(words: pd.Series, places: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for w, n, body in zip(words, places, bodies):
            ends = np.cumsum([len(x) + gap for x in w]) - gap
            found = []
            for phrase in phrases:
                at = body.find(phrase)
                while at >= 0:
                    first, last = np.searchsorted(ends, [at + 1, at + len(phrase)])
                    found.append({"phrase": phrase, "match_start": at, "first_idx": n[first], "last_idx": n[last], "rewind": last - first + 1})
                    at = body.find(phrase, at + len(phrase))
            out.append(found)
        return pd.Series(out)

    return joined.where(F.exists(held, lambda p: F.contains(F.col("body"), p))).select(key, F.inline(spans("w", "n", "body")))


def single_token_bans(vocabulary: DataFrame, phrases: list[str]) -> DataFrame:
    """Tokens that contain a banned phrase: they are never sampled. ``phrases`` is a setting, so the test is one
    expression over the vocabulary and no join."""
    found = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.col("token"), p))
    return vocabulary.select("token", F.explode(found).alias("phrase"))


def sequence_bans(tokens: DataFrame, key: str, sequences: list[list[str]]) -> DataFrame:
    """Where the last tokens equal a banned sequence: ``key, idx, sequence, rewind``; its first token is banned there
    after the rewind. One window for all sequences: the last tokens, as many as the longest of them has."""
    longest = max(len(s) for s in sequences)
    w = Window.partitionBy(key).orderBy("idx").rowsBetween(1 - longest, Window.currentRow)
    known = F.array(*[F.array(*[F.lit(t) for t in s]) for s in sequences])
    recent = tokens.withColumn("__last", F.collect_list("token").over(w))
    met = F.filter(known, lambda s: F.when(F.size(s) <= F.size("__last"), F.slice("__last", F.size("__last") - F.size(s) + 1, F.size(s)) == s).otherwise(False))
    return recent.where(F.size(met) > 0).select(key, "idx", F.explode(met).alias("__s")).select(key, "idx", F.array_join("__s", " ").alias("sequence"), F.size("__s").alias("rewind"))


def active_rules(rules: DataFrame, at: str) -> DataFrame:
    """Rules in force at a step: from ``start`` for ``duration`` steps; a duration below 1 never ends."""
    step = F.col(at)
    return rules.where((step >= F.col("start")) & ((F.col("duration") < 1) | (step - F.col("start") < F.col("duration"))))


def banned_tokens(steps: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``steps`` (``step, token``) that an active rule for their token bans."""
    condition = (steps["token"] == rules["token"]) & (steps["step"] >= rules["start"]) & ((rules["duration"] < 1) | (steps["step"] - rules["start"] < rules["duration"]))
    return steps.join(rules, condition, "left_semi")


class AllowedTexts:
    """Which tokens may follow if a text must be a run of allowed words: a walk over a trie that starts anew after a
    whole word; a word that begins another one hides it."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = True

    def walk(self, text: str, node: dict | None = None) -> dict | None:
        node = self.root if node is None else node
        for c in text:
            node = node.get(c)
            if node is None:
                return None
            if "" in node:
                node = self.root
        return node

    def allows(self, text: str, token: str) -> bool:
        node = self.walk(text)
        return node is not None and self.walk(token, node) is not None


def allowed_tokens(candidates: DataFrame, words: list[str]) -> DataFrame:
    """Rows of ``candidates`` (``text`` so far, ``token``) whose token may follow, by one trie per worker."""

    def run(batches):
        trie = AllowedTexts(words)
        for pdf in batches:
            yield pdf[[trie.allows(t or "", k) for t, k in zip(pdf["text"], pdf["token"])]]

    return candidates.mapInPandas(run, candidates.schema)


def rewound(events: list[tuple[str, int]]) -> str:
    """The text after appending and rewinding: first the rewind, then the token."""
    out = ""
    for token, rewind in events:
        out = out[: max(0, len(out) - rewind)] + token
    return out


def progress_fold(events: DataFrame, key: str, order: str, token: str, rewind: str) -> DataFrame:
    """``key, text``: the text of each item after all its events in order; the same order number counts once."""
    unique = events.dropDuplicates([key, order])
    told = unique.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, token, rewind))).alias("e"))
    text = F.aggregate("e", F.lit(""), lambda acc, x: F.concat(F.substring(acc, F.lit(1), F.greatest(F.lit(0), F.length(acc) - x[rewind])), F.coalesce(x[token], F.lit(""))))
    return told.select(key, text.alias("text"))


