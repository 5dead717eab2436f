"""Rules on generated text: bans and allowances on tokens, token sequences and texts, each for a part of the timeline.

A rule set is a small immutable setting. ``Generation`` applies it to one stream of tokens: it says which tokens may
come next, finds what must be taken back, and rewinds. ``replay`` and ``permitted`` run it over many streams at once,
one row per stream, without a shuffle beyond the one that gathers a stream's tokens.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .guard import AllowedTexts

RULES = "no int, mode string, unit string, text string, tokens array<string>, start int, duration int, ban_duration int, ban_last boolean"


@dataclass(frozen=True)
class Rule:
    """``mode`` is ban or allow; ``unit`` is token, tokens or text. In force from ``start`` for ``duration`` steps, below
    1 without end. What a ban found is banned for ``ban_duration`` steps: its first token, or with ``ban_last`` the last."""

    mode: str
    unit: str
    pattern: str | tuple[str, ...]
    start: int = 0
    duration: int = -1
    ban_duration: int = 3
    ban_last: bool = False

    def active(self, at: int) -> bool:
        return at >= self.start and (self.duration < 1 or at - self.start < self.duration)


@dataclass(frozen=True)
class RuleSet:
    """Rules in the order in which they were added, and the tokens that end a text, which can never be banned."""

    rules: tuple[Rule, ...] = ()
    ends: frozenset[str] = frozenset()

    def add(self, *new: Rule) -> RuleSet:
        """With more rules; empty patterns are passed over. An allowance of token sequences always allows the ends too."""
        kept = [r for r in new if len(r.pattern)]
        for rule in kept:
            if rule.mode == "ban" and rule.unit != "text" and self.ends & {rule.pattern, *(rule.pattern if rule.unit == "tokens" else ())}:
                raise ValueError("a token that ends a text cannot be banned")
        allowed = [Rule("allow", "tokens", (e,)) for e in sorted(self.ends) if any(r.mode == "allow" and r.unit == "tokens" for r in kept)]
        return replace(self, rules=(*self.rules, *kept, *(r for r in allowed if r not in self.rules)))

    def ban_texts(self, texts: Iterable[str], at: int = 0, duration: int = -1, **more) -> RuleSet:
        return self.add(*(Rule("ban", "text", t, at, duration, **more) for t in texts))

    def clear(self, mode: str, unit: str) -> RuleSet:
        return replace(self, rules=tuple(r for r in self.rules if (r.mode, r.unit) != (mode, unit)))

    def reset(self) -> RuleSet:
        return replace(self, rules=())

    def of(self, mode: str, unit: str) -> list[Rule]:
        return [r for r in self.rules if (r.mode, r.unit) == (mode, unit)]

    def longest(self, unit: str) -> int:
        """The length of the longest pattern of a unit, 0 without any: how much history a match can need."""
        return max((len(r.pattern) for r in self.rules if r.unit == unit), default=0)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, r.mode, r.unit, r.pattern if r.unit != "tokens" else None, list(r.pattern) if r.unit == "tokens" else None, r.start, r.duration, r.ban_duration, r.ban_last) for n, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, RULES)


def longest_patterns(rules: DataFrame) -> DataFrame:
    """``characters, tokens``: the longest text and the longest token sequence of a table of rules, 0 without any."""
    return rules.agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("characters"), F.coalesce(F.max(F.size("tokens")), F.lit(0)).alias("tokens"))


def live_rules(log: DataFrame, scope: str, order: str) -> DataFrame:
    """The rules in force after all changes of a log with ``change`` (add, clear, reset) and ``kind``: of each scope those
    added after the last clearing of their kind and after the last reset. Two partial aggregates, no ordered window."""
    cleared = log.where("change = 'clear'").groupBy(scope, "kind").agg(F.max(order).alias("__cleared"))
    reset = log.where("change = 'reset'").groupBy(scope).agg(F.max(order).alias("__reset"))
    joined = log.where("change = 'add'").join(cleared, [scope, "kind"], "left").join(reset, scope, "left")
    alive = F.col(order) > F.greatest(F.coalesce("__cleared", F.lit(-1)), F.coalesce("__reset", F.lit(-1)))
    return joined.where(alive).drop("__cleared", "__reset")


def copied_rules(rules: DataFrame, scope: str, source: str, target: str) -> DataFrame:
    """With the rules of one scope copied to another, which keeps its own."""
    return rules.unionByName(rules.where(F.col(scope) == source).withColumn(scope, F.lit(target)))


class Generation:
    """One text while it is generated: its tokens, its place on the timeline, and the bans that came up."""

    def __init__(self, rules: RuleSet, control: frozenset[str] = frozenset()):
        self.rules, self.control = rules, control
        self.tokens: list[str] = []
        self.at = 0
        self.bans: list[tuple[str, int, int]] = [(r.pattern, r.start, r.duration) for r in rules.of("ban", "token")]
        self.trie = AllowedTexts([r.pattern for r in rules.of("allow", "text")])

    @property
    def text(self) -> str:
        return "".join(self.tokens)

    def accept(self, token: str) -> tuple[int, str, int, int] | None:
        """Take the next token. If a ban in force is met: the tokens to take back, the token banned there, from when
        and how long (the longer rewind of a token and a text ban; the first rule of each decides)."""
        self.tokens.append(token)
        self.at += 1
        if token in self.control:
            return None
        found = [x for x in (self._sequence(), self._text()) if x]
        for _, banned, start, duration in found:
            self.bans.append((banned, start, duration))
        return max(found, key=lambda x: x[0]) if found else None

    def _sequence(self):
        for rule in self.rules.of("ban", "tokens"):
            n = len(rule.pattern)
            if rule.active(self.at) and tuple(self.tokens[-n:]) == rule.pattern:
                return n, rule.pattern[0], self.at - n, rule.duration
        return None

    def _text(self):
        rules, text = self.rules.of("ban", "text"), None
        for rule in rules:
            if not rule.active(self.at) or next(r for r in rules if r.pattern == rule.pattern and r.active(self.at)) is not rule:
                continue
            text = self.text if text is None else text
            # a new match ends within the newest token
            begin = text.find(rule.pattern, max(0, len(text) - len(self.tokens[-1]) - len(rule.pattern) + 1))
            if begin < 0:
                continue
            n, rest = 1, len(text) - begin - len(self.tokens[-1])
            while not rule.ban_last and rest > 0:
                n += 1
                rest -= len(self.tokens[-n])
            return n, self.tokens[-n], self.at - n, rule.ban_duration
        return None

    def rewind(self, n: int) -> None:
        if n > 0:
            del self.tokens[-n:]
            self.at = max(0, self.at - n)

    def allows(self, token: str) -> bool:
        """Whether a token may come next. Of token rules the allowances are asked before the bans, of text rules the
        bans before the allowances; a ban wins over any allowance. Control tokens are only stopped by a text in them."""
        if any(r.pattern in token for r in self.rules.of("ban", "text") if r.active(self.at)):
            return False
        if token in self.control:
            return True
        active = [r.pattern for r in self.rules.of("allow", "tokens") if r.active(self.at)]
        if active and token not in self._next(active):
            return False
        if any(b == token and self.at >= start and (n < 1 or self.at - start < n) for b, start, n in self.bans):
            return False
        return not any(r.active(self.at) for r in self.rules.of("allow", "text")) or self.trie.allows("".join(t for t in self.tokens if t not in self.control), token)

    def _next(self, sequences: list[tuple[str, ...]]) -> set[str]:
        """The tokens that go on with what the end of the text has of a sequence; any beginning for an empty text."""
        if not self.tokens:
            return {s[0] for s in sequences}
        out = set()
        for s in sequences:
            held = max((n for n in range(1, min(len(s), len(self.tokens)) + 1) if tuple(self.tokens[-n:]) == s[:n]), default=0)
            if 0 < held < len(s):
                out.add(s[held])
        return out


EVENTS = "array<struct<idx: int, rewind: int, banned: string, ban_from: int, ban_for: int>>"


def replay(streams: DataFrame, key: str, tokens: Column, rules: RuleSet, control: frozenset[str] = frozenset()) -> DataFrame:
    """``key, text, n_tokens, events`` of recorded token streams (arrays) put through the rules: whenever a ban is met its
    tokens are taken back and the stream goes on. A null stream is an empty one. One row each, nothing is shuffled."""
    read = streams.select(key, tokens.alias("__tokens"))

    def run(batches):
        for pdf in batches:
            rows = []
            for k, stream in zip(pdf[key], pdf["__tokens"]):
                now, events = Generation(rules, control), []
                for i, token in enumerate(stream if stream is not None else ()):
                    if met := now.accept(token):
                        events.append((i, *met))
                        now.rewind(met[0])
                rows.append((k, now.text, now.at, [dict(zip(("idx", "rewind", "banned", "ban_from", "ban_for"), e)) for e in events]))
            yield pd.DataFrame(rows, columns=[key, "text", "n_tokens", "events"])

    kind = read.schema[key].dataType.simpleString()
    return read.mapInPandas(run, f"`{key}` {kind}, text string, n_tokens int, events {EVENTS}")


def permitted(candidates: DataFrame, key: str, tokens: Column, vocabulary: list[str], rules: RuleSet, control: frozenset[str] = frozenset()) -> DataFrame:
    """``key, token, allowed`` for each token of a small vocabulary after the given tokens."""
    read = candidates.select(key, tokens.alias("__tokens"))

    def run(batches):
        for pdf in batches:
            rows = []
            for k, stream in zip(pdf[key], pdf["__tokens"]):
                now = Generation(rules, control)
                for token in stream if stream is not None else ():
                    if met := now.accept(token):
                        now.rewind(met[0])
                rows += [(k, token, now.allows(token)) for token in vocabulary]
            yield pd.DataFrame(rows, columns=[key, "token", "allowed"])

    return read.mapInPandas(run, f"`{key}` {read.schema[key].dataType.simpleString()}, token string, allowed boolean")
