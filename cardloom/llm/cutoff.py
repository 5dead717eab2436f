"""Answers that stop before their end: a backward n-gram model of how texts end, and a pushdown parser.

The model is trained on all values of the column. Reading backwards from a place in a text it sees

* the last characters: how often does a word end after them, and how often does a phrase end there (end of text or a
  mark) rather than go on with another word;
* the last words, where rare words count as one sign and numbers as another: how often does a value end there without
  a closing mark, and how often does a sentence end there, compared with how often it goes on;
* a word and the mark behind it: how often does the sentence end with the mark rather than go on.

Counts are exact: every context has a key of its own (64 bits) and partial counts are summed by key in a shuffle, so a
rare context is backed off from at every size of the input. The model is a table that is never held in one place: values
ask for the few contexts of their ends, and meet the counts in a join. A value is cut off if a bracket, quotation, list
item, formula, element or fence is open. One that ends without a closing mark is cut off too if a tag or entity is open, if
it ends in a joining sign, or if its end is less likely than going on, by log-odds with thresholds per language. One
with a closing mark is cut off if the mark ends no sentence: behind an abbreviation that leads to more, behind the
number of an empty list item, where by log-odds the sentence goes on after this word and its mark or after a number in
such a place, and before an ellipsis where the word or phrase is not over.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language import FUNCTION_WORDS

CONTEXTS = (3, 4, 5)  #: characters before a place
TOKENS = (2, 3, 4, 5)  #: tokens before an end; the longest context is all of the sentence so far
EVIDENCE = 8  #: occurrences from which a context is trusted; else a shorter one is used
#: Kinds of counts: of character contexts, words, token contexts and words before a mark.
_CHARS, _WORD, _CONTEXT, _MARKED = 0, len(CONTEXTS), len(CONTEXTS) + 1, len(CONTEXTS) + len(TOKENS) + 2
_SHORTEST = (_CHARS, _CONTEXT)  #: used even without evidence
BLOCK = 6_000_000  #: keys that a task collects before it counts them
#: Least log-odds of a word's end, a phrase's end and the value's end against going on, by language; else the first.
THRESHOLDS = {"": (-3.0, -2.8, -1.4), "ja": (-20.0, -20.0, -1.4)}
#: Least log-odds of the sentence's end at a closing mark: by the word before it, by the tokens if the last is a number.
MARK_THRESHOLDS = (-1.4, -3.0)


_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*|\p{N}+(?:[.,]\p{N}+)*|\n|[^\s\p{L}\p{N}]")
_ASCII_TOKEN = re.compile(r"[a-zA-Z]+|[0-9]+(?:[.,][0-9]+)*|\n|[^\sa-zA-Z0-9]")  #: the same for plain texts
_CJK_TOKEN = regex.compile(r"[\p{Katakana}ー]+|[\p{Hiragana}\p{Han}]|\p{L}[\p{L}\p{M}]*|\p{N}+(?:[.,]\p{N}+)*|\n|[^\s\p{L}\p{N}]")
_HIRAGANA = regex.compile(r"\p{Hiragana}")
_KEPT = {language: frozenset(words.split()) for language, words in FUNCTION_WORDS.items()}
_CJK = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}]")
#: Closing marks: a text that ends with one of these, perhaps followed by closing quotes or brackets, is whole.
_CLOSED = r"[.!?。！？…]\"?['”’»›」』）)\]*_`]*\s*$"
CLOSED = re.compile(_CLOSED)
_TAIL = regex.compile(r"(?:[.!?。！？…]|\[…\]|\[\.\.\.\])[.!?。！？…\"'”’»›」』）)\]*_`\s]*$")
#: Abbreviations that lead to what they announce, so no text ends with their full stop.
_LEADING = regex.compile(
    r"(?<![\p{L}\p{N}.])(?:(?i:e\.\s?g|i\.\s?e|vs|cf|viz|z\.\s?b|d\.\s?h|bzw|vgl|sog|p\.\s?ex|c\.-à-d|p\.\s?ej|resp)|(?<=[\p{L}\p{N},;:)]\s+)(?:No|Nos|Nr|Nro|Núm|Fig|Figs|Eq|Sec|Ch|Abb|Kap|Bd|Vol|pp)|Dr|Mr|Mrs|Ms|Prof|Mme|Sra)\.$"
)
_LAST = regex.compile(r"\p{L}[\p{L}\p{M}ー]*$")
_ITEM = regex.compile(r"(?m:^[ \t]*\p{N}+[.)][ \t]+\S[^\n]*\n)\s*\p{N}+[.)]$")
_JOINING = regex.compile(r"[,;:(\[{«“„「『（<=+*/&\-–—_@#$%^\\|~、]\s*$|&#?\w{1,7}$|<[^<>]*$")
OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』", "（": "）"}
_OPENER_OF = {closing: opener for opener, closing in OPENERS.items()}
#: Elements that need no closing tag.
_UNCLOSED = frozenset("area base br col embed hr img input link meta param source track wbr p li dt dd tr td th thead tbody tfoot option rt rp".split())
_STRUCTURE = re.compile(
    "```|[\"`" + re.escape("".join([*OPENERS, *OPENERS.values()])) + r"]|<(/?)([a-zA-Z][a-zA-Z0-9]{0,15})(?:\s[^<>]*)?(/?)>|\\(begin|end)\{([a-zA-Z*]{1,30})\}|\\[()\[\]]|\$\$|\*\*|(?<![\w$\\])\$(?=[^\s\d$])|(?<=[^\s$\\])\$(?![\w$])|(?m:^[ \t]*(?:[-*+•]|\d{1,3}[.)])(?=[ \t]|$))"
)
_MAY_OPEN = re.compile("[\"`<\\\\$*•+\\-" + re.escape("".join([*OPENERS, *OPENERS.values()])) + r"]|(?m:^[ \t]*\d{1,3}[.)])")


def open_structures(text: str) -> list[str]:
    """Pushdown parse of brackets, quotations, code, lists and markup: what is still open at the end.

    Quotation marks close what they open, straight ones alternate; apostrophes inside words are none. A closing sign
    that fits nothing open (a list label such as ``1)``, a face) is passed over. In code only its end is looked for.
    Tags (but those that need no end), LaTeX environments, formulas and strong emphasis are closed by their own kind. A
    list's label opens an item, which any text after it completes.
    """
    stack: list[str] = []
    if not _MAY_OPEN.search(text):
        return stack

    def toggle(c: str) -> None:
        if c in stack:
            del stack[stack.index(c) :]
        else:
            stack.append(c)

    def close(c: str) -> None:
        if c in stack:
            del stack[len(stack) - 1 - stack[::-1].index(c) :]

    at = 0
    for m in _STRUCTURE.finditer(text):
        c = m[0]
        if stack and stack[-1] == "item" and text[at : m.start()].strip():
            stack.pop()
        at = m.end()
        if c == "```":
            toggle(c)
        elif "```" in stack:
            continue
        elif c in ('"', "`"):
            toggle(c)
        elif "`" in stack:
            continue
        elif stack and c == OPENERS.get(stack[-1]):
            stack.pop()
        elif c in OPENERS:
            stack.append(c)
        elif c in _OPENER_OF:
            close(_OPENER_OF[c])
        elif name := m[2]:
            name = f"<{name.lower()}>"
            if m[1]:
                close(name)
            elif not m[3] and name[1:-1] not in _UNCLOSED and f"</{name[1:-1]}" in text.lower():
                stack.append(name)  # only an element that the text closes elsewhere: other words in angle brackets are none
        elif m[4]:
            environment = f"\\begin{{{m[5]}}}"
            stack.append(environment) if m[4] == "begin" else close(environment)
        elif c in ("\\(", "\\["):
            stack.append(c)
        elif c in ("\\)", "\\]"):
            close("\\(" if c == "\\)" else "\\[")
        elif c in ("$", "$$"):
            toggle(c)
        elif c == "**":
            if "**" in stack or (m.end() < len(text) and not text[m.end()].isspace()):
                toggle(c)
        elif not stack:
            stack.append("item")
    if stack and stack[-1] == "item" and text[at:].strip():
        stack.pop()
    return stack


def closed(text: str) -> bool:
    """Whether a text ends with a closing mark; only its end is looked at, marks may be followed by a few signs."""
    return CLOSED.search(text, max(0, len(text) - 40)) is not None


def tokens_of(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_TOKEN.findall(text)
    return (_CJK_TOKEN if not text.isascii() and _CJK.search(text) else _TOKEN).findall(text)


def _place(language: str, token: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{language}\x1f{token}") >> 1


class _Table:
    """What the model sees of tokens, a row for each: a number for the token's sign (function words and signs as they are,
    all others by their kind), the key of a word (-1 for others), whether a sentence or line ends with it (5 a line, 7 a
    mark, -1 a number, else 0), and its part at the end of sentences: 1 for a mark, 2 for what goes on behind one (small
    letters and numbers), 3 for a new line and the space between texts, else 0."""

    MOST = 400_000  #: rows kept between batches; they only save time

    def __init__(self):
        self.columns = tuple(array("q") for _ in range(4))
        self.add(1, -1, 0, 3)  # row 0: between texts
        self.signs = {language: _Signs(language, self) for language in (*FUNCTION_WORDS, "ja", "")}

    def add(self, *row: int) -> int:
        for column, value in zip(self.columns, row):
            column.append(value)
        return len(self.columns[0]) - 1

    def take(self, rows: list[int]) -> list[np.ndarray]:
        return [np.frombuffer(c, np.int64).take(rows) for c in self.columns]


class _Signs(dict):
    """The rows of the tokens of one language."""

    def __init__(self, language: str, table: _Table):
        super().__init__()
        self.language, self.table, self.kept = language, table, _KEPT.get(language, frozenset())

    def __missing__(self, token: str) -> int:
        word = token[0].isalpha()
        if token[0].isnumeric():
            sign = "0"
        elif not word or token.lower() in self.kept:
            sign = token
        elif _CJK.match(token):
            sign = token if _HIRAGANA.match(token) else "x"
        else:
            sign = "W" if token[0].isupper() else "w"
        number = xxhash.xxh3_64_intdigest(f"{self.language}\x1f{sign}") >> 1
        ending = 5 if token == "\n" else 7 if token in ".!?。！？" else -1 if sign == "0" else 0
        part = 1 if token in ".!?。！？…" else 3 if token == "\n" else 2 if token[0].isnumeric() or word and token[0].islower() else 0
        value = self[token] = self.table.add(number, _place("word", token) if word else -1, ending, part)
        return value


_tables: list[_Table] = []


def _table() -> _Table:
    if not _tables or len(_tables[0].columns[0]) > _Table.MOST:
        _tables[:] = [_Table()]
    return _tables[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _backward(codes: np.ndarray, lengths: tuple[int, ...], at: np.ndarray) -> list[np.ndarray]:
    """For each length the key of the codes that lie before each of the positions ``at``."""
    out, h, done = [], np.zeros(len(at), np.uint64), 0
    for k in lengths:
        for step in range(done + 1, k + 1):
            h = _mix(h + codes[at - step] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step))
        done = k
        out.append(h.view(np.int64))
    return out


_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full((1 << 16) - 1, base, np.uint64)))) for base in (_BASE, pow(_BASE, -1, 1 << 64)))


def _since(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each place a key of the codes from its start on, up to and with its own."""
    place = np.arange(len(codes)) & 0xFFFF
    turn = (np.arange(len(codes)) >> 16).astype(np.uint64)
    up = _UP[place] * _power(np.uint64(pow(_BASE, 1 << 16, 1 << 64)), turn)
    sums = np.cumsum(_mix(codes) * up)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    down = _DOWN[place] * _power(np.uint64(pow(_BASE, -(1 << 16), 1 << 64)), turn)
    return (sums - before) * down[starts]


def _power(base: np.uint64, n: np.ndarray) -> np.ndarray:
    values = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(n.max(initial=0)), base, np.uint64))))
    return values[n.astype(np.int64)]


class ValueTexts:
    """Several stripped values as one sequence of characters and one of tokens, with the places to judge."""

    def __init__(self, texts: list[str], languages: list[str]):
        gap, pad, table = max(CONTEXTS), [0] * max(TOKENS), _table()
        self.chars = np.frombuffer((" " * gap).join(["", *(t + "\0" for t in texts)]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(t) for t in texts])
        self.text_ends = np.cumsum(sizes + gap + 1) - 1
        rows: list[int] = []
        ends = []
        for text, language in zip(texts, languages):
            rows += pad
            rows += map(table.signs[language].__getitem__, tokens_of(text))
            ends.append(len(rows))
        numbers, self.word_at, ending, self.parts = table.take([*rows, 0])
        self.tokens = numbers.view(np.uint64)
        self.token_ends = np.array(ends, np.int64)
        begins = np.concatenate(([0], self.token_ends[:-1])) + len(pad)
        # a sentence begins with the text, behind a line's end and behind a mark that follows no number
        seed = np.zeros(len(numbers), np.int64)
        new = (ending[:-1] == 5) | (ending[:-1] == 7) & (np.concatenate(([0], ending[:-2])) >= 0)
        seed[1:][new] = ending[:-1][new]
        seed[begins] = 3
        starts = np.maximum.accumulate(np.where(seed > 0, np.arange(len(seed)), 0))
        self.prefixes = _mix(_since(self.tokens, starts) + seed[starts].astype(np.uint64)).view(np.int64)
        self.last, self.words = self.word_at[self.token_ends - 1], self.word_at[self.word_at >= 0]
        # a word stops where a sign or the end follows
        self.stops = self.word_at[:-1][(self.word_at[:-1] >= 0) & (self.word_at[1:] < 0) & (self.parts[1:] != 2)]
        inside = np.ones(len(self.tokens), bool)
        for j in range(len(pad)):
            inside[begins - len(pad) + j] = False
        self.after_tokens = np.flatnonzero(inside[:-1]) + 1
        self.after_letters = np.flatnonzero(letters(self.chars[:-1])) + 1

    def sentence_ends(self, at: np.ndarray) -> np.ndarray:
        """Whether a sentence ends at each of the positions ``at``: with the value, the line, or a mark that is not
        followed by a small letter or a number."""
        part, following = self.parts[at], self.parts[np.minimum(at + 1, len(self.parts) - 1)]
        return (part == 3) | (part == 1) & (following != 2)

    def contexts(self, at: np.ndarray) -> list[np.ndarray]:
        """The keys of the token contexts before each of the positions ``at``, the longest last."""
        return [*_backward(self.tokens, TOKENS, at), self.prefixes[at - 1]]


_LETTERS, _READ = np.zeros(0x110000, bool), np.zeros(0x110, bool)


def letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters or digits; the table is filled by blocks of 4096 as they come up."""
    codes = codes.astype(np.int64)
    blocks = np.zeros(0x110, bool)
    blocks[codes >> 12] = True
    for block in np.flatnonzero(blocks & ~_READ):
        _LETTERS[block << 12 : (block + 1) << 12] = [chr(c).isalnum() for c in range(block << 12, (block + 1) << 12)]
        _READ[block] = True
    return _LETTERS[codes]


def _told(kind: int, n: list[np.ndarray], yes: list[np.ndarray], over: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Keys with their counts; the keys of ``yes`` and ``over`` are among those of ``n``."""
    keys, count = np.unique(np.concatenate(n), return_counts=True)
    out = {"kind": np.full(len(keys), kind, np.int32), "key": keys, "n": count}
    for name, some in (("yes", yes), ("over", over)):
        found, times = np.unique(np.concatenate(some), return_counts=True)
        out[name] = np.zeros(len(keys), np.int64)
        out[name][np.searchsorted(keys, found)] = times
    return out


class ContextCounter:
    """Counts of contexts, handed out in blocks: per character context all and word ends; per word all and phrase ends;
    per token context all, value ends and sentence ends; per word all marks behind it and those that end the sentence."""

    def __init__(self):
        self.kept: dict[int, tuple[list, list, list]] = {}
        self.size = 0

    def _keep(self, kind: int, n: np.ndarray, yes: np.ndarray, over: np.ndarray = np.zeros(0, np.int64)) -> None:
        for to, keys in zip(self.kept.setdefault(kind, ([], [], [])), (n, yes, over)):
            to.append(keys)
        self.size += len(n)

    def add(self, t: ValueTexts, whole: np.ndarray) -> None:
        word_end = ~letters(t.chars[t.after_letters])
        for k, keys in enumerate(_backward(t.chars, CONTEXTS, t.after_letters)):
            self._keep(_CHARS + k, keys, keys[word_end])
        self._keep(_WORD, t.words, t.stops)
        over = t.sentence_ends(t.after_tokens)
        ended = np.zeros(len(t.tokens), bool)
        ended[t.token_ends[~whole]] = True
        ends = ended[t.after_tokens]
        for k, keys in enumerate(t.contexts(t.after_tokens)):
            self._keep(_CONTEXT + k, keys, keys[ends], keys[over])
        words = t.word_at[t.after_tokens - 1]
        marked = (words >= 0) & (t.parts[t.after_tokens] == 1)
        self._keep(_MARKED, words[marked], words[marked & over])

    def blocks(self, least: int = 0):
        if self.size > least:
            for kind, lists in self.kept.items():
                yield _told(kind, *lists)
            self.kept, self.size = {}, 0


# What the end of a text is judged by: nothing more, all, what stands before an ellipsis, a number and its mark, a word and
# its mark.
DECIDED, END, ELLIPSIS, NUMBER, MARK = range(5)


def end_of(text: str, whole: bool) -> tuple[int, str]:
    """How to judge a stripped text that is not empty (``whole`` is what ``closed`` says of it), and the part of it to be
    judged; ``DECIDED`` with a text is cut, with an empty one whole."""
    # a replacement character at the end is a character that was cut in its bytes
    if open_structures(text) or (_LEADING.search(text) or _ITEM.search(text) if whole else text[-1] == "\ufffd" or _JOINING.search(text)):
        return DECIDED, text
    if not whole:
        return END, text
    tail = _TAIL.search(text, max(0, len(text) - 40))
    body = text[: tail.start()].rstrip()
    if not body:
        return DECIDED, ""
    return ELLIPSIS if tail[0].startswith(("…", "...", "[")) else NUMBER if body[-1].isnumeric() else MARK, body


def asked(forms: list[tuple[int, str]], languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts whose counts decide about the texts of ``end_of``: the text's number, kind and key of each."""
    row, kind, key = [], [], []
    for i, (form, body) in enumerate(forms):
        if form == MARK and (word := _LAST.search(body, max(0, len(body) - 80))):
            row.append([i])
            kind.append([_MARKED])
            key.append(np.array([_place("word", tokens_of(word[0])[-1])], np.int64))
    some = np.array([i for i, (form, _) in enumerate(forms) if form in (END, ELLIPSIS, NUMBER)], np.int64)
    if len(some):
        t = ValueTexts([forms[i][1] for i in some], [languages[i] for i in some])
        # after a sign only the value's end is in question, and of a number only whether its mark ends the sentence
        inside = np.array([forms[i][0] != NUMBER and forms[i][1][-1].isalnum() for i in some])
        parts = [(_CHARS + k, keys, inside) for k, keys in enumerate(_backward(t.chars, CONTEXTS, t.text_ends))]
        parts += [(_WORD, t.last, inside & (t.last >= 0))]
        parts += [(_CONTEXT + k, keys, np.ones(len(some), bool)) for k, keys in enumerate(t.contexts(t.token_ends))]
        for of, keys, use in parts:
            row.append(some[use])
            kind.append(np.full(int(use.sum()), of))
            key.append(keys[use])
    if not row:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(row), np.concatenate(kind).astype(np.int32), np.concatenate(key)


def trusted(counts: DataFrame) -> DataFrame:
    """Whole counts of the contexts that can decide: ``kind, key, n, yes, over`` of partial ones."""
    summed = counts.groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in ("n", "yes", "over")))
    # a context's own text is left out, so fewer occurrences are never asked for
    return summed.where(F.col("kind").isin(*_SHORTEST) | (F.col("n") > EVIDENCE))


def looked_up(asks: DataFrame, known: DataFrame, values: int, row: str) -> DataFrame:
    """``asks`` with the log-odds ``first`` and ``second`` of each context; null without evidence.

    The counts of contexts that come in one of 50 values or more are broadcast: there are at most 50 times as many of
    them as a value has places on average, whatever the number of values. All others meet in a shuffle, in which no key
    is that frequent. ``row`` tells rows of ``asks`` apart.
    """
    often = F.col("n") * 50 >= F.lit(values)
    hot = F.broadcast(known.where(often).select("kind", "key", *[F.col(c).alias(f"hot_{c}") for c in ("n", "yes", "over")]))
    met = asks.join(hot, ["kind", "key"], "left")
    # a row that is served already gets a key of its own, so that such rows crowd nowhere
    met = met.withColumn("key", F.when(F.col("hot_n").isNotNull(), F.xxhash64(row, "kind")).otherwise(F.col("key")))
    met = met.join(known.where(~often), ["kind", "key"], "left")
    n, yes, over = (F.coalesce(f"hot_{c}", c, F.lit(0)) - 1 for c in ("n", "yes", "over"))
    use = F.col("kind").isin(*_SHORTEST) | (n >= EVIDENCE)
    odds = lambda x: F.when(use, F.log((F.greatest(x, F.lit(0)) + 0.2) / (F.greatest(n - x, F.lit(0)) + 0.2)))
    return met.select(*[c for c in asks.columns if c != "key"], odds(yes).alias("first"), odds(over).alias("second"))


def cut_off(form: Column, language: Column, first: dict[int, Column], second: dict[int, Column]) -> Column:
    """Whether a text is cut, from the log-odds by kind: the longest context with evidence decides."""
    word_end = F.coalesce(*[first[_CHARS + k] for k in reversed(range(len(CONTEXTS)))], F.lit(0.0))
    phrase_end = F.coalesce(first[_WORD], F.lit(0.0))
    value_end, sentence_end = (F.coalesce(*[of[_CONTEXT + k] for k in reversed(range(len(TOKENS) + 1))], F.lit(0.0)) for of in (first, second))
    low = [F.when(F.lit(False), 0.0) for _ in range(3)]
    for name, values in THRESHOLDS.items():
        low = [x.when(language == name, v) for x, v in zip(low, values)] if name else low
    low = [x.otherwise(v) for x, v in zip(low, THRESHOLDS[""])]
    # a likely end of the value, or of the sentence before a mark, speaks for the word it ends with
    support = F.greatest(F.when(form == END, value_end).otherwise(sentence_end), F.lit(0.0)) * 0.3
    inside = first[_CHARS].isNotNull() & ((word_end + support < low[0]) | (phrase_end + support < low[1]))
    return (
        F.when(form == MARK, F.coalesce(first[_MARKED], F.lit(0.0)) < MARK_THRESHOLDS[0])
        .when(form == NUMBER, sentence_end < MARK_THRESHOLDS[1])
        .otherwise(inside | (form == END) & (value_end < low[2]))
    )


KINDS = _MARKED + 1
