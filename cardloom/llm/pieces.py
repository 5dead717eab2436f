"""Splitting oversized texts at natural boundaries, by a recursive hierarchy of separators."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 700, 50, 4

#: Where a text may be cut, from the strongest boundary to the weakest. Each pattern matches the end of a unit, so
#: units keep their separators and together are the text. After the last level a unit is cut between characters.
LEVELS = tuple(
    regex.compile(p)
    for p in (
        r"(?=\n#{1,6} |\n=+ |\n\\section|\n<h\d)|\r?\n(?:[ \t]*\r?\n){2,}",  # section
        r"\r?\n[ \t]*\r?\n|\r\r",  # paragraph
        r"\r\n|\n|\r",  # line
        r"[.!?…]+[\"'”’»)\]]*(?=\s|\p{Lu}\p{Ll})\s*|[。！？]+[」』）]*",  # sentence; some are joined without a space
        r"\s+|(?<=[、,;])",  # word
    )
)
SENTENCE = 3
_BLANKS = regex.compile(r"\s+")


def utf16_length(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text) if not text.isascii() else len(text)


def tokens_estimate(content: Column) -> Column:
    """The estimate of the chunk limit: UTF-16 units / 4, rounded down."""
    return F.floor(F.octet_length(F.encode(content, "UTF-16BE")) / 2 / CHARS_PER_TOKEN)


class _Text:
    """A text with its boundaries: ``bounds[k]`` are the places where a unit of level ``k`` or stronger ends, in characters,
    and ``units[i]`` is the place of character ``i`` in UTF-16 units."""

    def __init__(self, text: str):
        self.text, self.bounds = text, []
        found: set[int] = {len(text)}
        for level in LEVELS:
            # blanks belong to what stands before them: no boundary among those that lead to a stronger one
            weak = (m.end() for m in level.finditer(text) if m.end() > 0)
            found.update([b for b in weak if b not in found and not ((m := _BLANKS.match(text, b)) and m.end() in found)])
            self.bounds.append(sorted(found))
        if text.isascii():
            self.units = range(len(text) + 1)
        else:
            self.units = [0, *accumulate(1 + (c > "\uffff") for c in text)]

    def size(self, a: int, b: int) -> int:
        return self.units[b] - self.units[a]

    def cut(self, start: int, begin: int, limit: int, overlap: int) -> int:
        """Where the piece that begins at ``begin`` (its own text at ``start``) ends.

        All units of the strongest level that fit are taken. The unit that fits no more is left whole for the next
        piece if it fits there behind the overlap, and also if this piece is half full already; else its parts of the
        next weaker level are taken in the same way. After the last level the text is cut between characters.
        """
        far = bisect_right(self.units, self.units[begin] + limit) - 1
        if far == len(self.text):
            return far
        end = start
        for bounds in self.bounds:
            k = bisect_right(bounds, far)
            if k and bounds[k - 1] > end:
                end = bounds[k - 1]
            if end > start:
                head = _overlap(self.text[begin:end], overlap)
                if self.size(end - head, bounds[k]) <= limit or 2 * self.size(start, end) >= limit:
                    return end
        return far


def split_text(text: str, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> list[tuple[str, int, int]]:
    """Pieces ``(content, start, end)`` of ``text`` in UTF-16 units; a text within the limit is one piece.

    The text is cut at the strongest boundaries that serve: a unit is cut inside only if it fits no piece whole. A
    piece after the first begins with the end of the one before, about ``overlap_tokens`` of it, from a sentence start
    if one lies near, else from a word start. Every piece is an exact substring; without their overlaps the pieces are
    the text.
    """
    limit = max_tokens * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1
    if utf16_length(text) <= limit:
        return [(text, 0, utf16_length(text))] if text else []
    overlap = min(overlap_tokens * CHARS_PER_TOKEN, limit // 4)  # it may be half as long again to begin at a sentence
    whole, out, at, begin = _Text(text), [], 0, 0
    while at < len(text):
        end = whole.cut(at, begin, limit, overlap)
        out.append((text[begin:end], whole.units[begin], whole.units[end]))
        begin, at = end - _overlap(text[begin:end], overlap), end
    return out


def _overlap(before: str, units: int) -> int:
    """How many characters of the end of ``before`` to repeat: about ``units``, from a sentence or else a word on."""
    if not before or units <= 0:
        return 0
    tail = before[-(units + units // 2) :]
    while utf16_length(tail) > units + units // 2:
        tail = tail[1:]
    if len(tail) == len(before):
        tail = tail[1:]  # a piece must move on
    best = {}
    for level in (SENTENCE, SENTENCE + 1):
        starts = [m.end() for m in LEVELS[level].finditer(tail) if m.end() < len(tail)]
        if starts:
            best[level] = min(starts, key=lambda s: abs(utf16_length(tail[s:]) - units))
    if SENTENCE in best and utf16_length(tail[best[SENTENCE] :]) >= units // 2:
        return len(tail) - best[SENTENCE]
    if SENTENCE + 1 in best and utf16_length(tail[best[SENTENCE + 1] :]) >= units // 2:
        return len(tail) - best[SENTENCE + 1]
    while utf16_length(tail) > units:
        tail = tail[1:]
    return len(tail)


def oversized_pieces(chunks: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, rows: int = 256) -> DataFrame:
    """Pieces of every chunk over the limit: ``id, piece, content, start_position, end_position``.

    Positions are the chunk's own start (0 if null) plus the offset in its content, in UTF-16 units. Null and empty
    contents and those within the limit give no row. Exact repeats of a row count once. Other columns are not read.
    """
    # no text under a quarter of the limit's characters can be over it, which spares encoding most of them
    long = chunks.where((F.length("content") * 2 > max_tokens * CHARS_PER_TOKEN) & (tokens_estimate(F.col("content")) > max_tokens))
    rows_in = long.select("id", "content", F.coalesce("start_position", F.lit(0)).cast("long").alias("start_position")).dropDuplicates()

    def run(batches):
        for whole in batches:
            for pdf in (whole.iloc[i : i + rows] for i in range(0, len(whole), rows)):
                out = [
                    (i, n, piece, start + a, start + b)
                    for i, text, start in zip(pdf["id"], pdf["content"], pdf["start_position"])
                    for n, (piece, a, b) in enumerate(split_text(text, max_tokens, overlap_tokens))
                ]
                yield pd.DataFrame(out, columns=["id", "piece", "content", "start_position", "end_position"])

    return rows_in.mapInPandas(run, "id long, piece int, content string, start_position long, end_position long")
