"""Cutting documents into chunks by a character threshold, sections and sentences.

The reader cuts its buffer at a paragraph (else a line) once it holds ``flush_chars``; what was cut is folded section
by section up to ``max_tokens`` estimated tokens, and sections over that sentence by sentence. Sections and sentences
are joined without a separator and positions count their trimmed lengths. A document is one row, so there is no
shuffle, and memory is bounded by the largest document.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINES = re.compile(r"\r\n|\r|\n")
_SECTIONS = re.compile(r"\r\n\r\n|\n\n")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")


def _units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


class _Piece:
    """A chunk being filled."""

    def __init__(self, start: int):
        self.parts, self.size, self.start = [], 0, start

    def add(self, part: str, size: int) -> None:
        self.parts.append(part)
        self.size += size


def chunk_block(text: str, position: int, max_tokens: int, min_tokens: int) -> list[tuple[str, int, int]]:
    """Chunks ``(content, start, end)`` of one block of text that begins at ``position``."""
    out: list[tuple[str, int, int]] = []
    current = _Piece(position)

    def emit(piece: _Piece) -> None:
        out.append(("".join(piece.parts), piece.start, position))

    for section in filter(None, (s.strip() for s in _SECTIONS.split(text))):
        size = _units(section)
        if current.size and (current.size + size) // 4 > max_tokens:
            emit(current)
            current = _Piece(position)
        if size // 4 <= max_tokens:
            current.add(section, size)
            position += size
            continue
        # a section over the limit: its chunks start where they start, the next section's where this one did
        sentences = [s for s in (x.strip() for x in _SENTENCES.split(section)) if s]
        inner = _Piece(position)
        for sentence in sentences:
            width = _units(sentence)
            if inner.size and (inner.size + width) // 4 > max_tokens:
                emit(inner)
                inner = _Piece(position)
            inner.add(sentence, width)
            position += width
            if inner.size // 4 >= min_tokens and sentence == sentences[-1]:
                emit(inner)
                inner = _Piece(position)
        if inner.size:
            emit(inner)
    if current.size:
        emit(current)
    return out


def chunk_text(text: str | None, max_tokens: int = 700, min_tokens: int = 500, flush_chars: int = 700, newline: str = "\n") -> list[tuple[str, int, int]]:
    """Chunks ``(content, start, end)`` of a document; null, empty and blank ones have none."""
    if not text:
        return []
    lines = _LINES.split(text.removeprefix("﻿"))
    if lines[-1] == "":
        lines.pop()
    out: list[tuple[str, int, int]] = []
    buffer, size, position = "", 0, 0
    for line in lines:
        buffer += line + newline
        size += _units(line) + len(newline)
        if size < flush_chars:
            continue
        at = buffer.rfind("\n\n")
        if at <= 0:
            at = buffer.rfind("\n")
        if at > 0:
            out += chunk_block(buffer[:at], position, max_tokens, min_tokens)
            position = out[-1][2] if out else position
            buffer = buffer[at + 1 :]
            size = _units(buffer)
    return out + (chunk_block(buffer, position, max_tokens, min_tokens) if buffer else [])


def chunk(documents: DataFrame, text: str, keys: list[str], max_tokens: int = 700, min_tokens: int = 500, flush_chars: int = 700, newline: str = "\n") -> DataFrame:
    """``keys``, ``chunk_no``, ``content``, ``start_position``, ``end_position``. Only ``keys`` and ``text`` are read."""
    read = documents.select(*keys, F.col(text).alias("__text"))

    def run(batches):
        for pdf in batches:
            rows = [(*key, n, *piece) for *key, body in pdf.itertuples(index=False, name=None) for n, piece in enumerate(chunk_text(body, max_tokens, min_tokens, flush_chars, newline))]
            yield pd.DataFrame(rows, columns=[*keys, "chunk_no", "content", "start_position", "end_position"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1])
    return read.mapInPandas(run, f"{fields}, chunk_no int, content string, start_position int, end_position int")
