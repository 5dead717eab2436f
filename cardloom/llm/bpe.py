"""Byte-level BPE encoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that its encoding ends with. It is the one vocabulary token
among those that end at this position (found by one pass of a suffix-link automaton over the piece) that is
compatible with the last token of the prefix before it: the encoding of the two together is again those two.
Following the stored tokens from the end gives the exact ids, in time proportional to the piece.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import spread

#: Fixed value: the published pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"
#: Bounds of the per-worker caches. They only save time: a cleared cache is filled again.
MAX_PIECES, MAX_PAIRS, LONGEST_CACHED = 300_000, 2_000_000, 64


def _merge_parts(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of ``word`` after all merges of a rank under ``below``."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(4)
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Tokens by id, and for each token the two tokens that its last merge joins (itself twice for one byte).

    A token that merging never makes gets -1: no encoding holds it.
    """
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
    left, right = np.full(len(tokens), -1, np.int32), np.full(len(tokens), -1, np.int32)
    for token, rank in ranks.items():
        tokens[rank] = token
        if len(token) == 1:
            left[rank] = right[rank] = rank
        elif len(parts := _merge_parts(token, ranks, rank)) == 2:
            left[rank], right[rank] = ranks[parts[0]], ranks[parts[1]]
    return tokens, left, right


class Encoder(dict):
    """Maps a piece of text to its ids as packed int32. A missing piece is encoded and, if short, remembered."""

    def __init__(self, tokens: list[bytes], left: np.ndarray, right: np.ndarray):
        super().__init__()
        self.left, self.right = left.tolist(), right.tolist()
        self.joined = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a >= 0 and a != i}
        self.size = [len(t) for t in tokens]
        self.pairs: dict[tuple[int, int], bool] = {}
        automaton = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            if token and self.left[i] >= 0:
                automaton.add_word(token.decode("latin-1"), i)
        automaton.make_automaton()
        self.ending = automaton.iter
        self.pieces = regex.compile(PATTERN).findall

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of ``a`` and ``b`` together is ``[a, b]``.

        Merges are undone from the newest on, on either side of the cut. If at any point the two tokens at the cut
        could have been joined before the merge undone last, merging would have crossed the cut.
        """
        before = len(self.size) + 1
        while True:
            joint = self.joined.get((a, b))
            if joint is not None and joint < before:
                return False
            divisible_a, divisible_b = self.left[a] != a, self.left[b] != b
            if divisible_a and (a > b or not divisible_b):
                before, a = a, self.right[a]
            elif divisible_b:
                before, b = b + 1, self.left[b]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        text, size, pairs, last = piece.decode("latin-1"), self.size, self.pairs, [-1] * (len(piece) + 1)
        for at, token in self.ending(text):
            if last[at + 1] < 0:
                start = at + 1 - size[token]
                if start:
                    pair = (last[start], token)
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= MAX_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.compatible(*pair)
                    if not fits:
                        continue
                last[at + 1] = token
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= size[last[end]]
        return out[::-1]

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.encode_piece(piece.encode("utf-8", "surrogatepass")), np.int32).tobytes()
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text))) if text else b""


_encoders: dict[str, Encoder] = {}


def _worker_encoder(key: str, shared) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*shared.value)
    return _encoders[key]


def encode_column(df: DataFrame, keys: list[str], text: str, as_: str, counts: bool = False, name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS, rows: int = 512) -> DataFrame:
    """``keys`` of ``df`` and the ids of ``text`` (or, with ``counts``, their number) as ``as_``.

    A null or empty text has the empty list (0). Special tokens in a text are ordinary text. Only ``keys`` and
    ``text`` are read, so other columns, whatever their names, never meet the result. The vocabulary goes to the
    executors as one broadcast whose size is that of its file (under 2 MB); texts leave their partition only where the
    input has fewer splits than half the cores.
    """
    path = f"{tokenizers}/{name}.tiktoken"
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        encoder = _worker_encoder(path, shared)
        for whole in batches:
            for batch in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                packed = [encoder.encode(t) for t in batch.column(len(keys)).to_pylist()]
                sizes = [len(p) // 4 for p in packed]
                if counts:
                    column = pa.array(sizes, pa.int64())
                else:
                    offsets = pa.array([0, *accumulate(sizes)], pa.int32())
                    column = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], column], names=[*keys, as_])

    read = spread(df.select(*keys, text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[: len(keys)])
    return read.mapInArrow(run, f"{fields}, `{as_}` {'bigint' if counts else 'array<int>'}")
