"""A full-text index in compressed form: Burrows-Wheeler transform, wavelet matrix and backward search, on numpy.

All searches run over many patterns at once: one step takes the next character of every pattern.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (dense symbols) sorted by at least their first ``depth`` symbols, by prefix doubling."""
    n = len(text)
    bits = int(text.max()).bit_length() + 1 if n else 1
    known = min(max(1, 62 // bits), depth)
    key = np.zeros(n, np.int64)
    for k in range(known):
        key <<= bits
        key[: n - k] |= text[k:].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    while True:
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if known >= depth or (n and rank[order[-1]] == n - 1):
            return order
        key = (rank + 1) << 32
        key[: n - known] |= rank[known:] + 1
        order = np.argsort(key, kind="stable")
        known *= 2


class WaveletMatrix:
    """Rank of any symbol in a sequence: one bit vector for each bit of the symbols, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        for level in reversed(range(self.levels)):
            bit = (now >> level) & 1
            padded = np.zeros((len(now) // 64 + 1) * 64, np.uint8)
            padded[: len(now)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words)))).astype(np.int64))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        top = int(symbols.max()) + 1 if len(symbols) else 1
        self.begin = self._walk(np.arange(top), np.zeros(top, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        for i, level in enumerate(reversed(range(self.levels))):
            word = at >> 6
            below = (one << (at & 63).astype(np.uint64)) - one
            ones = self.counts[i][word] + np.bitwise_count(self.words[i][word] & below)
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before it."""
        one, symbol, at = np.uint64(1), np.zeros(len(at), np.int64), at.copy()
        for i in range(self.levels):
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            bit = ((self.words[i][word] >> shift) & one).astype(np.int64)
            ones = self.counts[i][word] + np.bitwise_count(self.words[i][word] & ((one << shift) - one))
            at = np.where(bit, self.zeros[i] + ones, at - ones)
            symbol = symbol << 1 | bit
        return symbol, at - self.begin[symbol]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbol, at) - self.begin[symbol]


#: One in so many places of the text is kept, and the first of every text; a suffix that begins elsewhere finds its
#: place by going back to one. It never goes back over a separator: these stand for each other, and the last one has the
#: beginning of the whole behind it, so a step over one can lead to another text.
SAMPLE = 8


class FMIndex:
    """Index of a sequence of dense symbols (0 separates texts and is in no pattern).

    Held are the transform's wavelet matrix, the counts of the symbols and the sampled places of suffixes; neither the
    text nor the order of its suffixes.
    """

    def __init__(self, text: np.ndarray):
        order = suffix_order(text, max(1, len(text)))  # whole, so that going back inside a text is exact
        self.size = len(order)
        before = text[order - 1]
        self.occurrences = WaveletMatrix(before)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))))
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept, self.places = np.packbits(kept, bitorder="little"), order[kept].astype(np.int32)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.kept)))).astype(np.int32)

    def places_of(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of the given rows begin."""
        out, left, rows = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        for steps in range(SAMPLE):
            byte, shift = rows >> 3, (rows & 7).astype(np.uint8)
            held = (self.kept[byte] >> shift) & 1 > 0
            number = self.before[byte[held]] + np.bitwise_count(self.kept[byte[held]] & ((np.uint8(1) << shift[held]) - np.uint8(1)))
            out[left[held]] = self.places[number].astype(np.int64) + steps
            left, rows = left[~held], rows[~held]
            if not len(left):
                break
            symbol, rank = self.occurrences.access(rows)
            rows = self.first[symbol] + rank
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the interval of suffixes that begin with it; symbols below 0 are not in the text."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            held = symbol > 0
            if not held.all():
                low[live[~held]] = high[live[~held]] = 0
                live, symbol = live[held], symbol[held]
            if not len(live):
                break
            both = self.occurrences.rank(np.concatenate((symbol, symbol)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.first[symbol] + both[: len(live)], self.first[symbol] + both[len(live) :]
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions in the intervals, and the row of each."""
        sizes = np.maximum(high - low, 0)
        row = np.repeat(np.arange(len(low)), sizes)
        within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.places_of(low[row] + within), row
