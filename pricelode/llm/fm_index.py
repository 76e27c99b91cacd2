"""An FM-index over sequences of symbols, in numpy: backward search of many phrases at once.

The text is a list of segments of symbols 1..sigma, closed by separators that are all different
and smaller than any symbol. The index holds the Burrows-Wheeler transform in a wavelet matrix
(one bit row with rank directory per bit of a symbol) and the suffix positions of every `step`-th
place and of every segment start.
"""

from __future__ import annotations

import numpy as np


class BitRow:
    """A bit vector with rank in constant time: packed words and running counts of ones."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.ones = int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones in front of each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Rank of any symbol in a sequence of symbols below 2**levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.rows, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            row = BitRow(bits)
            self.rows.append(row)
            self.zeros.append(len(symbols) - row.ones)
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often `symbol` stands in front of `at`, for arrays of both."""
        low = np.zeros_like(at)
        for k, row in enumerate(self.rows):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            low_ones, at_ones = row.rank(low), row.rank(at)
            low = np.where(one, self.zeros[k] + low_ones, low - low_ones)
            at = np.where(one, self.zeros[k] + at_ones, at - at_ones)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for k, row in enumerate(self.rows):
            one = row.get(at)
            low_ones, at_ones = row.rank(low), row.rank(at)
            low = np.where(one, self.zeros[k] + low_ones, low - low_ones)
            at = np.where(one, self.zeros[k] + at_ones, at - at_ones)
            symbol = (symbol << 1) | one
        return symbol, at - low


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Start places of the sorted suffixes, by prefix doubling; ends count as smallest."""
    size, width = len(ranks), 1
    order = np.argsort(ranks, kind="stable")
    rank = np.empty(size, np.int64)
    ordered = ranks[order]
    rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
    while size and rank[order[-1]] < size - 1:
        follow = np.zeros(size, np.int64)
        follow[:size - width] = rank[width:] + 1 if width < size else 0
        key = rank * (size + 1) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        width *= 2
    return order


class FMIndex:
    """Counts and locates phrases in the segments of one shard."""

    def __init__(self, symbols: np.ndarray, starts_segment: np.ndarray, sigma: int, step: int = 16):
        """`symbols` has a 0 behind every segment; `starts_segment` marks first places of segments."""
        ends = symbols == 0
        separators = int(ends.sum())
        ranks = symbols.astype(np.int64) + separators
        ranks[ends] = np.arange(separators)
        suffixes = suffix_array(ranks)
        last = symbols[suffixes - 1]  # the place before the first is the last separator
        self.size = len(symbols)
        counts = np.bincount(symbols, minlength=sigma + 2)
        self.first = np.cumsum(counts) - counts
        self.matrix = WaveletMatrix(last.astype(np.int64), max(1, int(sigma).bit_length()))
        sampled = (suffixes % step == 0) | starts_segment[suffixes]
        self.sampled = BitRow(sampled)
        self.places = suffixes[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix rows [low, high) of each phrase; phrases are rows of symbols, aligned at their end."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        for k in range(1, phrases.shape[1] + 1 if len(phrases) else 1):
            active = np.flatnonzero((lengths >= k) & (high > low))
            if not len(active):
                break
            symbol = phrases[active, -k]
            at = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low[active], high[active]]))
            low[active] = self.first[symbol] + at[:len(active)]
            high[active] = self.first[symbol] + at[len(active):]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each suffix row: walk back to a sampled one."""
        place = np.empty(len(rows), np.int64)
        at, left, steps = rows.copy(), np.arange(len(rows)), 0
        while len(left):
            known = self.sampled.get(at)
            place[left[known]] = self.places[self.sampled.rank(at[known])] + steps
            at, left = at[~known], left[~known]
            if len(left):
                symbol, rank = self.matrix.access(at)
                at = self.first[symbol] + rank
                steps += 1
        return place
