"""A bounded table of distinct chunks: 64-bit chunk hash to a short list of ids, all in numpy.

A lookup is a few vectorised probes for a whole batch of chunks; only chunks that the table has
not seen reach the segmenter. Two different chunks are confused only when their 64-bit hashes
are equal.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class ChunkTable:
    """At most `limit` chunks beyond those of `known`; a batch that would pass it starts the table anew."""

    def __init__(self, limit: int, known: Callable | None = None, extra: Callable | None = None):
        self.limit, self.known, self.extra = limit, known, extra
        self._clear()

    def _clear(self) -> None:
        self.size = 0
        self._resize(1 << 16)
        self.lengths = np.empty(1 << 15, np.int32)
        self.offsets = np.empty(1 << 15, np.int64)
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0
        self.extras: list = []
        if self.known is not None:
            self._add(*self.known())
        self.base = self.size

    def _resize(self, slots: int) -> None:
        self.mask = np.uint64(slots - 1)
        self.keys = np.zeros(slots, np.uint64)
        self.row = np.full(slots, -1, np.int32)

    def _place(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        """Put distinct, absent hashes into free slots (linear probing, all at once)."""
        slot = hashes & self.mask
        while len(hashes):
            free = self.row[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[at] = hashes[chosen]
            self.row[at] = rows[chosen]
            left = np.ones(len(hashes), bool)
            left[chosen] = False
            hashes, rows = hashes[left], rows[left]
            slot = (slot[left] + np.uint64(1)) & self.mask

    def _add(self, hashes: np.ndarray, ids: list) -> None:
        count = len(hashes)
        if not count:
            return
        while 2 * (self.size + count) > len(self.keys):
            taken = self.row >= 0
            keys, rows = self.keys[taken], self.row[taken]
            self._resize(4 * len(self.keys))
            self._place(keys, rows)
        lengths = np.fromiter(map(len, ids), np.int32, count)
        total = int(lengths.sum())
        if self.size + count > len(self.lengths):
            grow = max(self.size + count, 2 * len(self.lengths))
            self.lengths = np.concatenate([self.lengths[:self.size], np.empty(grow - self.size, np.int32)])
            self.offsets = np.concatenate([self.offsets[:self.size], np.empty(grow - self.size, np.int64)])
        if self.used + total > len(self.flat):
            grow = max(self.used + total, 2 * len(self.flat))
            self.flat = np.concatenate([self.flat[:self.used], np.empty(grow - self.used, np.int32)])
        self.flat[self.used:self.used + total] = np.fromiter((i for x in ids for i in x), np.int32, total)
        self.lengths[self.size:self.size + count] = lengths
        self.offsets[self.size:self.size + count] = self.used + np.cumsum(lengths) - lengths
        if self.extra is not None:
            self.extras += [self.extra(x) for x in ids]
        self._place(hashes, np.arange(self.size, self.size + count, dtype=np.int32))
        self.size += count
        self.used += total

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, np.int32)
        open_, slot = None, hashes & self.mask
        while True:
            row = self.row[slot]
            hit = (row >= 0) & (self.keys[slot] == hashes)
            on = (row >= 0) & ~hit
            if open_ is None:
                found[hit] = row[hit]
                open_ = np.flatnonzero(on)
            else:
                found[open_[hit]] = row[hit]
                open_ = open_[on]
            if not len(open_):
                return found
            hashes, slot = hashes[on], (slot[on] + np.uint64(1)) & self.mask

    def rows(self, hashes: np.ndarray, segment: Callable[[np.ndarray], list]) -> np.ndarray:
        """The table row of each chunk; `segment(positions)` gives the ids of chunks not yet in it."""
        found = self._find(hashes)
        if (found < 0).any():
            new, at = self._absent(found, hashes)
            if self.size - self.base + len(new) > self.limit and self.size > self.base:
                self._clear()
                found = self._find(hashes)
                new, at = self._absent(found, hashes)
            self._add(new, segment(at))
            missing = found < 0
            found[missing] = self._find(hashes[missing])
        return found

    @staticmethod
    def _absent(found: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.flatnonzero(found < 0)
        new, first = np.unique(hashes[where], return_index=True)
        return new, where[first]

    def values(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in order, end of each chunk's ids)."""
        lengths = self.lengths[rows].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.offsets[rows] - ends + lengths, lengths)
        at += np.arange(total)
        return self.flat[at], ends
