"""Words and word hashes of whole Arrow string columns, found on their UTF-8 bytes with numpy.

All functions work on one contiguous byte buffer of several documents, so no Python string is
made per word. Working memory is about 40 bytes per byte of the buffer; callers bound the buffer
with `slices`, which always keeps a document whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1B54A32D192ED03)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)


def byte_class(*excluded: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is False for the given inclusive byte ranges."""
    table = np.ones(256, bool)
    for low, high in excluded:
        table[low:high + 1] = False
    return table


#: Words between white space: ``[^\x20\x09-\x0D]+``.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of ASCII letters and digits and any other script: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer document is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII A-Z in lower case; all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
    """(starts, ends, first word of each document and the total) of the words of a buffer."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = word_bytes[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1]
    before[edges[edges < len(data)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[1:]
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _grown(length: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < length:
        size = max(length, 2 * len(_powers))
        _powers = np.full(size, _BASE)
        _inverses = np.full(size, _BASE_INVERSE)
        _powers[0] = _inverses[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverses, out=_inverses)
    return _powers, _inverses


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of scrambled unit values, the same for the same run anywhere."""
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _grown(len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * power[:len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """`run_hashes` of words of a byte buffer."""
    return run_hashes(_BYTE_VALUES[data], starts, ends)


def shingle_hashes(word: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` consecutive word hashes."""
    if len(word) < width:
        return np.empty(0, np.uint64)
    count = len(word) - width + 1
    out = np.zeros(count, np.uint64)
    steps = np.arange(1, width + 1, dtype=np.uint64) * _GOLDEN
    for k in range(width):
        out = mixed(out + word[k:k + count] + steps[k])
    return out
