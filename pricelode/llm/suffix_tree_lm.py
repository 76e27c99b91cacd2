r"""Language-model scores from a probabilistic suffix tree over words.

Tokens are the words ``[^\x20\x09-\x0D]+`` of a text in lower ASCII case, then one end. Counts of
all tokens give the base distribution (c + 1) / (N + V + 1), which is also the tree's root.

The tree grows with the corpus. A context (the last 1 to `DEPTH` words of the text, any words) is a
candidate when it occurs `LEAST_CONTEXT` times; its next-token counts are kept from `LEAST_ENTRY`
on. Both are fixed numbers, so a context that is a candidate stays one in a larger corpus. A
candidate is retained when the divergence of its smoothed distribution from that of its suffix,
times its count, exceeds half a logarithm of the count per kept entry. Distributions are smoothed
by absolute discounting: what is taken off the counts, and the mass of entries that aren't kept,
goes to the suffix's distribution, so each sums to 1. A token is scored in the longest retained
suffix of what stands before it.

Contexts and entries are Spark tables keyed by the hash of their words; entries meet their context
and their suffix's entry by joins. A score is a sum over keys: the token's base logarithm, for each
retained context in front of it the logarithm of the mass it hands down, and for each kept entry
what it adds to that. Each occurrence of a run of words is an entry's and, if not at its text's end,
a context's, so one key asks for both. Counts of runs and the keys that texts ask for leave a task
sorted and packed by range of keys; texts are asked in `SLICES`, so only one slice's keys are on disk.

Shortcuts of a fixed size change the cost and never a result: the `HEAD` most frequent tokens and
`TREE_HEAD` most frequent tree keys are sent to the tasks, all others are asked for; bit tables tell
most keys that no table has. Counting passes combine inside their task before the shuffle, runs of a
`HOT` context are dealt by what follows, and the joins broadcast the `JOIN_HEAD` keys with most rows,
so no key that is shuffled is hot.

`train_suffix_tree` is the same tree in the driver's memory, over the most frequent tokens and with
thresholds that are shares of the corpus; scoring doesn't use it.

Words are told apart by 64-bit hashes. Defined cases: a null or wordless text is one end; null ids
are learned from; repeated rows count and score row by row; an empty table stays empty; with
nothing to learn from, every token has probability 1 / (0 + 0 + 1).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_tables, fetched, stage_table
from .bytescan import SPACED, lowered, mixed, slices, utf8, word_hashes, words
from .common import column, small_batches

SYMBOLS = 1 << 14
HEAD = 1 << 18
TREE_HEAD = 1 << 20
JOIN_HEAD = 1 << 18
#: Occurrences from which the runs of a context are dealt by what follows.
HOT = 1 << 20
#: Slices of the texts that are scored one after the other.
SLICES = 4
DEPTH = 3
CONTEXT_SHARE, LEAST_CONTEXT = 2.0 ** -17, 8
ENTRY_SHARE, LEAST_ENTRY = 2.0 ** -19, 2
DISCOUNT = 0.75

#: The end token's hash; no word has it, as word hashes of this value are moved by one.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
_WAITING = 1_200_000


class HashIndex:
    """Row of each of many 64-bit keys (distinct), by open addressing in numpy; -1 for others."""

    def __init__(self, keys: np.ndarray):
        slots = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64(slots - 1)
        self.keys, self.row = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        rows, slot = np.arange(len(keys), dtype=np.int32), mixed(keys) & self.mask
        while len(keys):
            free = self.row[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[at], self.row[at] = keys[chosen], rows[chosen]
            left = np.ones(len(keys), bool)
            left[chosen] = False
            keys, rows, slot = keys[left], rows[left], (slot[left] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int32)
        at, slot = np.arange(len(keys)), mixed(keys) & self.mask
        while len(at):
            row = self.row[slot]
            hit = (row >= 0) & (self.keys[slot] == keys)
            found[at[hit]] = row[hit]
            on = (row >= 0) & ~hit
            at, keys, slot = at[on], keys[on], (slot[on] + np.uint64(1)) & self.mask
        return found


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts of a buffer, each text closed by END, and the texts' borders."""
    low = lowered(data)
    starts, ends, first = words(low, offsets, SPACED)
    hashes = word_hashes(low, starts, ends)
    hashes[hashes == END] += np.uint64(1)
    closed = np.insert(hashes, first[1:], END)
    return closed, first + np.arange(len(first))


def _scan(docs: DataFrame, make: Callable, schema: str, finish: Callable | None = None) -> DataFrame:
    """`make(ids, tokens, borders)` over slices of whole texts; its rows and those of `finish()`."""
    small_batches(docs.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                part = offsets[a:b + 1] - offsets[a]
                made = make(state, batch.column(0)[a:b], *_tokens(data[offsets[a]:offsets[b]], part))
                if made is not None:
                    yield pa.RecordBatch.from_arrays(made, names=names)
        if finish is not None:
            made = finish(state)
            if made is not None:
                yield pa.RecordBatch.from_arrays(made, names=names)
        state.clear()
        pa.default_memory_pool().release_unused()  # the worker goes on with other tasks

    return docs.select("id", "text").mapInArrow(run, schema)


def _counted(docs: DataFrame, keys: Callable) -> DataFrame:
    """(key, n) of `keys(tokens, borders)` over all texts, combined in the task, then by key."""
    def collapse(state: dict) -> None:
        if state.get("parts"):
            key, at = np.unique(np.concatenate([k for k, _ in state["parts"]]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n for _, n in state["parts"]])).astype(np.int64)
            state["parts"], state["size"] = [(key, n)], len(key)

    def make(state: dict, ids, tokens, borders):
        key, n = np.unique(keys(tokens, borders), return_counts=True)
        state.setdefault("parts", []).append((key, n))
        state["size"] = state.get("size", 0) + len(key)
        if state["size"] > _WAITING:
            collapse(state)
            if state["size"] > _WAITING:  # still many different keys: hand them on
                key, n = state["parts"].pop()
                state["size"] = 0
                return [pa.array(key.view(np.int64)), pa.array(n)]
        return None

    def finish(state: dict):
        collapse(state)
        if not state.get("parts"):
            return None
        key, n = state["parts"][0]
        return [pa.array(key.view(np.int64)), pa.array(n)]

    return _scan(docs, make, "key long, n long", finish).groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Depth:
    """The tree at one depth: context keys (prefix context, symbol) and entry keys (context, next symbol)."""

    contexts: np.ndarray
    entries: np.ndarray
    log_entry: np.ndarray = field(default_factory=lambda: np.empty(0))
    log_rest: np.ndarray = field(default_factory=lambda: np.empty(0))
    retained: np.ndarray = field(default_factory=lambda: np.empty(0, bool))


@dataclass
class SuffixTree:
    """The trained model; bounded by SYMBOLS, HEAD and the two shares."""

    total: int
    distinct: int
    head: np.ndarray
    head_count: np.ndarray
    symbols: int
    other_mass: float
    depths: list[Depth]
    name: str = ""

    @property
    def width(self) -> np.uint64:
        return np.uint64(self.symbols + 1)

    def root(self) -> np.ndarray:
        """log10 probability of each symbol and, last, of the class of all other words."""
        known = np.append(self.head_count[:self.symbols] + 1.0, self.other_mass)
        return np.log10(known / (self.total + self.distinct + 1))

    def index(self) -> tuple[HashIndex, list[tuple[HashIndex, HashIndex]]]:
        return HashIndex(self.head), [(HashIndex(d.contexts), HashIndex(d.entries)) for d in self.depths]

    def states(self, indexes, symbol: np.ndarray, borders: np.ndarray, depth: int) -> list[np.ndarray]:
        """Per depth from 1 on, the candidate context in front of every token, or -1."""
        out, last = [], np.zeros(len(symbol), np.int32)
        opening = borders[:-1]
        for d in range(depth):
            shifted = np.full(len(symbol), -1, np.int32)
            shifted[1:] = last[:-1] if d else 0
            shifted[opening] = -1
            spoken = np.full(len(symbol), self.symbols, np.int64)
            spoken[1:] = symbol[:-1]
            able = np.flatnonzero((shifted >= 0) & (spoken < self.symbols))
            state = np.full(len(symbol), -1, np.int32)
            key = shifted[able].astype(np.uint64) * self.width + spoken[able].astype(np.uint64)
            state[able] = indexes[d][0].find(key)
            out.append(state)
            last = state
        return out


def _symbols(tree: SuffixTree, head: HashIndex, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The head row of each token (-1: rarer) and its symbol (the last: any other word)."""
    row = head.find(tokens)
    return row, np.where((row < 0) | (row >= tree.symbols), tree.symbols, row).astype(np.int64)


_indexes: dict = {}


def _indexed(tree: SuffixTree):
    """Lookup tables of a tree, built once in each worker process."""
    if tree.name not in _indexes:
        _indexes.clear()
        _indexes[tree.name] = tree.index()
    return _indexes[tree.name]


def _columns(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The columns key and n of a bounded table, without Python objects for its rows."""
    found = fetched(rows.select("key", "n"))
    return found["key"].to_numpy(), found["n"].to_numpy()


def _often(counts: DataFrame, head: int, n: str = "n") -> Column:
    """Condition on the column `n` that holds for the largest values, in at most `head` rows of `counts`.

    The bar comes from a histogram of counts on a logarithmic scale (under a thousand rows), so
    the driver gets the head alone and no candidates of each task.
    """
    step = F.floor(F.log2(F.col(n).cast("double")) * 16)
    held, bar = 0, None
    steps = fetched(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")))
    for value, k in sorted(zip(steps["step"].to_pylist(), steps["k"].to_pylist(), strict=True), reverse=True):
        held += k
        if held >= head:
            break
        bar = value
    return step >= bar if bar is not None else F.lit(False)


def _frequent(counts: DataFrame, end: int, head: int) -> DataFrame:
    """The end and all tokens from a count on, at most `head` of them."""
    return counts.where((F.col("key") == end) | _often(counts, head))


def train_suffix_tree(docs: DataFrame, depth: int = DEPTH, symbols: int = SYMBOLS,
                      head: int = HEAD) -> tuple[SuffixTree, DataFrame]:
    """The tree, and the table (key, n) of all token counts; `docs` has columns id and text."""
    counts = stage_table(_counted(docs, lambda tokens, borders: tokens), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    end = int(END.astype(np.int64))
    keys, number = _columns(_frequent(counts, end, head))
    order = np.lexsort((keys, -number, keys != end))  # the end is always among the symbols
    keys, number = keys[order].view(np.uint64), number[order]
    used = min(symbols, len(keys))
    other = total + distinct + 1 - float((number[:used] + 1).sum())
    tree = SuffixTree(total, distinct, keys, number, used, other, [])
    least_context = max(LEAST_CONTEXT, CONTEXT_SHARE * total)
    least_entry = max(LEAST_ENTRY, ENTRY_SHARE * total)
    able = np.flatnonzero((keys[:used] != END) & (number[:used] >= least_context))
    contexts, sizes = able.astype(np.uint64), number[able].astype(float)
    suffixes = np.full(len(able), -1)
    for d in range(1, depth + 1):
        if not len(contexts):
            break
        tree.depths.append(Depth(contexts, np.empty(0, np.uint64)))
        tree.name = uuid.uuid4().hex

        def transitions(tokens: np.ndarray, borders: np.ndarray, tree=tree, d=d) -> np.ndarray:
            words_, depths = _indexed(tree)
            _, symbol = _symbols(tree, words_, tokens)
            state = tree.states(depths, symbol, borders, d)[d - 1]
            at = np.flatnonzero(state >= 0)
            return state[at].astype(np.uint64) * tree.width + symbol[at].astype(np.uint64)

        # Entries with at least ENTRY_SHARE of all tokens: at most 1 / ENTRY_SHARE rows.
        entries, number = _columns(_counted(docs, transitions).where(F.col("n") >= least_entry))
        order = np.argsort(entries)
        entries, number = entries[order].view(np.uint64), number[order].astype(float)
        tree.depths[-1] = _fitted(tree, contexts, entries, number, sizes, suffixes)
        context, symbol = (entries // tree.width).astype(np.int64), (entries % tree.width).astype(np.int64)
        spoken = symbol < used
        spoken[spoken] = keys[symbol[spoken]] != END
        deeper = np.flatnonzero(spoken & (number >= least_context))
        before = suffixes[context[deeper]]  # the suffix of a longer context ends in the same symbol
        parents = np.where(before < 0, 0, before).astype(np.uint64) * tree.width + symbol[deeper].astype(np.uint64)
        place = HashIndex(contexts).find(parents if d > 1 else symbol[deeper].astype(np.uint64))
        contexts, sizes, suffixes = entries[deeper], number[deeper], place.astype(np.int64)
        known = suffixes >= 0
        contexts, sizes, suffixes = contexts[known], sizes[known], suffixes[known]
    tree.name = uuid.uuid4().hex
    return tree, counts


def _fitted(tree: SuffixTree, contexts: np.ndarray, entries: np.ndarray, number: np.ndarray,
            sizes: np.ndarray, suffixes: np.ndarray) -> Depth:
    """Smoothed distributions of one depth and which contexts pass the divergence test."""
    context, symbol = (entries // tree.width).astype(np.int64), (entries % tree.width).astype(np.int64)
    many = len(contexts)
    kept = np.bincount(context, minlength=many)
    held = np.bincount(context, weights=number, minlength=many)
    rest = np.clip((DISCOUNT * kept + sizes - held) / sizes, 1e-12, 1.0)
    lower = _log(tree, suffixes[context], symbol, len(tree.depths) - 1)
    chance = np.clip(number - DISCOUNT, 0, None) / sizes[context] + rest[context] * 10.0 ** lower
    gain = np.bincount(context, weights=number * (np.log(chance) - lower * np.log(10)), minlength=many)
    gain += (sizes - held) * np.log(rest)
    retained = gain > kept * np.log(np.maximum(sizes, 2)) / 2
    return Depth(contexts, entries, np.log10(chance), np.log10(rest), retained & (kept > 0))


def _log(tree: SuffixTree, context: np.ndarray, symbol: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of symbols after contexts of one depth, falling back to their suffixes."""
    if depth == 0:
        return tree.root()[symbol]
    level = tree.depths[depth - 1]
    lower = _log(tree, _suffixes(tree, depth)[context], symbol, depth - 1)
    row = HashIndex(level.entries).find(context.astype(np.uint64) * tree.width + symbol.astype(np.uint64))
    value = np.where(row >= 0, level.log_entry[row] if len(level.log_entry) else 0.0, level.log_rest[context] + lower)
    return np.where(level.retained[context], value, lower)


def _suffixes(tree: SuffixTree, depth: int) -> np.ndarray:
    """For each context of a depth, its suffix one shorter (any number at depth 1)."""
    keys = tree.depths[depth - 1].contexts
    if depth == 1:
        return np.zeros(len(keys), np.int64)
    prefix, symbol = (keys // tree.width).astype(np.int64), keys % tree.width
    if depth == 2:
        return HashIndex(tree.depths[0].contexts).find(symbol).astype(np.int64)
    shorter = _suffixes(tree, depth - 1)[prefix].astype(np.uint64)
    return HashIndex(tree.depths[depth - 2].contexts).find(shorter * tree.width + symbol).astype(np.int64)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Words of 64 bits in a bit table (16 MB).
_BIT_WORDS = 1 << 21


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long."""
    def turned(y: np.ndarray, by: int) -> np.ndarray:
        return (y << np.uint64(by)) | (y >> np.uint64(64 - by))

    h = (seed + _P5 + np.uint64(8)) ^ (turned(x * _P2, 31) * _P1)
    h = turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def gram_keys(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Keys of word runs from those of the runs without their last and first word: xxhash64(prefix, suffix)."""
    return _hash_long(suffix, _hash_long(prefix, np.full(1, 42, np.uint64)))


def _runs(tokens: np.ndarray, borders: np.ndarray, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the runs of 1 to `depth` tokens that end at each token, and the token's place in its text."""
    place = np.arange(len(tokens)) - np.repeat(borders[:-1], np.diff(borders))
    keys = [tokens]
    for d in range(1, depth):
        at = np.flatnonzero(place >= d)
        longer = np.zeros(len(tokens), np.uint64)
        longer[at] = gram_keys(keys[-1][at - 1], keys[-1][at])
        keys.append(longer)
    return keys, place


class Bits:
    """A bit table of keys, of fixed size: False only for keys that aren't among them."""

    def __init__(self, keys: DataFrame, size: int = _BIT_WORDS):
        word = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(size - 1))
        bit = F.expr("shiftleft(1L, cast(key & 63 AS int))")
        rows = fetched(keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")))
        self.bits = np.zeros(size, np.uint64)
        self.bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    def may(self, keys: np.ndarray) -> np.ndarray:
        word = self.bits[((keys >> np.uint64(6)) & np.uint64(len(self.bits) - 1)).astype(np.int64)]
        return (word >> (keys & np.uint64(63))) & np.uint64(1) > 0


def _met(rows: DataFrame, table: DataFrame, on: str, most: str) -> DataFrame:
    """Inner join with a table of distinct keys, of which those largest by `most` are broadcast.

    `most` orders the keys by (a bound of) their number of rows; it isn't part of the result.
    """
    often = _often(table, JOIN_HEAD, most)
    few, rest = table.where(often).drop(most), table.where(~often).drop(most)
    near = rows.join(F.broadcast(few.withColumn("_near", F.lit(True))), on, "left")
    names = [*rows.columns, *(c for c in few.columns if c != on)]
    far = near.where("_near IS NULL").select(rows.columns).join(rest, on)
    return near.where("_near").select(names).unionByName(far.select(names))


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 64 bits, the first sorted, as compressed bytes: steps of the first, bytes of one place together."""
    rows = np.stack([x.view(np.uint64) for x in columns])
    rows[0, 1:] -= rows[0, :-1].copy()
    planes = rows.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, many: int) -> list[np.ndarray]:
    """The `many` columns of `size` rows that `_packed` was given."""
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * size * many, codec="zstd", asbytes=True), np.uint8)
    rows = np.ascontiguousarray(planes.reshape(many, 8, size).transpose(0, 2, 1)).view(np.uint64).reshape(many, size)
    return [np.cumsum(rows[0], dtype=np.uint64), *rows[1:]]


#: Rows of `_dealt` and their kinds, and the sums of texts.
_DEALT = "part int, kind int, size int, data binary"
_MODEL, _TEXTS, _ASKED = range(3)
_SUMS = "row long, id long, n_tokens long, known long, plus double, value double"


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of 64-bit keys, of `parts` equal ones, in which each key lies."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _dealt(part: np.ndarray, columns: list[np.ndarray], parts: int, kind: int = _MODEL) -> list[tuple]:
    """A packed row for each part; the rows are in the order of their parts and, within each, of the first column."""
    at = np.searchsorted(part, np.arange(parts + 1))
    return [(int(k), kind, int(at[k + 1] - at[k]), _packed([x[at[k]:at[k + 1]] for x in columns]))
            for k in np.flatnonzero(np.diff(at))]


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)]


def _joined(parts: list) -> list[np.ndarray]:
    """The columns of all parts; the list is emptied, so they aren't held twice."""
    columns = [list(x) for x in zip(*parts, strict=True)]
    parts.clear()
    return [np.concatenate(columns.pop(0)) for _ in range(len(columns))]


def _summed(parts: list) -> tuple[np.ndarray, ...]:
    """Each run (prefix, suffix) once, with the sum of its counts."""
    prefix, suffix, n = _joined(parts)
    key = gram_keys(prefix, suffix)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    at = order[first]
    return prefix[at], suffix[at], np.add.reduceat(n[order], first) if len(first) else n


def _entries(docs: DataFrame, d: int, bits: Broadcast, hot: np.ndarray, least: int) -> DataFrame:
    """(prefix, suffix, n) of the runs of d + 1 tokens with n >= `least`, save those that can't be kept if the bit tables (of prefixes, of suffixes) tell.

    Counts of a task go to a range of prefixes, those of a `hot` prefix to a range of suffixes.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = np.sort(hot)

    def add(state: dict) -> None:
        if len(state.get("parts", [])) > 1:
            state["parts"] = [_summed(state["parts"])]
        state["size"] = len(state["parts"][0][0]) if state.get("parts") else 0

    def rows(state: dict):
        prefix, suffix, n = state["parts"].pop()
        state["size"] = 0
        often = hot[np.searchsorted(hot, prefix).clip(0, len(hot) - 1)] == prefix if len(hot) else np.zeros(len(prefix), bool)
        by = np.where(often, suffix, prefix)
        order = np.argsort(by)
        return _arrays(_dealt(_part(by[order], parts), [x[order] for x in (prefix, suffix, n)], parts))

    def make(state: dict, ids, tokens, borders):
        _indexes.clear()
        wide, seen = bits.value
        keys, place = _runs(tokens, borders, d)
        at = np.flatnonzero(place >= d)
        prefix, suffix = keys[-1][at - 1], keys[-1][at]
        kept = wide.may(prefix) & seen.may(suffix)
        prefix, suffix = prefix[kept], suffix[kept]
        state.setdefault("parts", []).append((prefix, suffix, np.ones(len(prefix), np.uint64)))
        state["size"] = state.get("size", 0) + len(prefix)
        if state["size"] > _WAITING:
            add(state)
            if 2 * state["size"] > _WAITING:
                return rows(state)
        return None

    def finish(state: dict):
        add(state)
        return rows(state) if state.get("parts") else None

    def fold(table: pa.Table) -> pa.Table:
        found = [_unpacked(data.as_py(), size.as_py(), 3) for size, data in zip(table["size"], table["data"], strict=True)]
        prefix, suffix, n = _summed(found)
        at = np.flatnonzero(n.view(np.int64) >= least)
        at = at[np.argsort(prefix[at])]  # a context's entries lie together
        return pa.table([pa.array(prefix[at].view(np.int64)), pa.array(suffix[at].view(np.int64)), pa.array(n[at].view(np.int64))],
                        names=["prefix", "suffix", "n"])

    made = _scan(docs, make, _DEALT, finish)
    return made.groupBy("part").applyInArrow(fold, "prefix long, suffix long, n long")


@dataclass
class SuffixTables:
    """The trained model: (key, n, plus, value) of runs of words, where the rows of a key add up.

    `counts` has all tokens and contexts of one word, `tree` the entries and longer contexts; `contexts` has the keys of
    all contexts. A run has one key as an entry and as a context, as each of its occurrences is both.
    """

    total: int
    distinct: int
    counts: DataFrame
    tree: DataFrame
    contexts: DataFrame


def train_suffix_tables(docs: DataFrame, depth: int = DEPTH, least_context: int = LEAST_CONTEXT,
                        least_entry: int = LEAST_ENTRY) -> SuffixTables:
    """The tree over all words as Spark tables; `docs` has columns id and text."""
    def single(tokens: np.ndarray, borders: np.ndarray) -> np.ndarray:
        _indexes.clear()  # an earlier model's, in a worker that is used again
        return tokens

    counts = stage_table(_counted(docs, single), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    base = float(np.log10(total + distinct + 1))
    plus = F.log10(F.col("n") + 1.0)
    below = counts.select("key", "n", (plus - base).alias("log"))
    tree, words_, every = [], [counts.select("key", "n", plus.alias("plus"), F.lit(0.0).alias("value"))], []
    for d in range(1, depth + 1):
        wide = below.where(F.col("n") >= least_context)
        bits = docs.sparkSession.sparkContext.broadcast(
            (Bits(wide.select("key")), Bits(below.where(F.col("n") >= least_entry).select("key"))))
        hot = fetched(wide.where(F.col("n") >= HOT).select("key"))["key"].to_numpy().view(np.uint64)
        found = stage_table(_entries(docs, d, bits, hot, least_entry), "tree-entries")
        bits.destroy()
        sizes = found.groupBy("prefix").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("held"))
        sizes = sizes.join(wide.select(F.col("key").alias("prefix"), F.col("n").alias("size")), "prefix")
        rest = (DISCOUNT * F.col("kept") + F.col("size") - F.col("held")) / F.col("size")
        rest = F.least(F.greatest(rest, F.lit(1e-12)), F.lit(1.0))
        sizes = stage_table(sizes.withColumn("rest", rest), "tree-contexts")
        rows = _met(found, sizes.select("prefix", "size", "rest", "kept"), "prefix", "kept")
        rows = _met(rows, below.select(F.col("key").alias("suffix"), F.col("log").alias("lower"),
                                         F.col("n").alias("most")), "suffix", "most")
        chance = (F.col("n") - DISCOUNT) / F.col("size") + F.col("rest") * F.pow(F.lit(10.0), F.col("lower"))
        rows = stage_table(rows.select("prefix", F.xxhash64("prefix", "suffix").alias("key"), "n", "lower",
                                       F.log10(chance).alias("log")), "tree-fitted")
        gain = rows.groupBy("prefix").agg(F.sum(F.col("n") * (F.col("log") - F.col("lower"))).alias("gain"))
        enough = (F.col("gain") * float(np.log(10)) + (F.col("size") - F.col("held")) * F.log("rest")
                  > F.col("kept") * F.log(F.greatest("size", F.lit(2))) / 2)
        judged = sizes.join(gain, "prefix").select("prefix", "size", "kept", F.log10("rest").alias("handed"),
                                                   enough.alias("retained"))
        judged = stage_table(judged, "tree-judged")
        fitted, rows = rows, _met(rows, judged.drop("size"), "prefix", "kept")
        # The entry's own logarithm where its context is retained, and what it has over the mass handed down.
        rows = stage_table(rows.select(
            "key", "n", F.when(F.col("retained"), F.col("log")).otherwise(F.col("lower")).alias("log"),
            F.when(F.col("retained"), F.col("log") - F.col("handed") - F.col("lower")).alias("value")), "tree-level")
        drop_tables(found, sizes, fitted)
        contexts = judged.where("retained").select(
            F.col("prefix").alias("key"), F.col("size").alias("n"), F.lit(0.0).alias("plus"), F.col("handed").alias("value"))
        entries = rows.where("value IS NOT NULL").select("key", "n", F.lit(0.0).alias("plus"), "value")
        (words_ if d == 1 else tree).append(contexts)
        tree.append(entries)
        every.append(contexts.select("key"))
        below = rows.select("key", "n", "log")
    made = [reduce(DataFrame.unionByName, parts) for parts in (words_, tree, every)]
    return SuffixTables(total, distinct, *made)


#: Rows of an Arrow batch of the model, which are short.
_MODEL_ROWS = 1 << 16


def _model_rows(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (key, plus, value) of the model, dealt by key."""
    names = [part.split()[0] for part in _DEALT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []

        def handed() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            waiting.clear()
            order = np.argsort(columns[0])
            columns = [x[order] for x in columns]
            return pa.RecordBatch.from_arrays(_arrays(_dealt(_part(columns[0], parts), columns, parts)), names=names)

        for batch in batches:
            waiting.append([x.to_numpy().view(np.uint64) for x in batch.columns])
            if len(waiting) * _MODEL_ROWS > _WAITING:
                yield handed()
        if waiting:
            yield handed()

    return rows.select("key", "plus", "value").mapInArrow(run, _DEALT)


def _answered(table: pa.Table) -> pa.Table:
    """Rows of sums by text: those known already and those of what the model has for the keys asked in a part."""
    size, kind = table["size"].to_numpy(), table["kind"].to_numpy()

    def parts(wanted: int, many: int) -> Iterator[list[np.ndarray]]:
        return (_unpacked(table["data"][int(k)].as_py(), int(size[k]), many) for k in np.flatnonzero(kind == wanted))

    none = np.empty(0, np.uint64)
    key, plus, value = (np.concatenate([none, *x]) for x in zip([none] * 3, *parts(_MODEL, 3), strict=True))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    plus, value = (np.add.reduceat(x.view(np.float64)[order], first) if len(key) else np.empty(0) for x in (plus, value))
    key = key[first]
    made = []
    for row, id_, has, n_tokens, known, plus_, value_ in parts(_TEXTS, 7):
        made.append([pa.array(row.view(np.int64)), pa.array(id_.view(np.int64), mask=has == 0), pa.array(n_tokens.view(np.int64)),
                     pa.array(known.view(np.int64)), pa.array(plus_.view(np.float64)), pa.array(value_.view(np.float64))])
    for asked, row in parts(_ASKED, 2) if len(key) else ():
        at = np.searchsorted(key, asked).clip(0, len(key) - 1)
        hit = np.flatnonzero(key[at] == asked)
        at, least = at[hit], row.min()
        of = (row[hit] - least).astype(np.int64)  # a task's rows follow each other
        row = np.flatnonzero(np.bincount(of))
        known, plus_, value_ = (np.bincount(of, x[at])[row] for x in (plus > 0, plus, value))
        row = row.astype(np.uint64) + least
        made.append([pa.array(row.view(np.int64)), pa.nulls(len(row), pa.int64()), pa.array(np.zeros(len(row), np.int64)),
                     pa.array(known.astype(np.int64)), pa.array(plus_, pa.float64()), pa.array(value_, pa.float64())])
    names = [part.split()[0] for part in _SUMS.split(", ")]
    types = [pa.int64()] * 4 + [pa.float64()] * 2
    return pa.table([pa.chunked_array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)]
                    if made else [pa.array([], t) for t in types], names=names)


def _asked(docs: DataFrame, head: Broadcast, depth: int, parts: int) -> DataFrame:
    """Packed sums of each text over the broadcast `head`, and the keys that it must ask for, by the texts' row numbers."""
    name = uuid.uuid4().hex

    def handed(state: dict):
        columns, (key, row) = _joined(state["texts"]), _joined(state["asked"])
        state["size"] = 0
        order = np.argsort(key)
        key, row = key[order], row[order]
        part = np.full(len(columns[0]), int(columns[0][0]) % parts)
        return _arrays(_dealt(part, columns, parts, _TEXTS) + _dealt(_part(key, parts), [key, row], parts, _ASKED))

    def make(state: dict, ids, tokens, borders):
        keys, plus_of, value_of, contexts, entries = head.value
        if name not in _indexes:
            _indexes.clear()
            _indexes[name] = HashIndex(keys)
        index = _indexes[name]
        first = state.setdefault("row", (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        state["row"] += len(ids)
        rows = np.arange(first, first + len(ids), dtype=np.uint64)
        owner = np.repeat(rows, np.diff(borders))
        plus, value = np.zeros(len(tokens)), np.zeros(len(tokens))

        def look(at: np.ndarray, key: np.ndarray) -> None:
            row = index.find(key)
            hit, miss = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
            value[at[hit]] += value_of[row[hit]]
            if key is tokens:  # longer runs have no own logarithm
                plus[at[hit]] = plus_of[row[hit]]
            state.setdefault("asked", []).append((key[miss], owner[at[miss]]))
            state["size"] = state.get("size", 0) + len(miss)

        runs, place = _runs(tokens, borders, depth + 1)
        look(np.arange(len(tokens)), tokens)
        may = contexts.may(tokens)
        for d in range(1, depth + 1):
            at = np.flatnonzero(place >= d)
            key = runs[d][at]
            wanted = may[at - 1] & entries.may(key)
            if d < depth:
                longer = contexts.may(key)
                wanted |= longer
                may = np.zeros(len(tokens), bool)
                may[at] = longer
            look(at[wanted], key[wanted])

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, borders[:-1])  # each text has a token, its end

        has = pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        known = per_text((plus > 0).astype(np.int64))
        state.setdefault("texts", []).append([
            rows, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), has, np.diff(borders), known, per_text(plus), per_text(value)])
        return handed(state) if 2 * state["size"] > _WAITING else None

    return _scan(docs, make, _DEALT, lambda state: handed(state) if state.get("texts") else None)


def score_texts(docs: DataFrame, model: SuffixTables, depth: int = DEPTH, head: int = HEAD,
                tree_head: int = TREE_HEAD, last_use: bool = False) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row of `docs` (id, text); the `last_use` of a model deletes it."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    end = int(END.astype(np.int64))
    bits = Bits(model.contexts), Bits(model.tree.select("key"))
    split = [(rows.select("key", "n", "plus", "value"), (F.col("key") == end) | _often(rows, many))
             for rows, many in ((model.counts, head), (model.tree, tree_head))]
    sent = [fetched(rows.where(often).drop("n")) for rows, often in split]
    key, plus, value = (np.concatenate([x[c].to_numpy() for x in sent]) for c in ("key", "plus", "value"))
    key, of = np.unique(key.view(np.uint64), return_inverse=True)
    shared = spark.sparkContext.broadcast((key, np.bincount(of, plus, len(key)), np.bincount(of, value, len(key)), *bits))
    del sent, key, plus, value, of, bits
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_MODEL_ROWS))
    rest = stage_table(reduce(DataFrame.unionByName, [_model_rows(rows.where(~often), parts) for rows, often in split]), "model-rows")
    small_batches(spark)
    if last_use:
        drop_tables(model.counts, model.tree)
    base = float(np.log10(model.total + model.distinct + 1))
    slice_ = F.pmod(F.xxhash64("id", "text"), F.lit(SLICES))
    made = []
    # A slice of the texts after the other, each stored, so only the shuffle files of one are there at a time.
    for k in range(SLICES):
        asked = _asked(docs.where(slice_ == k), shared, depth, parts)
        sums = asked.unionByName(rest).groupBy("part").applyInArrow(_answered, _SUMS).groupBy("row").agg(
            F.max("id").alias("id"), *(F.sum(c).alias(c) for c in ("n_tokens", "known", "plus", "value")))
        score = F.col("plus") - F.col("n_tokens") * base
        made.append(stage_table(sums.select("id", "n_tokens", F.col("known").alias("n_known"), score.alias("base_score"),
                                            (score + F.col("value")).alias("score")), "scored-texts"))
    drop_tables(rest)
    shared.destroy()
    return reduce(DataFrame.unionByName, made)


def language_model_scores(docs: DataFrame, learn_from: Callable[[str], Column], key: str = "doc_id",
                          text: str = "text") -> DataFrame:
    """Train on the rows for which `learn_from("id")` holds and score all rows."""
    rows = docs.select(column(docs, key).alias("id"), column(docs, text).cast("string").alias("text"))
    model = train_suffix_tables(rows.where(learn_from("id")))
    scored = score_texts(rows.select(F.col("id").cast("long").alias("id"), "text"), model, last_use=True)
    return scored.withColumn("train_tokens", F.lit(model.total).cast("long"))
