"""Benchmark decontamination with one FM-index per training shard.

Phrases are all runs of `width` words of the test items (an item with fewer words, but not none,
is one phrase). A task gathers documents up to a shard of `SHARD_BYTES`, indexes the shard, finds
all phrases in it by backward search through wavelet-matrix ranks, locates every occurrence from
sampled suffix positions, and merges overlapping hits into removal spans. Documents never leave
their task, so nothing is shuffled however hot a source or a passage is.

A word that no phrase has can't be part of an occurrence; it only ends a segment of the indexed
text, and segments shorter than the shortest phrase are left out of the index. That loses no
occurrence.

Phrases are sent to the tasks in blocks of at most about `BLOCK_WORDS` words; more blocks are
further passes in the same stage, each extending the hits of the one before.

Defined cases: null or wordless texts have no words and no hits; null item texts and items
without words have no phrases; null item ids are left out of id lists; repeated items count once;
an empty benchmark hits nothing; repeated documents are handled row by row; columns of the added
names are replaced, others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import ALNUM, lowered, slices, utf8, word_hashes, words
from .common import map_batches
from .fm_index import FMIndex

SHARD_BYTES = 4 << 20
BLOCK_WORDS = 1_000_000
WIDTH = 10

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class Phrases:
    """One block of test phrases: vocabulary, symbol rows and the items of each phrase."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        texts = pa.array([text for _, text in items], pa.string())
        data, offsets = utf8(texts)
        data = lowered(data)
        starts, ends, first = words(data, offsets, ALNUM)
        hashes = word_hashes(data, starts, ends)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        symbols = symbols.astype(np.int64) + 1
        self.sigma = len(self.vocabulary)
        self.item_ids = [item for item, _ in items]
        owners: dict[bytes, set[int]] = {}
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if a < b:
                size = min(width, b - a)
                for at in range(a, b - size + 1):
                    owners.setdefault(symbols[at:at + size].tobytes(), set()).add(k)
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(x) // 8 for x in owners], np.int64)
        self.rows = np.zeros((len(owners), width), np.int64)
        for row, phrase in zip(self.rows, owners, strict=True):
            found = np.frombuffer(phrase, np.int64)
            row[width - len(found):] = found
        self.shortest = int(self.lengths.min()) if len(owners) else 0
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word hash, 0 for words of no phrase."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.near[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), max(self.sigma - 1, 0))
        hit = self.vocabulary[at] == hashes[maybe] if self.sigma else np.zeros(0, bool)
        out[maybe[hit]] = at[hit] + 1
        return out

    def find(self, hashes: np.ndarray, first: np.ndarray):
        """Occurrences in the words of a shard: (first word, words, phrase) arrays."""
        none = (np.empty(0, np.int64),) * 3
        if not self.shortest or not len(hashes):
            return none
        symbols = self.symbols(hashes)
        known = symbols > 0
        edge = np.zeros(len(symbols) + 1, bool)
        edge[first] = True
        opens = known & (edge[:-1] | ~np.concatenate([[False], known[:-1]]))
        closes = known & (edge[1:] | ~np.concatenate([known[1:], [False]]))
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        if not len(begin):
            return none
        sizes = end - begin
        closing = np.cumsum(sizes + 1) - 1
        opening = closing - sizes
        text = np.zeros(int(closing[-1]) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[closing] = False
        source = np.repeat(begin, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text[inside] = symbols[source]
        starts = np.zeros(len(text), bool)
        starts[opening] = True
        index = FMIndex(text, starts, self.sigma)
        low, high = index.search(self.rows, self.lengths)
        count = high - low
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        place = index.locate(rows)
        word = np.full(len(text), -1, np.int64)
        word[inside] = source
        return word[place], self.lengths[phrase], phrase


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", width: int = WIDTH,
           block_words: int = BLOCK_WORDS) -> list[Phrases]:
    """The phrases of a benchmark in blocks of bounded size; the size is measured before any row is fetched."""
    items = benchmark.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    items = items.where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    count = max(1, int(size // block_words) + 1)
    if count == 1:
        return [Phrases([tuple(r) for r in items.collect()], width)]
    found = []
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("key", "text"), F.lit(count)) == k)
        found.append(Phrases([tuple(r) for r in part.collect()], width))
    return found


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH,
                       block_words: int = BLOCK_WORDS, cleaned: str | None = None) -> DataFrame:
    """Adds n_words, n_hit, item_ids (sorted strings) and spans (code points, merged) to each row.

    With `cleaned`, a column of that name holds the text without its spans (a line break stands
    for each); it may be `text` itself.
    """
    phrases = blocks(benchmark, width=width, block_words=block_words)

    def mark(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.string())
        data, offsets = utf8(column)
        counts, hits, items, spans, texts = [], [], [], [], []
        for a, b in slices(offsets, SHARD_BYTES):
            part = offsets[a:b + 1] - offsets[a]
            raw = data[offsets[a]:offsets[b]]
            low = lowered(raw)
            starts, ends, first = words(low, part, ALNUM)
            hashes = word_hashes(low, starts, ends)
            depth = np.zeros(len(starts) + 1, np.int64)
            owned: list[set[str]] = [set() for _ in range(b - a)]
            for block in phrases:
                at, size, phrase = block.find(hashes, first)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + size, -1)
                doc = np.searchsorted(first, at, "right") - 1
                for d, p in np.unique(np.stack([doc, phrase], 1), axis=0).tolist():
                    owned[d].update(block.item_ids[k] for k in block.owners[p] if block.item_ids[k] is not None)
            hit = np.cumsum(depth[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(hit)])[first]
            counts.append(np.diff(first))
            hits.append(np.diff(total))
            items += [sorted(x, key=str.encode) for x in owned]
            for d in range(b - a):
                found = _spans(raw, int(part[d]), hit, starts, ends, int(first[d]), int(first[d + 1])) \
                    if total[d + 1] > total[d] else []
                spans.append([{"start": s, "end": e} for s, e, _, _ in found])
                if cleaned is not None:
                    texts.append(_without(raw[part[d]:part[d + 1]].tobytes(), found, column[a + d].is_valid))
        flat = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (counts, hits)]
        out = [*flat, pa.array(items, pa.list_(pa.string())),
               pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        return [*out, pa.array(texts, pa.string())] if cleaned is not None else out

    added = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("item_ids", T.ArrayType(T.StringType())),
             ("spans", _SPAN)]
    if cleaned is not None:
        added.append((cleaned, T.StringType()))
    return map_batches(docs, mark, added)


def _spans(raw: np.ndarray, base: int, hit: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, b: int):
    """Merged runs of hit words of one document: code-point borders and byte borders."""
    inside = hit[a:b]
    opens = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) + a
    closes = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + a
    out, last, points = [], base, 0
    for s, e in zip(starts[opens].tolist(), ends[closes].tolist(), strict=True):
        points += len(raw[last:s].tobytes().decode("utf-8", "ignore"))
        length = len(raw[s:e].tobytes().decode("utf-8", "ignore"))
        out.append((points, points + length, s - base, e - base))
        points, last = points + length, e
    return out


def _without(text: bytes, found: list, valid: bool) -> str | None:
    if not valid:
        return None
    kept, last = [], 0
    for _, _, s, e in found:
        kept.append(text[last:s])
        last = e
    kept.append(text[last:])
    return b"\n".join(kept).decode()
