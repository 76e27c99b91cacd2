"""Alignment of two tokenizers' ids over the same bytes, with corpus-wide link counts.

Side A encodes a space and the text by byte-level BPE, side B the text by a SentencePiece model that
puts the space itself, so both cut the same bytes. Per document:

1. The cumulative byte ends of each side go into a dictionary from end to token index; the keys both
   have, sorted, are the cuts at which both sides end a token. Long documents go through blocks of
   `BLOCK` tokens, so dictionaries are bounded.
2. Consecutive cuts slice both id lists into groups.
3. Links (A and B tokens whose byte ranges overlap) are expanded per slice: a slice with one token on
   a side links it to all of the other; in a slice with several on both sides every end closes a link.

A document leaves its distinct (A id, B id) pairs with their number of links; their sum over all
documents is one aggregate that combines before the shuffle. To bring the counts back, frequent pairs
(`HEAD_PAIRS` at most, a fixed number) go to every task, all other pairs are looked up by a join.
That is a shortcut for the shuffle alone: every pair gets its exact count either way.

Special tokens' strings inside texts are plain text. Defined cases: null and empty texts, and texts
whose joined token bytes differ from the space and the text on either side (a text with the marker
character U+2581, for one), have no tokens: all numbers are 0 and `groups_sha256` is ''. Repeated
rows count each; an empty table gives an empty result; a column named like a result is replaced.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .bytescan import slices, utf8
from .chunktable import ChunkTable
from .common import column, small_batches
from .piece_ids import MARKER, Chunks
from .pretokens import Pretokens, prepared

#: Tokens of a document in one pair of dictionaries.
BLOCK = 1 << 20
#: Pairs whose counts are sent to all tasks: about 16 MB.
HEAD_PAIRS = 1 << 20
#: Distinct pre-tokens and chunks a worker keeps; beyond, its table starts anew.
KEPT_PRETOKENS, KEPT_CHUNKS = 700_000, 500_000


# --- one document --------------------------------------------------------------------------------

def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the A tokens and of the B tokens that end where the other side ends a token too."""
    found_a, found_b, a, b = [], [], 0, 0
    while a < len(ends_a):
        to_a = min(a + block, len(ends_a))
        to_b = int(np.searchsorted(ends_b, ends_a[to_a - 1], "right"))
        index_a = dict(zip(ends_a[a:to_a].tolist(), range(a, to_a), strict=True))
        index_b = dict(zip(ends_b[b:to_b].tolist(), range(b, to_b), strict=True))
        shared = sorted(index_a.keys() & index_b.keys())
        found_a.append(np.fromiter(map(index_a.__getitem__, shared), np.int64, len(shared)))
        found_b.append(np.fromiter(map(index_b.__getitem__, shared), np.int64, len(shared)))
        a, b = to_a, to_b
    none = [np.empty(0, np.int64)]
    return np.concatenate(found_a or none), np.concatenate(found_b or none)


def links(last_a: np.ndarray, last_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A index, B index) of every link; the slices end at the tokens `last_a` and `last_b`."""
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    of_a, of_b = np.repeat(np.arange(len(last_a)), size_a), np.repeat(np.arange(len(last_b)), size_b)
    one_a = np.flatnonzero(size_a[of_b] == 1)
    one_b = np.flatnonzero((size_b[of_a] == 1) & (size_a[of_a] > 1))
    left, right = [last_a[of_b[one_a]], one_b], [one_a, last_b[of_a[one_b]]]
    # Slices with several tokens on both sides: every end of either side closes one link.
    many_a = np.flatnonzero((size_a[of_a] > 1) & (size_b[of_a] > 1))
    many_b = np.flatnonzero((size_a[of_b] > 1) & (size_b[of_b] > 1))
    closing = np.union1d(ends_a[many_a], ends_b[many_b])
    left.append(many_a[np.searchsorted(ends_a[many_a], closing)])
    right.append(many_b[np.searchsorted(ends_b[many_b], closing)])
    return np.concatenate(left), np.concatenate(right)


def byte_decoder() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for
    themselves, the others are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Aligner:
    """Both tokenizers of a worker, with the bytes of every token."""

    def __init__(self, parts: tuple, model: bytes):
        spec, classes, known = parts
        self.a = Pretokens(spec, classes, known, KEPT_PRETOKENS)
        self.a.tokenizer.encode_special_tokens = True
        self.a.added = []  # their strings are ordinary text here
        self.b = Chunks(model)
        self.b.table = ChunkTable(KEPT_CHUNKS, None, lambda ids: b"")  # ids alone, without their decimals
        decoder = byte_decoder()
        vocab = json.loads(spec)["model"]["vocab"]
        size = max(vocab.values()) + 1
        self.bytes_a = [b""] * size
        for entry, i in vocab.items():
            self.bytes_a[i] = bytes(decoder[c] for c in entry)
        pieces = self.b.model
        self.bytes_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i)
                        else pieces.id_to_piece(i).replace(MARKER, " ").encode() for i in range(pieces.vocab_size())]
        self.length_a = np.fromiter(map(len, self.bytes_a), np.int64)
        self.length_b = np.fromiter(map(len, self.bytes_b), np.int64)

    @staticmethod
    def _words(ids: range, mark: str) -> np.ndarray:
        out = np.empty(len(ids), object)
        out[:] = [f"{i}{mark}" for i in ids]
        return out

    @cached_property
    def decimals(self) -> tuple[np.ndarray, ...]:
        """A ids before a comma and a bar, B ids before a comma and a semicolon."""
        a, b = range(len(self.bytes_a)), range(len(self.bytes_b))
        return self._words(a, ","), self._words(a, "|"), self._words(b, ","), self._words(b, ";")

    def groups_digest(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """sha256 of `a1,a2|b1;a3|b2,b3`, made in blocks of slices."""
        inner_a, end_a, inner_b, end_b = self.decimals
        sha, done_a, done_b = hashlib.sha256(), 0, 0
        cuts = np.unique(np.searchsorted(last_a, np.arange(BLOCK, len(a) + BLOCK, BLOCK)).clip(max=len(last_a) - 1))
        for first, cut in zip(np.append(-1, cuts[:-1]).tolist(), cuts.tolist(), strict=True):
            to_a, to_b = int(last_a[cut]) + 1, int(last_b[cut]) + 1
            part_a, part_b = last_a[first + 1:cut + 1] - done_a, last_b[first + 1:cut + 1] - done_b
            size_a, size_b = np.diff(part_a, prepend=-1), np.diff(part_b, prepend=-1)
            word_a, word_b = inner_a[a[done_a:to_a]], inner_b[b[done_b:to_b]]
            word_a[part_a], word_b[part_b] = end_a[a[done_a:to_a][part_a]], end_b[b[done_b:to_b][part_b]]
            out = np.empty(len(word_a) + len(word_b), object)
            out[np.arange(len(word_a)) + np.repeat(part_b - size_b + 1, size_a)] = word_a
            out[np.arange(len(word_b)) + np.repeat(part_a + 1, size_b)] = word_b
            text = "".join(out.tolist())
            sha.update((text if to_a < len(a) else text[:-1]).encode())
            done_a, done_b = to_a, to_b
        return sha.hexdigest()

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple | None]:
        """(A ids, B ids, last_a, last_b, ends_a, ends_b) of each text of the buffer, None without tokens."""
        raw = [data[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        ids_a = self.a.ids([" " + t.decode() if t else "" for t in raw])
        for text, a, (b, _) in zip(raw, ids_a, self.b.ids(data, offsets), strict=True):
            whole = b" " + text
            if not text or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole \
                    or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
                yield None
                continue
            b = np.array(b, np.int64)
            a = a.astype(np.int64)
            ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
            yield (a, b, *shared_ends(ends_a, ends_b), ends_a, ends_b)


_workers: dict = {}


def _aligner(parts: tuple, model: bytes) -> Aligner:
    key = (zlib.crc32(parts[0]), zlib.crc32(model))
    if key not in _workers:
        _workers[key] = Aligner(parts, model)
    return _workers[key]


# --- tables --------------------------------------------------------------------------------------

def _loaded(a_path: str, b_path: str) -> tuple[tuple, bytes, int, int]:
    parts = prepared(a_path)
    with open(b_path, "rb") as file:
        model = file.read()
    size_a = max(json.loads(parts[0])["model"]["vocab"].values()) + 1
    return parts, model, size_a, sentencepiece.SentencePieceProcessor(model_proto=model).vocab_size()


def token_groups(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The groups themselves: key, a_ids, b_ids, and how many of each the consecutive groups hold."""
    parts, model, _, _ = _loaded(a_path, b_path)
    none = np.empty(0, np.int64)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            aligner, lists = _aligner(parts, model), [[], [], [], []]
            data, offsets = utf8(batch.column(1))
            for s, e in slices(offsets):
                for found in aligner.documents(data[offsets[s]:offsets[e]], offsets[s:e + 1] - offsets[s]):
                    a, b, last_a, last_b = found[:4] if found else (none,) * 4
                    for out, x in zip(lists, (a, b, np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)), strict=True):
                        out.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], names=names)

    names = ["key", "a_ids", "b_ids", "a_sizes", "b_sizes"]
    small_batches(docs.sparkSession)
    rows = docs.select(column(docs, key).cast("long").alias("key"), column(docs, text).cast("string").alias("text"))
    found = rows.mapInArrow(align, "key long, " + ", ".join(f"{n} array<long>" for n in names[1:]))
    return found.withColumnRenamed("key", key)


def align_documents(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its numbers, groups_sha256, and its distinct pairs with their numbers of links, staged.

    A pair is one number: the A id times B's vocabulary size plus the B id.
    """
    parts, model, size_a, size_b = _loaded(a_path, b_path)
    kind, dtype = ("int", np.int32) if size_a * size_b < 1 << 31 else ("long", np.int64)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            aligner, numbers, shas, pairs, counts = _aligner(parts, model), [], [], [], []
            data, offsets = utf8(batch.column(1))
            for s, e in slices(offsets):
                for found in aligner.documents(data[offsets[s]:offsets[e]], offsets[s:e + 1] - offsets[s]):
                    if found is None:
                        numbers.append((0, 0, 0, 0))
                        shas.append("")
                        pairs.append(np.empty(0, dtype))
                        counts.append(np.empty(0, np.int32))
                        continue
                    a, b, last_a, last_b, ends_a, ends_b = found
                    left, right = links(last_a, last_b, ends_a, ends_b)
                    distinct, times = np.unique((a[left] * size_b + b[right]).astype(dtype), return_counts=True)
                    numbers.append((len(a), len(b), len(last_a), len(left)))
                    shas.append(aligner.groups_digest(a, b, last_a, last_b))
                    pairs.append(distinct)
                    counts.append(times.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[k] for x in numbers], pa.int64()) for k in range(4)),
                 pa.array(shas, pa.string()), _lists(pairs, dtype), _lists(counts, np.int32)], names=names)

    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    schema = f"key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, times array<int>"
    small_batches(docs.sparkSession)
    rows = docs.select(column(docs, key).cast("long").alias("key"), column(docs, text).cast("string").alias("text"))
    return stage_table(rows.mapInArrow(align, schema).withColumn("row", F.monotonically_increasing_id()), "aligned")


def _lists(arrays: list[np.ndarray], dtype) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, dtype)))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """Corpus-wide number of links of every pair, and whether it is the highest of its B id, staged."""
    each = aligned.select(F.inline(F.arrays_zip("pairs", "times")))
    counts = each.groupBy(F.col("pairs").cast("long").alias("pair")).agg(F.sum("times").alias("count"))
    counts = stage_table(counts.withColumn("b", F.col("pair") % size_b), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _head(counts: DataFrame, limit: int) -> tuple[tuple[np.ndarray, ...], bool]:
    """Pairs, counts and best marks of the most frequent pairs, sorted by pair, and whether that is all.

    The least count is chosen from a histogram on a logarithmic scale, so `limit` is never passed.
    """
    level = F.floor(F.log2("count") * 8)
    histogram = sorted((tuple(r) for r in counts.groupBy(level).count().collect()), reverse=True)
    sizes = np.cumsum([n for _, n in histogram])
    levels = int(np.searchsorted(sizes, limit, "right"))
    whole = levels == len(histogram)
    rows = counts.where(level >= histogram[levels - 1][0]) if levels else counts.where("false")
    found = rows.orderBy("pair").toArrow()
    return tuple(found.column(c).to_numpy() for c in ("pair", "count", "best")), whole


def aligned_counts(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text",
                   head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    size_b = _loaded(a_path, b_path)[3]
    aligned = align_documents(docs, a_path, b_path, key, text)
    counts = stage_table(pair_counts(aligned, size_b), "pair-counts")
    head, whole = _head(counts, head_pairs)
    sent = aligned.sparkSession.sparkContext.broadcast(head)
    kept = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = sent.value
        for batch in batches:
            index = batch.schema.get_field_index
            column_ = batch.column(index("pairs"))
            pairs, times = column_.flatten().to_numpy(), batch.column(index("times")).flatten().to_numpy().astype(np.int64)
            bounds = column_.offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            at = np.searchsorted(known, pairs)
            at[at == len(known)] = 0
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums, bests = np.zeros(len(pairs) + 1, np.int64), np.zeros(len(pairs) + 1, np.int64)
            if len(known):
                np.cumsum(np.where(hit, times * count[at], 0), out=sums[1:])
                np.cumsum(np.where(hit & best[at], times, 0), out=bests[1:])
            rest = np.concatenate([[0], np.cumsum(~hit)])[bounds].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(index("key")), *(batch.column(index(n)) for n in kept),
                 pa.array(np.diff(bests[bounds])), pa.array(np.diff(sums[bounds])),
                 pa.ListArray.from_arrays(pa.array(rest), pa.array(pairs[~hit].astype(np.int64))),
                 pa.ListArray.from_arrays(pa.array(rest), pa.array(times[~hit]))],
                names=["key", *kept, "n_best", "count_sum", "pairs", "times"])

    small_batches(aligned.sparkSession)
    schema = ("key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, "
              "n_best long, count_sum long, pairs array<long>, times array<long>")
    found = aligned.mapInArrow(look_up, schema)
    if not whole:
        found = stage_table(found, "aligned-head")
        each = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
        rare = each.join(counts, "pair").groupBy("row").agg(
            F.sum(F.col("times") * F.col("count")).alias("more_sum"),
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        found = found.join(rare, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return found.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
