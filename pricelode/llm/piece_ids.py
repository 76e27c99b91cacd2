"""SentencePiece ids by a table of distinct chunks.

When no piece of the model has a whitespace marker after another character, and no piece of two
or more characters holds a line break, the model's merges never cross the place before a run of
markers or around a line break. A normalised text then falls into chunks (a run of markers and
the word behind it, or one line break) that are segmented alone: each distinct chunk once per
worker, by the sentencepiece library, and the ids are joined back by position.

`prove` checks these facts on the model file, and that its normaliser changes nothing but spaces;
a model that fails the proof is encoded text by text instead. Texts with a marker character of
their own, or a NUL, are always encoded whole.

Defined cases: a null text is empty (only the end id); repeated rows keep their place; an empty
table stays empty; columns of the added names are replaced, all others pass through.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from .bytescan import SLICE_BYTES, slices, utf8, word_hashes
from .chunktable import ChunkTable
from .common import map_batches

MARKER = "▁"


def prove(model: bytes) -> bool:
    """Whether chunks of this model can be segmented alone."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    rule, trainer = proto.normalizer_spec, proto.trainer_spec
    plain = (not rule.precompiled_charsmap and rule.add_dummy_prefix and rule.escape_whitespaces
             and not rule.remove_extra_whitespaces and not trainer.treat_whitespace_as_suffix
             and trainer.model_type == trainer.BPE)
    pieces = [(p.piece, p.type) for p in proto.pieces]
    own = {p for p, kind in pieces if kind == proto.SentencePiece.USER_DEFINED}
    inner = any(MARKER in p.lstrip(MARKER) for p, _ in pieces)
    breaks = any("\n" in p and len(p) > 1 for p, _ in pieces)
    return plain and not own and not inner and not breaks


class Chunks:
    """Encodes and decodes with one model; the chunk table has a fixed limit."""

    def __init__(self, model: bytes, limit: int = 500_000):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.proved = prove(model)
        self.table = ChunkTable(limit, None, lambda ids: b"".join(b"%d " % i for i in ids))

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks: the model itself puts the first marker; a chunk that is nothing else, or has
        none, is put behind a line break, whose ids are cut off."""
        marked = [len(c) > 1 and c[0] == " " for c in chunks]
        found = self.model.encode([c[1:] if m else "\n" + c for c, m in zip(chunks, marked, strict=True)], num_threads=1)
        return [ids if m else ids[len(self.lead):] for ids, m in zip(found, marked, strict=True)]

    def ids(self, data: np.ndarray, offsets: np.ndarray):
        """Per text of the buffer: (ids, decimal ids joined by one space), both without an end id."""
        texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        if self.proved and not hasattr(self, "lead"):
            self.lead = self.model.encode("\n")
        odd = [k for k, t in enumerate(texts) if not self.proved or b"\xe2\x96\x81" in t or b"\0" in t]
        # Each text gets the marker that the model puts before it, as a space.
        full = b"".join(b" " + t if t else b"" for t in texts)
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in texts])])
        code = np.frombuffer(full, np.uint8)
        if len(code):
            space, line = code == 32, code == 10
            start = line.copy()
            start[1:] |= line[:-1]
            start[1:] |= space[1:] & ~space[:-1]
            opening = bounds[:-1]
            start[opening[opening < len(code)]] = True
            starts = np.flatnonzero(start)
        else:
            starts = np.empty(0, np.int64)
        ends = np.append(starts[1:], len(code)) if len(starts) else starts
        rows = self.table.rows(word_hashes(code, starts, ends), lambda at: self._segment(
            [full[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
        flat, last = self.table.values(rows)
        cuts = np.searchsorted(starts, bounds)
        id_cuts = np.concatenate([[0], last])[cuts].tolist()
        decimal, row_list, cuts = self.table.extras, rows.tolist(), cuts.tolist()
        whole = {k: self.model.encode(texts[k].decode()) for k in odd}
        for k in range(len(texts)):
            if k in whole:
                yield whole[k], b"".join(b"%d " % i for i in whole[k])
            else:
                yield (flat[id_cuts[k]:id_cuts[k + 1]].tolist(),
                       b"".join([decimal[r] for r in row_list[cuts[k]:cuts[k + 1]]]))


_workers: dict = {}


def _chunks(model: bytes) -> Chunks:
    key = zlib.crc32(model)
    if key not in _workers:
        _workers[key] = Chunks(model)
    return _workers[key]


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", digests: bool = False) -> DataFrame:
    """Adds n_tokens and ids (with the end id) and the decoded text to every row; no shuffle.

    With `digests`, ids and decoded text are replaced by their sha256 (ids as decimals joined by
    one space), which is much smaller.
    """
    with open(model_path, "rb") as file:
        model = file.read()

    def encode(batch: pa.RecordBatch) -> list[pa.Array]:
        encoder = _chunks(model)
        end = encoder.model.eos_id()
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)).cast(pa.string()))
        counts, first, second = [], [], []
        for a, b in slices(offsets, SLICE_BYTES):
            part = offsets[a:b + 1]
            for ids, decimals in encoder.ids(data[part[0]:part[-1]], part - part[0]):
                ids.append(end)
                decoded = encoder.model.decode(ids)
                counts.append(len(ids))
                if digests:
                    first.append(hashlib.sha256(decimals + b"%d" % end).hexdigest())
                    second.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    first.append(ids)
                    second.append(decoded)
        kind = pa.string() if digests else pa.list_(pa.int32())
        return [pa.array(counts, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())]

    if digests:
        added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    else:
        added = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    return map_batches(docs, encode, added)
