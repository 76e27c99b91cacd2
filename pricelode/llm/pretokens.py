"""Byte-level BPE by distinct pre-tokens.

A byte-level BPE tokenizer cuts a text into pre-tokens and merges inside each of them alone, so
the ids of a text are the ids of its pre-tokens in order. `Pretokens` finds the pre-token borders
of many texts at once (numpy, from character classes that are learned by probing the tokenizer
itself) and has the tokenizers library encode every *distinct* pre-token once.

Texts that hold one of the tokenizer's added strings, or characters outside the probed planes,
are encoded whole by the library, so every text gets exactly the library's ids.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np

from .bytescan import mixed, run_hashes
from .chunktable import ChunkTable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

PROBED = 0x20000
SPACE, LETTER, NUMBER, OTHER, EDGE = 0, 1, 2, 3, 255


def load_spec(path: str) -> bytes:
    """The tokenizer file, read on the driver and sent to the tasks (a few megabytes)."""
    with open(path, "rb") as file:
        return file.read()


def character_classes(tokenizer: Tokenizer) -> np.ndarray:
    """The pattern class of every code point below `PROBED`, as the library has it."""
    points = [c for c in range(PROBED) if not 0xD800 <= c < 0xE000]
    table = np.full(PROBED, SPACE, np.uint8)
    for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
        joined = "".join(f"{probe}{chr(c)}\n" for c in points)
        starts = {start for _, (start, _) in tokenizer.pre_tokenizer.pre_tokenize_str(joined)}
        table[[c for k, c in enumerate(points) if 3 * k + 1 not in starts]] = kind
    return table


def whole_tokens(spec: bytes) -> dict[str, int]:
    """Proof step: the vocabulary strings that, encoded alone, give exactly their own id.

    Strings that aren't valid text, that the pattern would cut, or that merge to something else
    are left out; bounded by the vocabulary.
    """
    tokenizer = Tokenizer.from_str(spec.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    added = {x["id"] for x in json.loads(spec).get("added_tokens", [])}
    strings = [(tokenizer.decode([i], skip_special_tokens=False), i)
               for i in tokenizer.get_vocab(with_added_tokens=False).values() if i not in added]
    strings = [(s, i) for s, i in strings if s and "�" not in s
               and len(tokenizer.pre_tokenizer.pre_tokenize_str(s)) == 1]
    found = tokenizer.encode_batch_fast([s for s, _ in strings], add_special_tokens=False)
    return {s: i for (s, i), e in zip(strings, found, strict=True) if e.ids == [i]}


class Pretokens:
    """Ids of texts, put together from the ids of their distinct pre-tokens.

    `classes` is the table of `character_classes` and `known` that of `whole_tokens`, both made
    once on the driver. The chunk table has a fixed limit and starts anew beyond it; that bounds
    memory and never changes a result.
    """

    def __init__(self, spec: bytes, classes: np.ndarray, known: dict[str, int], limit: int = 1_000_000):
        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [x["content"] for x in json.loads(spec).get("added_tokens", [])]
        self.classes = classes
        self.units = mixed(np.arange(1, len(classes) + 1, dtype=np.uint64))
        self.known = known
        self.table = ChunkTable(limit, self._known_rows)

    def _known_rows(self):
        strings = list(self.known)
        joined = "".join(strings)
        ends = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return self._hashes(self._codes(joined), starts, ends), [[i] for i in self.known.values()]

    def _codes(self, joined: str) -> np.ndarray:
        return np.frombuffer(joined.encode("utf-32-le"), "<u4")

    def _hashes(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return run_hashes(self.units[np.minimum(code, PROBED - 1)], starts, ends)

    def starts(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of joined texts start; `first` holds the texts' own starts."""
        if not len(code):
            return np.empty(0, np.int64)
        kind = self.classes[np.minimum(code, PROBED - 1)]
        opening = first[first < len(code)]
        before, after = np.empty_like(kind), np.empty_like(kind)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        before[opening] = EDGE
        after[-1] = EDGE
        after[opening[opening > 0] - 1] = EDGE
        blank = kind == SPACE
        joins = np.zeros(len(code), bool)  # the one space that the next word takes with it
        joins[1:] = code[:-1] == 32
        start = kind != before
        start &= ~(~blank & (before == SPACE) & joins)
        start |= blank & (before == SPACE) & (after != SPACE) & (after != EDGE)
        marks = np.flatnonzero((code == 39) & start & (after == LETTER))
        if len(marks):
            padded = np.concatenate([code, np.zeros(2, code.dtype)])
            one, two = padded[marks + 1], padded[marks + 2]
            inside = np.append(after, EDGE)[marks + 1] == LETTER
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = inside & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
                             | ((one == ord("l")) & (two == ord("l"))))
            kept = short | long
            marks, ends = marks[kept], marks[kept] + np.where(short[kept], 2, 3)
            start[marks + 1] = False
            ends = ends[ends < len(code)]
            start[ends[before[ends] == LETTER]] = True
        return np.flatnonzero(start)

    def _merged(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for k in range(0, len(pieces), 5_000)
                for e in self.tokenizer.encode_batch_fast(pieces[k:k + 5_000], add_special_tokens=False)]

    def lookup(self, texts: list[str]):
        """(table row of each pre-token, first pre-token of each text and the total, whole ids of odd texts)."""
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        joined = "".join(texts)
        code = self._codes(joined)
        odd = set((np.searchsorted(bounds, np.flatnonzero(code >= PROBED), "right") - 1).tolist())
        for added in self.added:
            if added in joined:
                odd.update(k for k, text in enumerate(texts) if added in text)
        starts = self.starts(code, bounds[:-1])
        ends = np.append(starts[1:], len(code)) if len(starts) else starts
        rows = self.table.rows(
            self._hashes(code, starts, ends),
            lambda at: self._merged([joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
        whole = {k: self.tokenizer.encode(texts[k], add_special_tokens=False).ids for k in odd}
        return rows, np.searchsorted(starts, bounds), whole

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        rows, first, whole = self.lookup(texts)
        flat, ends = self.table.values(rows)
        cuts = np.concatenate([[0], ends])[first].tolist()
        return [np.array(whole[k], np.int32) if k in whole else flat[a:b]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        rows, first, whole = self.lookup(texts)
        total = np.concatenate([[0], np.cumsum(self.table.lengths[rows])])[first]
        return [len(whole[k]) if k in whole else n for k, n in enumerate(np.diff(total).tolist())]


_loaded: dict = {}


def prepared(path: str) -> tuple[bytes, np.ndarray, dict[str, int]]:
    """What the tasks need of a tokenizer file: its text, character classes and proved whole tokens."""
    spec = load_spec(path)
    key = zlib.crc32(spec)
    if key not in _loaded:
        _loaded[key] = (spec, character_classes(Tokenizer.from_str(spec.decode())), whole_tokens(spec))
    return _loaded[key]


_workers: dict = {}


def pretokens(parts: tuple[bytes, np.ndarray, dict[str, int]]) -> Pretokens:
    """The tokenizer of this worker process, kept from task to task."""
    key = zlib.crc32(parts[0])
    if key not in _workers:
        _workers[key] = Pretokens(*parts)
    return _workers[key]
