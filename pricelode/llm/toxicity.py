"""Toxicity by compression distance between two trained zstandard dictionaries.

Training (driver, on a bounded labelled sample):

1. words that stand in many *different* contexts of toxic texts and hardly in ordinary ones are
   found by a likelihood-ratio test; counting contexts, not occurrences, keeps copied passages
   from looking typical of either class;
2. one dictionary is trained on windows of ordinary texts, another on the toxic samples; the toxic
   side compresses with both contents, so windows without toxic matches cost the same on both
   sides and the difference of the two lengths is the toxic part alone;
3. ordinary training windows that the toxic side still compresses better join the ordinary
   dictionary (hard negatives);
4. on sample texts that took no part in 1 to 3, a window threshold is set from the ordinary
   windows, and a logistic curve from text features (largest gap, mean of the three largest, share
   and number of windows over the threshold, mean gap) to the probability of the label.

Scoring compresses every window of every whole text twice, inside the task that reads it.

Defined cases: a null or wordless text has no windows and gets the score of all-zero features;
null labels and null ids are not learned from; an id labelled twice counts as toxic if any label
says so; without both classes in the sample every text gets the smoothed share of toxic labels;
repeated rows score alike; an empty table stays empty.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import ALNUM, lowered, slices, utf8, word_hashes, words
from .common import column, map_batches

#: Bounds of the training sample: texts of each class and bytes of a text.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 3000, 6000, 16_384

WINDOW, STEP = 8, 7
LEVEL = 3
ORDINARY_BYTES, TOXIC_BYTES, HARD_BYTES = 24_576, 4_096, 32_768
FEATURES = 5
MIN_CONTEXTS, MIN_RATIO, MIN_LIFT = 3, 20.0, 8.0


def _normal(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer of lower-case words, one space before and behind each word."""
    sizes = np.cumsum([0] + [len(t) + 1 for t in texts])
    data = lowered(np.frombuffer(b" ".join(texts) + b" ", np.uint8)) if texts else np.empty(0, np.uint8)
    inside = ALNUM[data]
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    place = np.concatenate([[0], np.cumsum(kept)])
    clean = np.where(inside, data, np.uint8(32))[kept]
    clean = np.concatenate([np.array([32], np.uint8), clean])
    starts, ends, first = words(clean, place[sizes] + 1, ALNUM)
    return clean.tobytes(), starts, ends, first


def windows(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The windows of all texts in order, and the first window of each text and the total."""
    pieces: list[bytes] = []
    counted = [np.zeros(1, np.int64)]
    for part in _parts(texts):
        clean, starts, ends, first = _normal(part)
        counts = np.diff(first)
        many = np.where(counts > 0, (np.maximum(counts - WINDOW, 0) + STEP - 1) // STEP + 1, 0)
        total = np.cumsum(many)
        begin = np.repeat(first[:-1], many) + STEP * (np.arange(int(many.sum())) - np.repeat(total - many, many))
        last = np.minimum(begin + WINDOW, np.repeat(first[1:], many)) - 1
        cuts = zip((starts[begin] - 1).tolist(), (ends[last] + 1).tolist(), strict=True)
        pieces += [clean[a:b] for a, b in cuts]
        counted.append(many)
    return pieces, np.cumsum(np.concatenate(counted))


@dataclass
class ToxicityModel:
    """Two dictionary contents and the calibration; a few dozen kilobytes."""

    ordinary: bytes
    toxic: bytes
    threshold: int
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def gaps(self, pieces: list[bytes]) -> np.ndarray:
        """How many bytes fewer each window takes with the toxic side."""
        one, two = _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)
        return np.fromiter((len(one(w)) - len(two(w)) for w in pieces), np.int64, len(pieces))

    def features(self, texts: list[bytes]) -> np.ndarray:
        pieces, first = windows(texts)
        gaps = self.gaps(pieces)
        out = np.zeros((len(texts), FEATURES))
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if a < b:
                top = np.sort(gaps[a:b])[::-1]
                over = int((top >= self.threshold).sum())
                out[k] = top[0], top[:3].mean(), over / len(top), np.log1p(over), top.mean()
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = (self.features(texts) - self.center) / self.scale
        z = x @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_compressors: dict = {}


def _compressor(content: bytes):
    key = (len(content), zlib.crc32(content))
    if key not in _compressors:
        if len(_compressors) >= 8:
            _compressors.clear()
        made = zstandard.ZstdCompressionDict(content or b"        ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=LEVEL)
        _compressors[key] = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return _compressors[key]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A zstandard dictionary trained on samples; their own text where they are too few to train on."""
    if sum(map(len, samples)) < 20 * size and len(set(samples)) < 2000:
        plain = list(dict.fromkeys(samples))
        return b"".join(reversed(plain))[-size:]
    mixed_up = list(samples)
    random.Random(1).shuffle(mixed_up)
    try:
        found = zstandard.train_dictionary(size, mixed_up, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        found = b""
    return found if 2 * len(found) >= size else b"".join(reversed(list(dict.fromkeys(samples))))[-size:]


def _contexts(texts: list[bytes]) -> tuple[dict[int, int], dict[int, bytes], int]:
    """In how many different contexts each word stands; the strings of the frequent ones; the sum.

    Texts are read in slices, so the driver holds the hashes of the sample but no tables as long
    as its text.
    """
    keys, units = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for part in _parts(texts):
        clean, starts, ends, first = _normal(part)
        whole = word_hashes(np.frombuffer(clean, np.uint8), starts, ends)
        edge = np.zeros(len(starts) + 1, bool)
        edge[first] = True
        before = np.where(edge[:-1], np.uint64(1), np.roll(whole, 1))
        after = np.where(edge[1:], np.uint64(2), np.roll(whole, -1))
        keys.append(whole * np.uint64(7) + before * np.uint64(3) + after * np.uint64(5))
        units.append(whole)
    distinct = np.unique(np.concatenate(keys), return_index=True)[1]
    found, number = np.unique(np.concatenate(units)[distinct], return_counts=True)
    often = number >= MIN_CONTEXTS
    counts = dict(zip(found[often].tolist(), number[often].tolist(), strict=True))
    strings: dict[int, bytes] = {}
    for part in _parts(texts):
        clean, starts, ends, _ = _normal(part)
        whole = word_hashes(np.frombuffer(clean, np.uint8), starts, ends)
        at = np.unique(whole, return_index=True)[1]
        for unit, k in zip(whole[at].tolist(), at.tolist(), strict=True):
            if unit in counts and unit not in strings:
                strings[unit] = b" " + clean[starts[k]:ends[k]] + b" "
    return counts, strings, int(number.sum())


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of about `SLICE_BYTES`."""
    sizes = np.cumsum([0] + [len(t) for t in texts])
    for a, b in slices(sizes):
        yield texts[a:b]


def _typical(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Samples for the toxic dictionary, most typical first, each as often as it has contexts."""
    one, strings, a = _contexts(toxic)
    zero, _, b = _contexts(ordinary)
    ranked = []
    for unit, c in one.items():
        z = zero.get(unit, 0)
        expected, other = (c + z) * a / (a + b), (c + z) * b / (a + b)
        if c <= expected or c / a <= MIN_LIFT * z / b:
            continue
        ratio = 2 * (c * np.log(c / expected) + (z * np.log(z / other) if z else 0.0))
        if ratio >= MIN_RATIO:
            ranked.append((ratio, strings[unit], c))
    ranked.sort(key=lambda x: (-x[0], x[1]))
    return [s for _, s, c in ranked for _ in range(c)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the first is the constant."""
    full = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    w = np.zeros(full.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        gradient = full.T @ (p - y) + penalty @ w
        step = np.linalg.solve((full * (p * (1 - p) + 1e-9)[:, None]).T @ full + penalty, gradient)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(toxic: list[bytes], ordinary: list[bytes]) -> ToxicityModel:
    """Fit on texts of both classes; the order of the lists decides who calibrates."""
    size = FEATURES
    flat = np.zeros(size), np.ones(size)
    prior = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1)
    constant = np.array([np.log(prior / (1 - prior))] + [0.0] * size)
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", 1, *flat, constant)
    few = min(len(toxic), len(ordinary)) < 30
    learn = [x if few else [t for k, t in enumerate(x) if k % 3] for x in (toxic, ordinary)]
    check = [x if few else x[::3] for x in (toxic, ordinary)]
    pieces, first = windows(learn[1])
    spread = [pieces[k] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
              for k in np.unique(np.linspace(a, b - 1, min(b - a, 6)).astype(int)).tolist() if a < b]
    base = _trained(spread[:50_000], ORDINARY_BYTES, 50)
    samples = _typical(*learn)
    wanted = min(TOXIC_BYTES, max(256, sum(map(len, set(samples)))))
    model = ToxicityModel(base, _trained(samples, wanted, 16) if samples else b"", 1, *flat, constant)
    hard = pieces[::max(1, len(pieces) // 60_000)]
    gaps = model.gaps(hard)
    order = np.argsort(gaps, kind="stable")
    model.ordinary = b"".join(hard[k] for k in order.tolist() if gaps[k] >= 2)[-HARD_BYTES:] + base
    seen = model.gaps(windows(check[1])[0])
    model.threshold = max(2, int(np.quantile(seen, 0.999)) + 1) if len(seen) else 2
    x = np.concatenate([model.features(t) for t in check])
    y = np.concatenate([np.ones(len(check[0])), np.zeros(len(check[1]))])
    model.center, model.scale = x.mean(0), x.std(0) + 1e-6
    model.weights = _logistic((x - model.center) / model.scale, y)
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, learn_from, key: str = "doc_id", text: str = "text",
                   label: str = "toxic", toxic_rows: int = SAMPLE_TOXIC, ordinary_rows: int = SAMPLE_ORDINARY,
                   text_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Fit on a bounded sample: the first ids by hash of each class for which `learn_from` holds.

    `learn_from(column name)` makes a condition on the id column of `labels`. At most `toxic_rows`
    and `ordinary_rows` texts of at most `text_bytes` bytes each come to the driver.
    """
    known = labels.select(column(labels, key).alias("key"), column(labels, label).alias("label"))
    known = known.where(F.col("key").isNotNull() & F.col("label").isNotNull())
    known = known.where(learn_from("key")).groupBy("key").agg(F.max(F.col("label").cast("int")).alias("label"))
    order = [F.xxhash64("key"), F.col("key")]
    some = known.where("label = 1").orderBy(*order).limit(toxic_rows).unionByName(
        known.where("label = 0").orderBy(*order).limit(ordinary_rows))
    # The build side has at most toxic_rows + ordinary_rows rows of two numbers.
    texts = docs.select(column(docs, key).alias("key"), column(docs, text).cast("string").alias("text"))
    texts = texts.where(F.octet_length("text") <= text_bytes).join(F.broadcast(some), "key")
    rows = sorted({(r.text, r.label) for r in texts.select("text", "label").collect()},
                  key=lambda r: (zlib.crc32(r[0].encode()), r))
    return fit_toxicity([t.encode() for t, k in rows if k == 1], [t.encode() for t, k in rows if k == 0])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """Adds the probability that each whole text is toxic; no shuffle."""
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)).cast(pa.string()))
        found = [model.scores([data[offsets[k]:offsets[k + 1]].tobytes() for k in range(a, b)])
                 for a, b in slices(offsets)]
        return [pa.array(np.concatenate(found) if found else np.empty(0), pa.float64())]

    return map_batches(docs, run, [(score, T.DoubleType())])
