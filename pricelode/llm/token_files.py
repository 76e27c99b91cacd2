"""Token ids in seekable files: independent zstandard frames, a seek table, per-frame checksums.

File layout, in order:

* data frames: ids of consecutive documents as little-endian unsigned 32-bit integers, each frame
  an independent zstandard frame with its own content checksum;
* a skippable frame (magic 0x184D2A50) with the compressed document directory: for each document
  its id, whether the id is null, and its number of ids;
* a skippable frame (magic 0x184D2A5E) with the seek table of the public seekable format:
  compressed size, decompressed size and checksum (low half of xxhash64) of every data frame,
  then frame count, descriptor and the closing magic 0x8F92EAB1.

A reader fetches the file's tail, the directory, and then only the frames of the documents it is
asked for. Files are written by Spark tasks, one per range of document ids, under names that no
other attempt uses; the manifest is a table that Spark commits, so a lost or repeated task leaves
no half file behind that a reader would see.

Defined cases: a null text is empty (only the end id), a null document id sorts first and stays
null, repeated ids keep all their rows (ties by text), an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path
from .bytescan import slices
from .common import small_batches
from .pretokens import prepared, pretokens

FRAME_IDS = 64 * 1024
LEVEL = 3

_SKIP_DIRECTORY, _SKIP_SEEK, _SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_MANIFEST = ("shard int, path string, documents long, ids long, bytes long, first_id long, last_id long")
_ROWS = "doc_id long, position long, n_tokens long, ids_crc32 long"


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes documents of ids in the order given; holds one frame of ids and the directory."""

    def __init__(self, path: str, frame_ids: int = FRAME_IDS):
        fs, name = _open(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(name, compression=None)
        self.frame_ids = frame_ids
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frame: list[np.ndarray] = []
        self.waiting = 0
        self.seek: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.frame.append(ids.astype("<u4"))
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.waiting += len(ids)
        if self.waiting >= self.frame_ids:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _flush(self) -> None:
        if not self.waiting:
            return
        raw = np.concatenate(self.frame).tobytes()
        packed = self.compressor.compress(raw)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._write(packed)
        self.frame, self.waiting = [], 0

    def close(self) -> None:
        self._flush()
        nulls = np.array([i is None for i in self.doc_ids], np.uint8)
        ids = np.array([i or 0 for i in self.doc_ids], "<i8")
        packed = self.compressor.compress(ids.tobytes() + nulls.tobytes() + np.array(self.counts, "<u4").tobytes())
        self._write(struct.pack("<II", _SKIP_DIRECTORY, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *entry) for entry in self.seek)
        table += struct.pack("<IBI", len(self.seek), 0x80, _SEEK_END)
        self._write(struct.pack("<II", _SKIP_SEEK, len(table)) + table)
        self.out.close()


class ShardReader:
    """Reads documents of one file; only frames that hold a requested document are decompressed."""

    def __init__(self, path: str):
        fs, name = _open(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        frames, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEK_END or descriptor != 0x80:
            raise ValueError(f"no seek table at the end of {path}")
        seek_at = size - 9 - 12 * frames - 8
        table = np.frombuffer(self.file.read_at(12 * frames, seek_at + 8), "<u4").reshape(frames, 3).astype(np.int64)
        self.packed, self.raw, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.at = np.cumsum(self.packed) - self.packed
        self.decompressor = zstandard.ZstdDecompressor()
        directory_at = int(self.packed.sum())
        magic, length = struct.unpack("<II", self.file.read_at(8, directory_at))
        if magic != _SKIP_DIRECTORY or directory_at + 8 + length != seek_at:
            raise ValueError(f"no document directory in {path}")
        data = self.decompressor.decompress(self.file.read_at(length, directory_at + 8))
        rows = len(data) // 13
        self.doc_ids = np.frombuffer(data, "<i8", rows)
        self.nulls = np.frombuffer(data, np.uint8, rows, 8 * rows).astype(bool)
        self.counts = np.frombuffer(data, "<u4", rows, 9 * rows).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.frame_ends = np.cumsum(self.raw) // 4

    def frame(self, k: int) -> np.ndarray:
        packed = self.file.read_at(int(self.packed[k]), int(self.at[k]))
        raw = self.decompressor.decompress(packed, max_output_size=int(self.raw[k]))
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(raw, "<u4")

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(row in the directory, ids) of the wanted rows, or of all, in file order."""
        rows = np.arange(len(self.counts)) if wanted is None else np.unique(wanted)
        held, ids, base = -1, None, 0
        for row in rows.tolist():
            count = int(self.counts[row])
            if not count:
                yield row, np.empty(0, "<u4")
                continue
            k = int(np.searchsorted(self.frame_ends, self.starts[row], "right"))
            if k != held:
                held, ids = k, self.frame(k)
                base = int(self.frame_ends[k] - self.raw[k] // 4)
            at = int(self.starts[row]) - base
            yield row, ids[at:at + count]


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, key: str = "doc_id",
                      text: str = "text", end_id: int = 0) -> DataFrame:
    """Encode every text and write the files in ascending order of `key`; returns the manifest.

    Rows are range-partitioned on (key, text hash), so neither one hot source nor repeated ids
    end up in one file by themselves. The manifest has one row per file.
    """
    small_batches(docs.sparkSession)
    parts = prepared(tokenizer_path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path = f"{folder}/tokens-{shard:06d}-{uuid.uuid4().hex}.zst"
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = pretokens(parts)
            writer = writer or ShardWriter(path)
            texts = pc.fill_null(batch.column(1), "")
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
            doc_ids = batch.column(0).to_pylist()
            for a, b in slices(sizes):
                for doc_id, ids in zip(doc_ids[a:b], encoder.ids(texts[a:b].to_pylist()), strict=True):
                    writer.add(doc_id, np.append(ids, np.int32(end_id)))
        if writer is None:
            return
        writer.close()
        known = [i for i in writer.doc_ids if i is not None]
        row = [[shard], [path], [len(writer.counts)], [sum(writer.counts)], [writer.bytes],
               [known[0] if known else None], [known[-1] if known else None]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[0], pa.int32()), pa.array(row[1], pa.string()), *(pa.array(x, pa.int64()) for x in row[2:])],
            names=["shard", "path", "documents", "ids", "bytes", "first_id", "last_id"])

    order = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = order.withColumn("tie", F.xxhash64("text"))
    ranged = order.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    manifest = ranged.select("doc_id", "text").mapInArrow(write, _MANIFEST)
    place = f"{folder}/manifest"
    manifest.write.parquet(place)
    return docs.sparkSession.read.schema(_MANIFEST).parquet(place)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens and the ids' checksum.

    The global start of a file is a running sum over the manifest (a row per file).
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(path)
                sums = np.fromiter((zlib.crc32(ids.tobytes()) for _, ids in reader.documents()), np.int64)
                rows = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_ids, pa.int64(), mask=reader.nulls), pa.array(reader.starts + base),
                     pa.array(reader.counts), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                ) if rows else _none()

    def _none() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    files = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return based.repartition(files, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch_documents(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (array) of some documents: only files and frames that may hold them are read."""
    wanted = np.array(sorted(set(doc_ids)), np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader = ShardReader(path)
                rows = np.flatnonzero(np.isin(reader.doc_ids, wanted) & ~reader.nulls)
                got = list(reader.documents(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(reader.doc_ids[r]) for r, _ in got], pa.int64()),
                     pa.array([x.tolist() for _, x in got], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    low, high = (int(wanted[0]), int(wanted[-1])) if len(wanted) else (0, -1)
    near = manifest.where((F.col("first_id") <= high) & (F.col("last_id") >= low)).select("path")
    return near.mapInArrow(read, "doc_id long, ids array<long>")


def token_file_digest(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write `docs` to fresh files under the shared folder and digest them from the files."""
    manifest = write_token_files(docs, tokenizer_path, fresh_path(spark, "token-files"))
    return read_token_files(manifest)
