"""WARC archives: records written by Spark tasks, and read back by verified chains of boundaries.

Writing. Pages with equal payloads (same length, SHA-1 and xxhash64) form a group; the page with the
largest id is written as a `response` record with the payload behind a short HTTP header, every
other one as a `revisit` record with headers only (profile identical-payload-digest) that refers to
it. Each task writes files of its own name; a manifest that Spark commits lists them.

Reading. Archives aren't compressed, so any payload may hold the record magic, even whole records.

1. Tasks read byte ranges of the files ("splits") and emit a candidate for every magic behind which
   headers parse and the block's end is followed by the record separator: its offset and that of its
   successor. No candidate is trusted yet.
2. Inside its split a task follows successors to the first offset outside (`leaves_at`) and numbers
   the candidates so that "b lies on the chain from a" is a comparison of intervals.
3. Pointer jumping from offset 0 of each file over the few candidates that some chain enters a
   split at: reached offsets double their distance each round, so rounds are the logarithm of the
   most splits of a file.
4. Candidates on the chain from a reached entry are the records; all others are payload bytes.
5. Tasks read the records' blocks, hash payloads in pieces and compare them with the headers.

Defined cases: a null payload is empty; null page ids are smaller than all others; rows that share
both the largest id and the payload are all responses; a null url leaves its header out; an empty
table gives an empty manifest and no records. A file whose chain breaks off keeps the records up to
the break, with `complete` false.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, stage_table
from .common import column, small_batches

MAGIC = b"WARC/1.1\r\n"
SEPARATOR = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file that one task scans; bytes after which a task starts another file.
SPLIT_BYTES = 16 << 20
FILE_BYTES = 1 << 30
#: A header block is searched for its end in pieces of this size.
PIECE = 1 << 22
HEADER_PIECE = 1 << 12

_MANIFEST = "path string, records long, bytes long"
_CANDIDATES = ("path string, split long, at long, successor long, leaves_at long, tin int, tout int, "
               "block_at long, record_type string, record_id string, refers_to string, target_uri string, "
               "header_digest string")
_RECORDS = ("path string, at long, page_id long, record_type string, refers_to long, target_uri string, "
            "payload_bytes long, payload_digest string, digest_ok boolean, complete boolean")
_HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")
_NUMBER = re.compile(rb"[0-9]{1,18}")
_RECORD_ID = re.compile(r"<urn:page:(-?\d+)>")


# --- writing -------------------------------------------------------------------------------------

def _header_value(text: str) -> bytes:
    """A url as one header line: control characters, spaces and non-ASCII characters as %XX."""
    return urllib.parse.quote(text, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").encode()


def _urn(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page_id is None else b"%d" % page_id)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str,
                 refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One whole record; `size` and `digest` are those of the full payload, also for revisits."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    lines = [b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _urn(page_id),
             b"WARC-Date: " + date.encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _header_value(url))
    lines.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if revisit:
        lines += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: " + _urn(refers_to)]
    lines += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return MAGIC + b"\r\n".join(lines) + SEPARATOR + block + SEPARATOR


def mark_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, html, size, sha1 (hex), refers_to and revisit of every page.

    Groups of equal payloads are one aggregate over narrow columns, combined before the shuffle;
    only groups of two or more are joined back, so without many copies the payloads aren't shuffled.
    """
    rows = pages.select(column(pages, key).cast("long").alias("page_id"), column(pages, url).cast("string").alias("url"),
                        F.coalesce(column(pages, payload).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "sha1": F.sha1("html"),
                             "xx": F.xxhash64("html")})
    same = ["sha1", "xx", "size"]
    groups = rows.groupBy(*same).agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    groups = stage_table(groups.where("n > 1").drop("n"), "equal-payloads")
    joined = rows.join(groups.withColumn("several", F.lit(True)), same, "left")
    revisit = F.col("several").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select("page_id", "url", "html", "size", "sha1",
                         F.when(revisit, F.col("response")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(marked: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z",
               file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages of `mark_revisits`; returns the manifest (path, records, bytes)."""
    small_batches(marked.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        records = size = 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, html, full, sha1, refers_to, revisit in zip(
                    *(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if out is None:
                    path = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc"
                    fs, name = pyarrow.fs.FileSystem.from_uri(path)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(name, compression=None)
                    records = size = 0
                data = record_bytes(page_id, url, b"" if revisit else html.encode(), full,
                                    base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, revisit, date)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    done, out = [*done, (path, records, size)], None
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done, strict=True)],
                                             names=["path", "records", "bytes"])

    place = f"{folder}/manifest"
    marked.select("page_id", "url", "html", "size", "sha1", "refers_to", "revisit").mapInArrow(
        write, _MANIFEST).write.parquet(place)
    return marked.sparkSession.read.schema(_MANIFEST).parquet(place)


# --- boundaries ----------------------------------------------------------------------------------

class FileBytes:
    """Bytes of a file: one range held, everything else read when asked for."""

    def __init__(self, path: str, start: int = 0, end: int = 0):
        fs, name = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        self.size = self.file.size()
        self.start, self.end = start, min(end, self.size)
        self.held = self.file.read_at(self.end - start, start) if self.end > start else b""

    def get(self, a: int, b: int) -> bytes:
        b = min(b, self.size)
        if a >= b:
            return b""
        if self.start <= a and b <= self.end:
            return self.held[a - self.start:b - self.start]
        return self.file.read_at(b - a, a)

    def header(self, at: int) -> tuple[dict[bytes, bytes], int] | None:
        """(headers in lower case, offset of the block) of a record at `at`; None if it isn't one.

        Lines are parsed one by one, so bytes that aren't headers end the search at once.
        """
        data, fields = self.get(at, at + HEADER_PIECE), {}
        if not data.startswith(MAGIC):
            return None
        place = len(MAGIC)
        while True:
            if data.startswith(b"\r\n", place):
                return fields, at + place + 2
            line = _HEADER.match(data, place)
            if line:
                fields[line[1].lower()] = line[2]
                place = line.end()
                continue
            if data.find(b"\n", place) >= 0 or at + len(data) >= self.size:
                return None
            data += self.get(at + len(data), at + 2 * len(data))

    def candidate(self, at: int) -> tuple | None:
        """(successor, offset of the block, headers) if a whole record could start at `at`."""
        found = self.header(at)
        if found is None:
            return None
        fields, block_at = found
        length = fields.get(b"content-length", b"")
        if not _NUMBER.fullmatch(length) or b"warc-type" not in fields or b"warc-record-id" not in fields:
            return None
        successor = block_at + int(length) + len(SEPARATOR)
        if successor > self.size or self.get(successor - len(SEPARATOR), successor) != SEPARATOR:
            return None
        return successor, block_at, fields


def chains(at: list[int], successor: list[int], end: int) -> tuple[list[int], list[int], list[int]]:
    """Where each candidate's chain leaves the split (-1: it breaks off inside), and its interval.

    Successors lie behind their candidates, so candidates form a forest whose roots leave the split
    or break off; b lies on the chain from a exactly if tin[b] <= tin[a] <= tout[b].
    """
    place = {a: k for k, a in enumerate(at)}
    size, next_ = [1] * len(at), [place.get(s, -1) for s in successor]
    for k, n in enumerate(next_):  # ascending: all that lead to k came before
        if n >= 0:
            size[n] += size[k]
    leaves, tin, free, roots = [0] * len(at), [0] * len(at), [0] * len(at), 0
    for k in range(len(at) - 1, -1, -1):
        n = next_[k]
        if n < 0:
            leaves[k] = successor[k] if successor[k] >= end else -1
            tin[k], roots = roots, roots + size[k]
        else:
            leaves[k] = leaves[n]
            tin[k] = free[n]
            free[n] += size[k]
        free[k] = tin[k] + 1
    return leaves, tin, [t + n - 1 for t, n in zip(tin, size, strict=True)]


def _candidates(path: str, split: int, split_bytes: int) -> pa.RecordBatch:
    a, b = split * split_bytes, (split + 1) * split_bytes
    source = FileBytes(path, a, b + len(MAGIC) + HEADER_PIECE)
    found, place = [], source.held.find(MAGIC)
    while 0 <= place < b - a:
        one = source.candidate(a + place)
        if one:
            found.append((a + place, *one))
        place = source.held.find(MAGIC, place + 1)
    at, successor = [x[0] for x in found], [x[1] for x in found]
    leaves, tin, tout = chains(at, successor, min(b, source.size))

    def field(name: bytes) -> pa.Array:
        return pa.array([x[3][name].decode("latin-1") if name in x[3] else None for x in found], pa.string())

    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(found), pa.string()), pa.array([split] * len(found), pa.int64()),
         pa.array(at, pa.int64()), pa.array(successor, pa.int64()), pa.array(leaves, pa.int64()),
         pa.array(tin, pa.int32()), pa.array(tout, pa.int32()), pa.array([x[2] for x in found], pa.int64()),
         *(field(name) for name in (b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-target-uri",
                                    b"warc-payload-digest"))],
        names=[c.split()[0] for c in _CANDIDATES.split(", ")])


def find_candidates(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every place of the files where a record could start, staged under the shared folder."""
    spark = manifest.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, split in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _candidates(path, split, split_bytes)

    last = F.expr(f"(bytes - 1) div {split_bytes}")
    splits = manifest.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("split"))
    return stage_table(splits.repartition(_tasks(spark), "path", "split").mapInArrow(scan, _CANDIDATES), "warc-candidates")


def _tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chain_entries(candidates: DataFrame, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, at) that the chain from each file's start reaches in 0, 1, 2, ... split changes.

    `at` is a candidate that the chain enters a split by, or the file's size where it ends there.
    """
    steps = candidates.select("path", "at", F.col("leaves_at").alias("to"))
    exits = steps.where("`to` >= 0").select("path", F.col("to").alias("at")).distinct()
    jumps = stage_table(steps.join(exits, ["path", "at"], "left_semi").union(
        steps.where("at = 0").join(exits, ["path", "at"], "left_anti")), "warc-jumps")
    reached = manifest.where("bytes > 0").select("path", F.lit(0).cast("long").alias("at"))
    most = manifest.agg(F.max("bytes")).first()[0] or 0
    for _ in range(math.ceil(math.log2(most // split_bytes + 2))):
        further = reached.join(jumps, ["path", "at"]).where("`to` >= 0").select("path", F.col("to").alias("at"))
        reached = stage_table(reached.union(further).distinct(), "warc-reached")
        onward = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = stage_table(jumps.join(onward, ["path", "to"], "left").select(
            "path", "at", F.coalesce("beyond", "to").alias("to")), "warc-jumps")
    return reached


def reachable_records(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The candidates on the verified chains, with `complete`: the file's chain ends at its last byte."""
    candidates = find_candidates(manifest, split_bytes)
    reached = chain_entries(candidates, manifest, split_bytes)
    entries = candidates.join(reached, ["path", "at"]).select("path", "split", F.col("tin").alias("entry"))
    ended = reached.join(manifest.select("path", F.col("bytes").alias("at")), ["path", "at"]).select(
        "path", F.lit(True).alias("ended"))
    kept = candidates.join(entries, ["path", "split"]).where("entry BETWEEN tin AND tout")
    return kept.join(ended, "path", "left").select(
        *candidates.columns, F.coalesce("ended", F.lit(False)).alias("complete"))


# --- reading -------------------------------------------------------------------------------------

def _page(urn: str | None) -> int | None:
    found = _RECORD_ID.fullmatch(urn or "")
    return int(found[1]) if found else None


def _payload(source: FileBytes, a: int, b: int, keep: bool) -> tuple[int, str, bytes | None]:
    """(bytes, base32 SHA-1, payload if kept) of the HTTP body in the block [a, b); b'' without a header's end."""
    head, place = b"", -1
    while place < 0 and a + len(head) < b:
        head += source.get(a + len(head), min(b, a + max(HEADER_PIECE, 2 * len(head))))
        place = head.find(SEPARATOR)
    body = a + place + len(SEPARATOR) if place >= 0 else b
    sha, parts = hashlib.sha1(), []
    for at in range(body, b, PIECE):
        part = source.get(at, min(b, at + PIECE))
        sha.update(part)
        if keep:
            parts.append(part)
    return b - body, base64.b32encode(sha.digest()).decode(), b"".join(parts) if keep else None


def _promised(source: FileBytes, a: int, b: int) -> int | None:
    """The full payload's size that the HTTP header of a revisit states."""
    found = re.search(rb"(?mi)^content-length:[ \t]*([0-9]{1,18})\r$", source.get(a, b))
    return int(found[1]) if found else None


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """One row per record of the archives; with `payloads` also the payload (null for revisits).

    `payload_bytes` and `payload_digest` are those of the full payload: read and hashed for
    responses (`digest_ok`: equal to the header), stated by the headers for revisits.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, source = None, None
        for batch in batches:
            out, bodies = [], []
            for path, at, block_at, successor, kind, urn, refers, uri, digest, complete in zip(
                    *(batch.column(k).to_pylist() for k in range(10)), strict=True):
                if path != held:
                    held, source = path, FileBytes(path)
                end, stated = successor - len(SEPARATOR), (digest or "").removeprefix("sha1:")
                if kind == "revisit":
                    size, sha, body, same = _promised(source, block_at, end), stated, None, True
                else:
                    size, sha, body = _payload(source, block_at, end, payloads)
                    same = sha == stated
                out.append((path, at, _page(urn), kind, _page(refers), uri, size, sha, same, complete))
                bodies.append(body)
            if out:
                arrays = [pa.array(list(x), f) for x, f in zip(zip(*out, strict=True), _types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(bodies, pa.binary())] if payloads else []), names=names)

    _types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(),
              pa.bool_(), pa.bool_()]
    schema = _RECORDS + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]
    small_batches(manifest.sparkSession)
    records = reachable_records(manifest, split_bytes).select(
        "path", "at", "block_at", "successor", "record_type", "record_id", "refers_to", "target_uri",
        "header_digest", "complete", "split")
    dealt = records.repartition(_tasks(manifest.sparkSession), "path", "split").sortWithinPartitions("path", "at")
    return dealt.drop("split").mapInArrow(read, schema)


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives under the shared folder and read all records back."""
    return read_warc(write_warc(mark_revisits(pages), fresh_path(spark, "warc")))
