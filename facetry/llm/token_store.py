"""Token-id files (operator 9): independent zstandard frames, an index and a seek table at the end.

File: frames, then two skippable frames of the zstandard format. A frame decompresses to

    parts uint32, width uint32, then per part: doc_id int64, first id's place in the document uint64, ids uint32,
    then the ids, little-endian unsigned integers of `width` bytes

The first skippable frame is the index: per frame the first and last doc_id int64, ids before it in the file uint64. The
second is the seek table of the public seekable format: per frame its compressed and decompressed size and the low 32
bits of the XXH64 of its content, then the number of frames, a descriptor byte and the closing magic number. A reader
finds the frames of the documents it wants in the tail of the file and decompresses those alone.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_bpe
from ._shared import new_folder, tokenizer_path, written

# Magic numbers of the zstandard skippable frame and of its seekable format.
SKIPPABLE, SEEK_FRAME, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS = 1 << 17
FILE_BYTES = 32 << 20
NO_ID = -(1 << 63)


def opened(uri: str, mode: str):
    """A file of the shared store, by path or by any scheme that pyarrow knows."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        if mode == "wb":
            os.makedirs(os.path.dirname(at.path), exist_ok=True)
        return open(at.path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path) if mode == "rb" else store.open_output_stream(path)


class Writer:
    """Writes one file; add() documents in the order they are to be read, then close()."""

    def __init__(self, uri: str, width: int, level: int = 3):
        self.file, self.width, self.pack = opened(uri, "wb"), width, zstandard.ZstdCompressor(level=level)
        self.heads, self.body, self.held = [], [], 0
        self.table, self.index, self.bytes, self.ids = [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = NO_ID if doc_id is None else doc_id
        for s in range(0, max(1, len(ids)), FRAME_IDS):
            part = ids[s : s + FRAME_IDS]
            if self.held and self.held + len(part) > FRAME_IDS:
                self._frame()
            self.heads.append((key, s, len(part)))
            self.body.append(part.astype(f"<u{self.width}", copy=False).tobytes())
            self.held += len(part)

    def _frame(self) -> None:
        raw = struct.pack("<II", len(self.heads), self.width) + b"".join(struct.pack("<qQI", *h) for h in self.heads) + b"".join(self.body)
        data = self.pack.compress(raw)
        self.file.write(data)
        self.table.append(struct.pack("<III", len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append(struct.pack("<qqQ", self.heads[0][0], self.heads[-1][0], self.ids))
        self.bytes += len(data)
        self.ids += self.held
        self.heads, self.body, self.held = [], [], 0

    def close(self) -> None:
        if self.heads:
            self._frame()
        index = b"".join(self.index)
        table = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE, len(index)) + index + struct.pack("<II", SEEK_FRAME, len(table)) + table)
        self.file.close()


class Reader:
    """Reads one file, the frames of wanted documents only."""

    def __init__(self, uri: str):
        self.file = opened(uri, "rb")
        self.file.seek(-9, 2)
        n, descriptor, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEK_MAGIC or not descriptor & CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        tail = 9 + 12 * n + 8 + 24 * n + 8
        self.file.seek(-tail, 2)
        data = self.file.read(tail - 9)
        self.index = [struct.unpack_from("<qqQ", data, 8 + 24 * i) for i in range(n)]
        self.table = [struct.unpack_from("<III", data, 16 + 24 * n + 12 * i) for i in range(n)]
        self.places = np.r_[0, np.cumsum([t[0] for t in self.table])].astype(int).tolist()
        self.unpack = zstandard.ZstdDecompressor()
        self.frames_read = 0

    def frame(self, i: int):
        """(doc_id, place in the document, ids) of each part in a frame; a wrong checksum raises."""
        self.file.seek(self.places[i])
        size, whole, check = self.table[i]
        raw = self.unpack.decompress(self.file.read(size), max_output_size=whole)
        self.frames_read += 1
        if len(raw) != whole or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        n, width = struct.unpack_from("<II", raw)
        at = 8 + 20 * n
        for k in range(n):
            key, place, count = struct.unpack_from("<qQI", raw, 8 + 20 * k)
            yield key, place, np.frombuffer(raw, f"<u{width}", count, at)
            at += width * count

    def documents(self, wanted=None):
        """(doc_id, ids before it in the file, ids) of all documents, or of those whose id is in `wanted`."""
        keys = None if wanted is None else sorted({NO_ID if w is None else w for w in wanted})
        held, parts, start = None, [], 0
        for i, (first, last, before) in enumerate(self.index):
            if keys is not None:
                k = np.searchsorted(keys, first)
                if k == len(keys) or keys[k] > last:
                    continue
            for key, place, ids in self.frame(i):
                if keys is None or key in keys:
                    if place == 0 and held is not None:
                        yield held, start, np.concatenate(parts)
                        parts = []
                    if place == 0:
                        held, start = key, before
                    parts.append(ids)
                elif held is not None:
                    yield held, start, np.concatenate(parts)
                    held, parts = None, []
                before += len(ids)
        if held is not None:
            yield held, start, np.concatenate(parts)


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode every text, append `end_id` and write the files; returns the manifest: (file, task, number, first, docs, ids, ids_before).

    Documents go in ascending id, null ids first; rows of one id by their text, in one task but in as many files as they
    fill; a null text has the end id alone. Files follow one another by their task, a range of ids, and their number in
    it. Files of attempts that failed stay unlisted: a task names its own files and only the manifest counts.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    schema = pa.schema([("file", pa.string()), ("task", pa.int64()), ("number", pa.int64()), ("first", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(batches):
        model = byte_bpe.load(path)
        size = model.library.get_vocab_size()
        width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
        end, out, n, number, task = np.array([end_id], "<u4"), None, 0, -1, TaskContext.get().partitionId()

        def done():
            out.close()
            return pa.record_batch([pa.array([v], f.type) for v, f in zip((uri, task, number, first, n, out.ids), schema)], schema=schema)

        for b in batches:
            for d, ids in zip(b.column(0).to_pylist(), model.ids(b.column(1))):
                if out is not None and out.bytes >= FILE_BYTES:
                    yield done()
                    out = None
                if out is None:
                    uri, first, n, number = f"{folder}/ids-{uuid.uuid4().hex}.zst", d, 0, number + 1
                    out = Writer(uri, width)
                out.add(d, np.concatenate([np.frombuffer(ids, "<u4"), end]))
                n += 1
        if out is not None:
            yield done()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    files = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "file string, task long, number long, first long, docs long, ids long")
    files = written(files, "ids-files")
    # One row for every file of tens of megabytes.
    before = F.sum("ids").over(Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("ids_before", F.coalesce(before, F.lit(0)))


def read(spark: SparkSession, manifest: DataFrame, wanted=None) -> DataFrame:
    """(doc_id, start, ids array<long>) of the documents in the files, or of the ids in the list `wanted`."""

    def run(batches):
        for doc, start, ids in _documents(batches, wanted):
            yield pa.record_batch([pa.array([doc], pa.int64()), pa.array([start], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return _spread(manifest).mapInArrow(run, "doc_id long, start long, ids array<long>")


def _spread(manifest: DataFrame) -> DataFrame:
    """The files, a task for each or so: a stated number of partitions isn't merged into few."""
    return manifest.select("file", "ids_before").repartition(max(1, min(manifest.count(), 100_000)), "file")


def _documents(batches, wanted=None):
    for b in batches:
        for uri, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            reader = Reader(uri)
            for key, start, ids in reader.documents(wanted):
                yield None if key == NO_ID else key, before + start, ids
            reader.file.close()


def digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the CRC-32 of its ids as unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def batch(rows):
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        rows = []
        for doc, start, ids in _documents(batches):
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            if len(rows) == 4096:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return _spread(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """write() to a new folder of the shared store, then digests() of what the files hold."""
    spark = docs.sparkSession
    return digests(spark, write(docs, folder or new_folder(spark, "ids"), id_col, text_col, vocabulary, end_id))
