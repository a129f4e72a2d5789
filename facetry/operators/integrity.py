"""Chunk hashes and Merkle trees over files or tables, and their comparison."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage

# Limits of chunk sizes and the footer's length.
SMALLEST, LARGEST, MOST_CHUNKS, FOOTER = 1 << 20, 64 << 20, 4096, 45


def chunk_size(size: int) -> int:
    """The chunk size of a content of `size` bytes: a power of two."""
    if size < 0:
        raise ValueError("a size below zero")
    if 0 < size < 1 << 10:
        return 64
    if 0 < size < SMALLEST:
        return max(1 << 10, 1 << (size - 1).bit_length())
    out = SMALLEST
    while out < LARGEST and -(-size // out) > MOST_CHUNKS:
        out *= 2
    return out


@dataclass(frozen=True)
class Shape:
    size: int
    chunk: int

    @staticmethod
    def of(size: int, chunk: int | None = None) -> Shape:
        chunk = chunk or chunk_size(size)
        if chunk <= 0 or chunk & (chunk - 1):
            raise ValueError("a chunk's size is a power of two")
        return Shape(size, chunk)

    @property
    def chunks(self) -> int:
        return -(-self.size // self.chunk)

    @property
    def leaves(self) -> int:
        return 1 << max(0, self.chunks - 1).bit_length() if self.chunks else 1

    @property
    def nodes(self) -> int:
        return 2 * self.leaves - 1


def file_chunks(spark: SparkSession, uri: str, shape: Shape | None = None) -> DataFrame:
    """(chunk, start, end, hash): the SHA-256 of each chunk of a file, read by byte ranges in parallel."""
    import pyarrow as pa

    shape = shape or Shape.of(storage.size(uri))

    def run(batches):
        for b in batches:
            hashes = []
            for start in b.column(1).to_pylist():
                hashes.append(hashlib.sha256(storage.read_range(uri, start, shape.chunk)).hexdigest())
            yield pa.record_batch([*b.columns, pa.array(hashes, pa.string())], names=["chunk", "start", "end", "hash"])

    ids = spark.range(shape.chunks)
    start = F.col("id") * shape.chunk
    return ids.select(F.col("id").alias("chunk"), start.alias("start"), F.least(start + shape.chunk, F.lit(shape.size)).alias("end")).mapInArrow(run, "chunk long, start long, end long, hash string")


def content_chunks(rows: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """(key, chunk, start, end, hash) of every row's content in chunks of `size` bytes; an empty content has none."""
    data = F.col(content).cast("binary")
    n = F.length(data)
    out = rows.where(n > 0).select(F.col(key), data.alias("_data"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("_c"))
    start = F.col("_c") * size
    end = F.least(start + size, F.length("_data"))
    return out.select(key, F.col("_c").cast("long").alias("chunk"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.sha2(F.substring("_data", start + 1, F.lit(size)), 256).alias("hash"))


def tree(leaves: list[bytes], padded: bool = True) -> list[bytes]:
    """All nodes from the root down. Missing leaves are hashes of nothing but zeros, or, with padded=False, leave the
    parents above them empty (32 zero bytes)."""
    width = 1 << max(0, len(leaves) - 1).bit_length() if leaves else 1
    missing = bytes(32)
    level: list[bytes | None] = [*leaves, *[missing if padded else None] * (width - len(leaves))]
    levels = [level]
    while len(level) > 1:
        level = [hashlib.sha256(a + b).digest() if a is not None and b is not None else None for a, b in zip(level[::2], level[1::2])]
        levels.append(level)
    return [x if x is not None else missing for lv in reversed(levels) for x in lv]


#: Nodes that one step towards the root takes together.
FAN = 1024


def root(chunks: DataFrame, count: int) -> DataFrame:
    """One row (hash) of (chunk, hash), chunks numbered from 0 to count - 1; missing leaves are 32 zero bytes.

    A step replaces up to FAN neighbouring nodes by the root of their subtree: three shuffles for a thousand million.
    """
    width = 1 << max(0, count - 1).bit_length()
    level, empty = chunks.select(F.col("chunk").alias("node"), "hash"), bytes(32)
    while width > 1:
        fan = min(FAN, width)
        members = F.sort_array(F.collect_list(F.struct("node", "hash")))
        level = level.groupBy(F.floor(F.col("node") / fan).cast("long").alias("group")).agg(members.alias("members")).mapInArrow(_step(fan, empty), "node long, hash string")
        width //= fan
        empty = tree([empty] * fan)[0]
    return level.select("hash")


def _step(fan: int, empty: bytes):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            hashes = []
            for members in b.column(1).to_pylist():
                leaves = [empty] * fan
                for m in members:
                    leaves[m["node"] % fan] = bytes.fromhex(m["hash"])
                hashes.append(tree(leaves)[0].hex())
            yield pa.record_batch([b.column(0), pa.array(hashes, pa.string())], names=["node", "hash"])

    return run


def mismatches(a: DataFrame, b: DataFrame, same_shape: bool = True) -> DataFrame:
    """(chunk) where the hashes differ or one side lacks the chunk; with different shapes every chunk does."""
    if not same_shape:
        return a.select("chunk").union(b.select("chunk")).distinct()
    j = a.select("chunk", F.col("hash").alias("h1")).join(b.select("chunk", F.col("hash").alias("h2")), "chunk", "full")
    return j.where(~F.col("h1").eqNullSafe(F.col("h2"))).select("chunk")


def valid(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """The chunks whose hash is the expected one."""
    return chunks.join(expected.select("chunk", "hash"), ["chunk", "hash"], "left_semi")


def path_to_root(nodes: list[bytes], leaf: int) -> list[tuple[int, bytes]]:
    """(node, hash) from a leaf up to the root, in the numbering of tree()."""
    at = (len(nodes) + 1) // 2 - 1 + leaf
    out = [(at, nodes[at])]
    while at:
        at = (at - 1) // 2
        out.append((at, nodes[at]))
    return out


def save(uri: str, shape: Shape, nodes: list[bytes], valid_chunks: set[int] | None = None) -> None:
    """Hashes, the bits of valid chunks, and the big-endian footer."""
    if len(nodes) != shape.nodes:
        raise ValueError("not this shape's nodes")
    bits = bytearray(-(-shape.chunks // 8))
    for c in range(shape.chunks) if valid_chunks is None else valid_chunks:
        bits[c // 8] |= 1 << c % 8
    with storage.open_write(uri + ".tmp") as f:
        f.write(b"".join(nodes) + bytes(bits))
        f.write(struct.pack(">qqiiiiiiib", shape.chunk, shape.size, shape.chunks, shape.leaves, shape.leaves, shape.nodes, shape.leaves - 1, shape.leaves - 1, len(bits), FOOTER))
    storage.replace(uri + ".tmp", uri)


def load(uri: str) -> tuple[Shape, list[bytes], set[int]]:
    n = storage.size(uri)
    chunk, size, chunks, leaves, _, nodes, _, _, bits, length = struct.unpack(">qqiiiiiiib", storage.read_range(uri, n - FOOTER, FOOTER))
    if length != FOOTER or n != nodes * 32 + bits + FOOTER:
        raise ValueError(f"{uri}: no Merkle file")
    raw = storage.read_range(uri, 0, n - FOOTER)
    mask = raw[nodes * 32 :]
    return Shape(size, chunk), [raw[i * 32 : i * 32 + 32] for i in range(nodes)], {c for c in range(chunks) if mask[c // 8] >> c % 8 & 1}


def summary(uri: str) -> dict:
    """What a Merkle file says of its content: sizes, chunks, how many are valid, and the root."""
    shape, nodes, valid_chunks = load(uri)
    return {"bytes": shape.size, "chunk": shape.chunk, "chunks": shape.chunks, "leaves": shape.leaves, "valid": len(valid_chunks), "root": nodes[0].hex()}


def spoil(uri: str, chunks: set[int], hashes: bool = False) -> None:
    """Take chunks' valid bits out of a Merkle file, and with `hashes` their hashes too (zeros, up to the root)."""
    shape, nodes, valid_chunks = load(uri)
    if wrong := sorted(c for c in chunks if not 0 <= c < shape.chunks):
        raise ValueError(f"{uri} has no chunks {wrong}")
    if hashes:
        leaves = nodes[shape.leaves - 1 :]
        nodes = tree([bytes(32) if i in chunks else h for i, h in enumerate(leaves)])
    save(uri, shape, nodes, valid_chunks - chunks)


def treeview(uri: str, depth: int = 4) -> list[str]:
    """A line for each node of the uppermost `depth` levels: level, number, the chunks below it, and its hash."""
    shape, nodes, valid_chunks = load(uri)
    out, level, first = [], 0, 0
    while level < depth and first < shape.nodes:
        width = 1 << level
        span = shape.leaves // width
        for i in range(width):
            below = range(i * span, min((i + 1) * span, shape.chunks))
            have = sum(c in valid_chunks for c in below)
            chunks = f"chunks {below.start} to {below.stop - 1}, {have} valid" if len(below) else "no chunks"
            out.append(f"{'  ' * level}{first + i}: {chunks}, {nodes[first + i].hex()[:16]}")
        first, level = first + width, level + 1
    return out
