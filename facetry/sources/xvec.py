"""Vector files: records of a little-endian 32-bit dimension and that many components.

`spark.read.format("xvec").load(path)` gives (ordinal, vector); a folder's files follow one another by name. The element
type comes from the extension, the dimension from the first record; every record must agree. The options `start` and
`end` bound the ordinals that are read.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import storage


@dataclass(frozen=True)
class Element:
    disk: str
    memory: str
    spark: T.DataType


# The formats by extension; half floats are read as floats, bytes are unsigned.
ELEMENTS = {
    "fvec": Element("<f4", "float32", T.FloatType()),
    "ivec": Element("<i4", "int32", T.IntegerType()),
    "bvec": Element("u1", "int16", T.ShortType()),
    "dvec": Element("<f8", "float64", T.DoubleType()),
    "mvec": Element("<f2", "float32", T.FloatType()),
    "svec": Element("<i2", "int16", T.ShortType()),
}
LARGEST_DIMENSION = 1 << 20


def element_of(path: str, kind: str | None = None) -> Element:
    name = (kind or path.rpartition(".")[2]).lower()
    name = name[:-1] if name.endswith("vecs") else name
    if name not in ELEMENTS:
        raise ValueError(f"no vector format for {path!r}")
    return ELEMENTS[name]


@dataclass(frozen=True)
class Layout:
    """Dimension, bytes of a record and number of records of one file."""

    uri: str
    element: Element
    dimension: int
    stride: int
    rows: int


def layout(uri: str, kind: str | None = None) -> Layout:
    element, n = element_of(uri, kind), storage.size(uri)
    if n == 0:
        return Layout(uri, element, 0, 0, 0)
    (dimension,) = struct.unpack("<i", storage.read_range(uri, 0, 4))
    if not 0 < dimension <= LARGEST_DIMENSION:
        raise ValueError(f"{uri}: a dimension of {dimension} (is the file big-endian?)")
    stride = 4 + dimension * np.dtype(element.disk).itemsize
    if n % stride:
        raise ValueError(f"{uri}: {n} bytes are no whole number of records of {stride}")
    return Layout(uri, element, dimension, stride, n // stride)


def byte_order(uri: str, kind: str | None = None) -> dict:
    """Whether the file can be read with little- and with big-endian headers; `mismatch` where only the latter."""
    item, n = np.dtype(element_of(uri, kind).disk).itemsize, storage.size(uri)
    head = storage.read_range(uri, 0, 4)

    def valid(order: str) -> bool:
        if len(head) < 4:
            return False
        (d,) = struct.unpack(order + "i", head)
        return 0 < d <= LARGEST_DIMENSION and 4 + d * item <= n and n % (4 + d * item) == 0

    little, big = valid("<"), valid(">")
    return {"little": little, "big": big, "mismatch": big and not little}


def info(uri: str, kind: str | None = None) -> dict:
    """Format, dimension, records and bytes of a vector file."""
    at = layout(uri, kind)
    return {"element": at.element.memory, "dimension": at.dimension, "rows": at.rows, "bytes": storage.size(uri), **byte_order(uri, kind)}


def decode(raw: bytes, at: Layout) -> np.ndarray:
    """(rows, dimension) of whole records; a record of another dimension raises."""
    rows = np.frombuffer(raw, np.dtype([("d", "<i4"), ("v", at.element.disk, (at.dimension,))]))
    if (rows["d"] != at.dimension).any():
        raise ValueError(f"{at.uri}: records of different dimensions")
    return rows["v"].astype(at.element.memory)


def encode(vectors: np.ndarray, element: Element) -> bytes:
    """Records of a matrix. Half floats are rounded to even; bytes must be 0 to 255."""
    if element.disk == "u1" and len(vectors) and (vectors.min() < 0 or vectors.max() > 255):
        raise ValueError("a byte vector's components are from 0 to 255")
    out = np.empty(len(vectors), np.dtype([("d", "<i4"), ("v", element.disk, (vectors.shape[1],))]))
    out["d"], out["v"] = vectors.shape[1], vectors.astype(element.disk)
    return out.tobytes()


@dataclass
class _Range(InputPartition):
    layout: Layout
    lo: int
    hi: int
    base: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        kind = options.get("kind")
        self.kind, self.batch = kind, int(options.get("batchrows", 4096))
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        suffixes = tuple(f".{x}{s}" for x in ELEMENTS for s in ("", "s")) if kind is None else ()
        self.layouts = [layout(f, kind) for f in storage.files(path, suffixes)]
        if len({x.dimension for x in self.layouts if x.rows}) > 1:
            raise ValueError(f"{path}: files of different dimensions")
        self.lo, self.hi = int(options.get("start", 0)), options.get("end")
        self.hi = None if self.hi is None else int(self.hi)

    def partitions(self):
        out, base = [], 0
        for x in self.layouts:
            lo, hi = max(0, self.lo - base), x.rows if self.hi is None else min(x.rows, self.hi - base)
            step = max(1, self.bytes // x.stride) if x.stride else 1
            out += [_Range(x, a, min(a + step, hi), base) for a in range(lo, hi, step)]
            base += x.rows
        return out

    def read(self, p) -> Iterator[pa.RecordBatch]:
        if not isinstance(p, _Range):
            return
        with storage.open_read(p.layout.uri) as f:
            f.seek(p.lo * p.layout.stride)
            for a in range(p.lo, p.hi, self.batch):
                n = min(self.batch, p.hi - a)
                v = decode(f.read(n * p.layout.stride), p.layout)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.layout.dimension), pa.array(v.reshape(-1)))
                yield pa.record_batch([pa.array(np.arange(p.base + a, p.base + a + n)), lists], names=["ordinal", "vector"])


@dataclass
class _Part(WriterCommitMessage):
    uri: str | None
    rows: int
    dimension: int


class _Writer(DataSourceArrowWriter):
    """Part files named in the order of the partitions: sort by ordinal before writing."""

    def __init__(self, path: str, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite = path.rstrip("/"), options.get("kind", "fvec"), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        element, out, rows, dimension = element_of("", self.kind), None, 0, 0
        uri = f"{self.path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.{self.kind}.tmp"
        for b in batches:
            for v in _matrices(b.column(b.schema.get_field_index("vector"))):
                if dimension not in (0, v.shape[1]):
                    raise ValueError("vectors must be of one length")
                out = out or storage.open_write(uri)
                out.write(encode(v, element))
                rows, dimension = rows + len(v), v.shape[1]
        if out:
            out.close()
        return _Part(uri if out else None, rows, dimension)

    def commit(self, messages) -> None:
        done = [m for m in messages if m and m.uri]
        if len({m.dimension for m in done}) > 1:
            raise ValueError("vectors must be of one length")
        for m in done:
            storage.replace(m.uri, m.uri.removesuffix(".tmp"))

    def abort(self, messages) -> None:
        pass


def _matrices(column: pa.Array):
    """A list column as a matrix; null vectors and unequal lengths raise."""
    if column.null_count:
        raise ValueError("a vector is null")
    if len(column):
        flat, n = column.flatten(), len(column)
        if flat.null_count or len(flat) % n or (np.asarray(column.value_lengths()) != len(flat) // n).any():
            raise ValueError("vectors must be given and of one length")
        yield flat.to_numpy(zero_copy_only=False).reshape(n, -1)


class XvecSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xvec"

    def _path(self) -> str:
        return self.options["path"]

    def schema(self) -> T.StructType:
        kind = self.options.get("kind")
        if kind is None:
            found = storage.files(self._path(), tuple(f".{x}{s}" for x in ELEMENTS for s in ("", "s")))
            if not found:
                raise ValueError(f"no vector files in {self._path()}")
            kind = found[0].rpartition(".")[2]
        return T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("vector", T.ArrayType(element_of("", kind).spark))])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._path(), dict(self.options))

    def writer(self, schema, overwrite: bool):
        return _Writer(self._path(), dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XvecSource)


def read(spark: SparkSession, path: str, kind: str | None = None, window=None) -> DataFrame:
    """A facet of (ordinal, vector).

    A window's bounds go to the reader as options, which opens only the byte ranges between them. (Filters pushed to a
    Python source stay with it for the frame's later scans, so none are taken.)
    """
    from ..operators.windows import Window

    register(spark)
    window = Window.of(window)
    r = spark.read.format("xvec")
    if kind:
        r = r.option("kind", kind)
    if window:
        r = r.option("start", min(i.lo for i in window)).option("end", max(i.hi for i in window))
    return window.apply(r.load(path))


def write(facet: DataFrame, path: str, kind: str = "fvec", parts: int | None = None) -> None:
    """Part files that hold the facet in the order of its ordinals, one record for each row."""
    register(facet.sparkSession)
    rows = facet.repartitionByRange(parts, "ordinal") if parts else facet.repartitionByRange("ordinal")
    rows.sortWithinPartitions("ordinal").select("vector").write.format("xvec").option("kind", kind).mode("append").save(path)


def assemble(folder: str, target: str) -> int:
    """The part files of a folder as one file, in order; returns its bytes."""
    total = 0
    with storage.open_write(target + ".tmp") as out:
        for f in storage.files(folder):
            if re.search(r"part-\d+-\w+\.\w+$", f):
                with storage.open_read(f) as part:
                    while data := part.read(16 << 20):
                        out.write(data)
                        total += len(data)
    storage.replace(target + ".tmp", target)
    return total


# --- delimited text and Parquet ------------------------------------------------------------------------------------


def read_json_csv(spark: SparkSession, path: str, element: str = "float") -> DataFrame:
    """Vectors of a CSV file in which exactly one column holds JSON arrays: (line, vector).

    The first rows tell the column and whether there is a header. No or several such columns raise; rows whose array
    can't be read are left out. `line` orders the rows of a file and is not dense.
    """
    raw = spark.read.option("header", False).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)
    sample = raw.limit(20).collect()
    is_array = lambda v: v is not None and re.fullmatch(r"\s*\[\s*(-?[\d.eE+-]+\s*(,\s*-?[\d.eE+-]+\s*)*)?\]\s*", v) is not None
    body = sample[1:] if sample and not any(map(is_array, sample[0])) else sample
    columns = [c for c in raw.columns if any(is_array(r[c]) for r in body)]
    if len(columns) != 1:
        raise ValueError(f"{path}: {len(columns)} columns of JSON arrays; one is needed")
    vector = F.from_json(F.col(columns[0]), f"array<{element}>")
    return raw.select(F.monotonically_increasing_id().alias("line"), vector.alias("vector")).where("vector is not null and not exists(vector, x -> x is null)")


# The columns that Parquet converters read, by their names.
PARQUET_COLUMNS = {"EMBEDDINGS_LIST_FLOAT": "embeddings", "HFEMBED": "emb"}


def read_parquet(spark: SparkSession, paths: list[str], converter: str = "HFEMBED") -> DataFrame:
    """(file, place, vector): vectors of Parquet files in the order of `paths`, and of their rows within a file.

    (file, place) orders all rows without numbering them densely; dense() does that.
    """
    column = PARQUET_COLUMNS[converter.upper()]
    order = F.create_map(*[x for i, p in enumerate(paths) for x in (F.lit(p.rpartition("/")[2] if len(paths) == 1 else p.removeprefix("file:").replace("//", "/")), F.lit(i))])
    rows = spark.read.parquet(*paths)
    at = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:", ""), "^/+", "/")
    file = F.try_element_at(order, F.element_at(F.split(at, "/"), -1) if len(paths) == 1 else at)
    return rows.select(F.coalesce(file, F.lit(0)).alias("file"), F.col("_metadata.row_index").alias("place"), F.col(column).alias("vector"))


def dense(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with ordinals from 0 in the order of the columns: one shuffle into ranges, no single task.

    Ranges and places within them are written before they are counted, so that a task that runs again, or a stage whose
    partitions are merged, changes no number.
    """
    from pyspark.sql import Window

    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    spread = storage.written(ranges, "dense")
    # The upper bits are the partition, the lower 33 the place in it.
    part = F.shiftright("_id", 33)
    # One row for each partition.
    counts = spread.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return spread.join(F.broadcast(starts), part == F.col("_part")).withColumn("ordinal", (F.col("_before") + place).cast("long")).drop("_part", "_before", "_id")


def ordered_groups(paths: list[str]) -> list[list[str]]:
    """Parquet files in reading order: files given as such are one group; folders a group for each, the largest first,
    then by name, files sorted inside. Files and folders together raise."""
    kinds = {storage.files(p) != [p] for p in paths}
    if len(kinds) > 1:
        raise ValueError("give files or folders, not both")
    if kinds == {False}:
        return [sorted(paths)]
    groups: dict[str, list[str]] = {}
    for p in paths:
        for f in storage.files(p, (".parquet",)):
            groups.setdefault(f.rpartition("/")[0], []).append(f)
    total = {d: sum(map(storage.size, fs)) for d, fs in groups.items()}
    return [sorted(groups[d]) for d in sorted(groups, key=lambda d: (-total[d], d))]


def bins(paths: list[str], pattern: str) -> dict[str, list[str]]:
    """Files by the named group `bin` that the pattern finds in their paths; files at different depths raise."""
    if len({p.count("/") for p in paths}) > 1:
        raise ValueError("files lie at different depths")
    out: dict[str, list[str]] = {}
    for p in sorted(paths):
        m = re.search(pattern, p)
        if m is None:
            raise ValueError(f"{p} matches no bin")
        out.setdefault(m["bin"], []).append(p)
    return out
