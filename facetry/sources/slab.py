"""Slab stores: namespaced maps of ordinals to bytes, in pages.

A page is a header (`SLAB`, size), records without gaps, a zero-filled gap, the offsets of the records (one more than
there are), and a footer. Pages pages index data pages by first ordinal; a store with other than the default namespace
ends in a page of namespaces. `spark.read.format("slab").load(path)` gives (namespace, ordinal, data), one partition for
a share of a store's pages; the options `namespace`, `start` and `end` skip pages.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import storage

# The page format.
MAGIC = b"SLAB"
HEADER, FOOTER, ALIGN = 8, 16, 512
INDEX_PAGE, DATA_PAGE, NAMESPACE_PAGE = 1, 2, 3
DEFAULT_NAMESPACE, LONGEST_NAME = 1, 128
FIRST_ORDINAL, LAST_ORDINAL, MOST_RECORDS, LARGEST_PAGE = -(1 << 39), (1 << 39) - 1, (1 << 24) - 1, (1 << 32) - 1


@dataclass(frozen=True)
class Page:
    """What a page's footer says, and where the page begins."""

    at: int
    size: int
    kind: int
    first: int
    records: int
    namespace: int

    @property
    def end(self) -> int:
        return self.first + self.records


def build_page(kind: int, namespace: int, first: int, records: list[bytes]) -> bytes:
    """One page; its size is a multiple of 512."""
    body = sum(map(len, records))
    used = HEADER + body + 4 * (len(records) + 1) + FOOTER
    size = -(-used // ALIGN) * ALIGN
    if size > LARGEST_PAGE or len(records) > MOST_RECORDS:
        raise ValueError("too much for one page")
    offsets, place = [], HEADER
    for r in records:
        offsets.append(place)
        place += len(r)
    table = struct.pack(f"<{len(records) + 1}I", *offsets, place)
    foot = first.to_bytes(5, "little", signed=True) + len(records).to_bytes(3, "little") + struct.pack("<IBBH", size, kind, namespace, FOOTER)
    return b"".join([MAGIC, struct.pack("<I", size), *records, bytes(size - used), table, foot])


def parse_footer(raw: bytes, end: int) -> Page:
    size, kind, namespace, length = struct.unpack("<IBBH", raw[8:16])
    if length != FOOTER or size % ALIGN or size < ALIGN:
        raise ValueError("no page ends here")
    return Page(end - size, size, kind, int.from_bytes(raw[:5], "little", signed=True), int.from_bytes(raw[5:8], "little"), namespace)


def page_records(raw: bytes) -> list[bytes]:
    """The records of a whole page."""
    n = int.from_bytes(raw[-11:-8], "little")
    offsets = struct.unpack(f"<{n + 1}I", raw[len(raw) - FOOTER - 4 * (n + 1) : len(raw) - FOOTER])
    return [raw[a:b] for a, b in zip(offsets, offsets[1:])]


def index_of(uri: str) -> dict[str, list[tuple[int, int]]]:
    """Per namespace the first ordinal and the place of each data page, ascending, from the index pages alone."""
    n = storage.size(uri)
    if n < ALIGN:
        raise ValueError(f"{uri}: too short for a store")
    with storage.open_read(uri) as f:

        def page(at: int) -> list[bytes]:
            f.seek(at)
            head = f.read(HEADER)
            if head[:4] != MAGIC:
                raise ValueError(f"{uri}: no page at {at}")
            return page_records(head + f.read(struct.unpack("<I", head[4:])[0] - HEADER))

        f.seek(n - FOOTER)
        last = parse_footer(f.read(FOOTER), n)
        if last.kind == INDEX_PAGE:
            at = {"": last.at}
        elif last.kind == NAMESPACE_PAGE:
            at = {r[2 : 2 + r[1]].decode(): struct.unpack_from("<q", r, 2 + r[1])[0] for r in page(last.at)}
        else:
            raise ValueError(f"{uri}: the store has no index at its end")
        return {ns: sorted(struct.unpack("<qq", r) for r in page(place)) for ns, place in at.items()}


@dataclass
class Store:
    """The page index of a store: per namespace its name and its data pages in order of their first ordinal."""

    uri: str
    pages: dict[str, list[Page]] = field(default_factory=dict)

    @staticmethod
    def open(uri: str) -> Store:
        """The store with what every page's footer says."""
        out, index = Store(uri), index_of(uri)
        with storage.open_read(uri) as f:

            def footer(at: int) -> Page:
                f.seek(at + 4)
                (size,) = struct.unpack("<I", f.read(4))
                f.seek(at + size - FOOTER)
                return parse_footer(f.read(FOOTER), at + size)

            for ns, entries in index.items():
                out.pages[ns] = [footer(at) for _, at in entries]
        return out

    def namespace(self, name: str | None) -> str:
        """The namespace to read: the default one needs no name as long as there is no other."""
        if name is None:
            if set(self.pages) - {""}:
                raise ValueError(f"{self.uri}: name one of the namespaces {sorted(self.pages)}")
            return ""
        if name not in self.pages:
            raise KeyError(f"{self.uri}: no namespace {name!r}")
        return name

    def get(self, ordinal: int, namespace: str = "") -> bytes | None:
        """The record, or None; an unknown namespace that was named raises."""
        if namespace not in self.pages:
            if namespace:
                raise KeyError(namespace)
            return None
        pages = self.pages[namespace]
        i = bisect_right(pages, ordinal, key=lambda p: p.first) - 1
        if i < 0 or ordinal >= pages[i].end:
            return None
        return page_records(storage.read_range(self.uri, pages[i].at, pages[i].size))[ordinal - pages[i].first]

    def get_all(self, requests: list[tuple[str, int]]) -> list[bytes | None]:
        """Records in the order of the requests, each page read once; None where there is none, unknown namespaces too."""
        wanted: dict[Page, list[int]] = {}
        for at, (ns, ordinal) in enumerate(requests):
            pages = self.pages.get(ns, [])
            i = bisect_right(pages, ordinal, key=lambda p: p.first) - 1
            if i >= 0 and ordinal < pages[i].end:
                wanted.setdefault(pages[i], []).append(at)
        out: list[bytes | None] = [None] * len(requests)
        for page, places in wanted.items():
            records = page_records(storage.read_range(self.uri, page.at, page.size))
            for at in places:
                out[at] = records[requests[at][1] - page.first]
        return out

    def count(self, namespace: str = "") -> int:
        return sum(p.records for p in self.pages.get(namespace, []))

    def next_ordinal(self, namespace: str = "") -> int:
        return max((p.end for p in self.pages.get(namespace, [])), default=0)


class Writer:
    """Writes a store to a temporary name and puts it in place on close(); ordinals ascend within a namespace."""

    def __init__(self, uri: str, page_size: int = 1 << 16):
        if page_size < ALIGN or page_size > LARGEST_PAGE:
            raise ValueError("pages hold from 512 bytes to 4 GiB")
        self.uri, self.page_size, self.out, self.at = uri, page_size, storage.open_write(uri + ".tmp"), 0
        self.numbers: dict[str, int] = {"": DEFAULT_NAMESPACE}
        self.index: dict[str, list[tuple[int, int]]] = {}
        self.held: dict[str, tuple[int, list[bytes], int]] = {}
        self.last: dict[str, int] = {}

    def write(self, ordinal: int, data: bytes, namespace: str = "") -> None:
        if not FIRST_ORDINAL <= ordinal <= LAST_ORDINAL:
            raise ValueError(f"ordinal {ordinal} is out of range")
        if namespace not in self.numbers:
            if len(namespace.encode()) > LONGEST_NAME or len(self.numbers) > 126:
                raise ValueError("too many namespaces, or too long a name")
            self.numbers[namespace] = max(self.numbers.values()) + 1
        if namespace in self.last and ordinal <= self.last[namespace]:
            raise ValueError(f"ordinal {ordinal} doesn't come after {self.last[namespace]}")
        first, records, size = self.held.get(namespace, (ordinal, [], 0))
        need = HEADER + size + len(data) + 4 * (len(records) + 2) + FOOTER
        if records and (ordinal != first + len(records) or -(-need // ALIGN) * ALIGN > self.page_size or len(records) == MOST_RECORDS):
            self._flush(namespace)
            first, records, size = ordinal, [], 0
        records.append(bytes(data))
        self.held[namespace] = (first, records, size + len(data))
        self.last[namespace] = ordinal

    def _put(self, page: bytes) -> int:
        self.out.write(page)
        self.at += len(page)
        return self.at - len(page)

    def _flush(self, namespace: str) -> None:
        first, records, _ = self.held.pop(namespace)
        at = self._put(build_page(DATA_PAGE, self.numbers[namespace], first, records))
        self.index.setdefault(namespace, []).append((first, at))

    def close(self) -> None:
        for ns in list(self.held):
            self._flush(ns)
        names = sorted(self.index, key=self.numbers.__getitem__)
        places = {ns: self._put(build_page(INDEX_PAGE, self.numbers[ns], 0, [struct.pack("<qq", *e) for e in self.index[ns]])) for ns in names}
        if not names:
            self._put(build_page(INDEX_PAGE, DEFAULT_NAMESPACE, 0, []))
        elif names != [""]:
            entries = [bytes([self.numbers[ns], len(ns.encode())]) + ns.encode() + struct.pack("<q", places[ns]) for ns in names]
            self._put(build_page(NAMESPACE_PAGE, DEFAULT_NAMESPACE, 0, entries))
        self.out.close()
        storage.replace(self.uri + ".tmp", self.uri)


def write(uri: str, rows: Iterable[tuple[str, int, bytes]], page_size: int = 1 << 16) -> None:
    w = Writer(uri, page_size)
    for ns, ordinal, data in rows:
        w.write(ordinal, data, ns)
    w.close()


def write_frame(df: DataFrame, uri: str, page_size: int = 1 << 16) -> None:
    """(namespace, ordinal, data) as one store; rows come to the writer partition by partition, sorted by Spark.

    One file has one writer: for tables beyond that, write_parts() writes a folder of stores.
    """
    rows = df.select("namespace", "ordinal", "data").orderBy("namespace", "ordinal").toLocalIterator(prefetchPartitions=True)
    write(uri, ((r[0], r[1], bytes(r[2])) for r in rows), page_size)


def write_parts(df: DataFrame, folder: str, parts: int | None = None, page_size: int = 1 << 16) -> int:
    """(namespace, ordinal, data) as a folder of stores, each task writing one of its own; returns the number of records.

    Stores take ranges of (namespace, ordinal), so that readers with bounds open few. A task's file gets its name only
    when the job is done: what failed attempts leave is no store.
    """

    def run(batches):
        from pyspark import TaskContext

        out, n = None, 0
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.slab"
        for b in batches:
            for ns, ordinal, data in zip(*(c.to_pylist() for c in b.columns)):
                out = out or Writer(uri + ".part", page_size)
                out.write(ordinal, data, ns)
                n += 1
        if out:
            out.close()
            yield pa.record_batch([pa.array([uri]), pa.array([n], pa.int64())], names=["uri", "n"])

    rows = df.select("namespace", F.col("ordinal").cast("long").alias("ordinal"), "data")
    rows = rows.repartitionByRange(parts, "namespace", "ordinal") if parts else rows.repartitionByRange("namespace", "ordinal")
    # One row for each store comes to the driver.
    done = rows.sortWithinPartitions("namespace", "ordinal").mapInArrow(run, "uri string, n long").collect()
    for r in done:
        storage.replace(r["uri"] + ".part", r["uri"])
    return sum(r["n"] for r in done)


def analyze(records: DataFrame) -> DataFrame:
    """(namespace, records, first, last, ordinals, min_bytes, avg_bytes, max_bytes, content) of (namespace, ordinal, data).

    `ordinals` says whether a namespace's ordinals follow one another (strict), leave gaps (sparse) or repeat
    (non-monotonic); `content` is json where every record is a JSON value, else text where all are valid UTF-8, else
    binary. An empty table gives no rows.
    """
    n = F.length("data")
    text = F.try_validate_utf8(F.col("data").cast("string"))
    json = F.get_json_object(text, "$").isNotNull()
    # Repeated ordinals meet in the distinct count, which is partial in each task.
    out = records.groupBy("namespace").agg(
        F.count("*").alias("records"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count_distinct("ordinal").alias("_distinct"),
        F.min(n).cast("long").alias("min_bytes"), F.avg(n).alias("avg_bytes"), F.max(n).cast("long").alias("max_bytes"),
        F.bool_and(json).alias("_json"), F.bool_and(text.isNotNull()).alias("_text"),
    )
    order = F.when(F.col("_distinct") < F.col("records"), "non-monotonic").when(F.col("last") - F.col("first") + 1 > F.col("records"), "sparse").otherwise("strict")
    kind = F.when(F.col("_json"), "json").when(F.col("_text"), "text").otherwise("binary")
    return out.select("namespace", "records", "first", "last", order.alias("ordinals"), "min_bytes", "avg_bytes", "max_bytes", kind.alias("content"))


def lookup(records: DataFrame, requests: DataFrame) -> DataFrame:
    """The record of each request (position, namespace, ordinal), or null: (position, namespace, ordinal, data)."""
    return requests.join(records, ["namespace", "ordinal"], "left").select("position", "namespace", "ordinal", "data")


def append(uri: str, records: Iterable[bytes], namespace: str = "", page_size: int = 1 << 16) -> int:
    """Records after the last ordinal of the namespace; the rest of the store is copied. Returns the first new ordinal."""
    store = Store.open(uri)
    first = store.next_ordinal(namespace)
    w = Writer(uri, page_size)
    for row in scan(store):
        w.write(row[1], row[2], row[0])
    for i, r in enumerate(records):
        w.write(first + i, r, namespace)
    w.close()
    return first


def rewrite(uri: str, target: str, namespaces: list[str] | None = None, page_size: int = 1 << 16) -> None:
    """The store packed anew: ordered, unreferenced pages gone."""
    store = Store.open(uri)
    write(target, (r for r in scan(store) if namespaces is None or r[0] in namespaces), page_size)


def scan(store: Store) -> Iterator[tuple[str, int, bytes]]:
    with storage.open_read(store.uri) as f:
        for ns, pages in store.pages.items():
            for p in pages:
                f.seek(p.at)
                for i, r in enumerate(page_records(f.read(p.size))):
                    yield ns, p.first + i, r


def check(uri: str) -> list[tuple[int, str]]:
    """(place, fault) of everything wrong: headers against footers, order, overlaps, pages against the index."""
    faults, n, at, walked = [], storage.size(uri), 0, {}
    with storage.open_read(uri) as f:
        while at < n:
            f.seek(at)
            head = f.read(HEADER)
            if len(head) < HEADER or head[:4] != MAGIC:
                faults.append((at, "no page header"))
                break
            (size,) = struct.unpack("<I", head[4:])
            if size < ALIGN or size % ALIGN or at + size > n:
                faults.append((at, f"a page size of {size}"))
                break
            raw = head + f.read(size - HEADER)
            try:
                page = parse_footer(raw[-FOOTER:], at + size)
                if page.size != size:
                    faults.append((at, "header and footer differ in size"))
                offsets = struct.unpack(f"<{page.records + 1}I", raw[size - FOOTER - 4 * (page.records + 1) : size - FOOTER])
                if offsets[0] != HEADER or any(a > b for a, b in zip(offsets, offsets[1:])) or offsets[-1] > size - FOOTER - 4 * (page.records + 1):
                    faults.append((at, "record offsets out of order"))
                if page.kind not in (INDEX_PAGE, DATA_PAGE, NAMESPACE_PAGE):
                    faults.append((at, f"a page of kind {page.kind}"))
                walked[at] = page
            except (ValueError, struct.error) as e:
                faults.append((at, str(e)))
            at += size
    try:
        store = Store.open(uri)
    except (ValueError, struct.error, IndexError) as e:
        return [*faults, (n, str(e))]
    for ns, pages in store.pages.items():
        for p in pages:
            if p.at not in walked:
                faults.append((p.at, f"namespace {ns!r}: the index names a page that a walk doesn't meet"))
        for a, b in zip(pages, pages[1:]):
            if a.end > b.first:
                faults.append((b.at, f"namespace {ns!r}: pages overlap"))
    return faults


# --- as a Spark source ---------------------------------------------------------------------------------------------


#: Partitions of one store at most: each reads the store's index, a 4,096th of it with pages of 64 KiB.
SHARES = 256


@dataclass
class _Share(InputPartition):
    """Of `shares` equal runs of each namespace's pages, the one of this number."""

    uri: str
    number: int
    shares: int


class _Reader(DataSourceReader):
    """The driver lists stores and their sizes; which pages there are is read where they are read."""

    def __init__(self, path: str, options: dict):
        self.path, self.wanted = path, options.get("namespace")
        self.lo, self.hi = int(options.get("start", FIRST_ORDINAL)), int(options.get("end", LAST_ORDINAL + 1))
        self.bytes = int(options.get("partitionbytes", 32 << 20))

    def partitions(self):
        out = []
        for uri in storage.files(self.path, (".slab",)):
            n = min(SHARES, max(1, -(-storage.size(uri) // self.bytes)))
            out += [_Share(uri, k, n) for k in range(n)]
        return out

    def read(self, share) -> Iterator[pa.RecordBatch]:
        if not isinstance(share, _Share):
            return
        with storage.open_read(share.uri) as f:
            for ns, entries in index_of(share.uri).items():
                if self.wanted is not None and ns != self.wanted:
                    continue
                # Pages that begin at or after the end, or that are followed by one at or before the start, hold none.
                firsts = [first for first, _ in entries]
                entries = entries[max(0, bisect_right(firsts, self.lo) - 1) : bisect_left(firsts, self.hi)]
                k, n = share.number, share.shares
                for _, at in entries[k * len(entries) // n : (k + 1) * len(entries) // n]:
                    f.seek(at)
                    head = f.read(HEADER)
                    raw = head + f.read(struct.unpack("<I", head[4:])[0] - HEADER)
                    page = parse_footer(raw[-FOOTER:], at + len(raw))
                    yield pa.record_batch([pa.array([ns] * page.records, pa.string()), pa.array(range(page.first, page.end), pa.int64()), pa.array(page_records(raw), pa.binary())], names=["namespace", "ordinal", "data"])


class SlabSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slab"

    def schema(self) -> str:
        return "namespace string, ordinal long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], dict(self.options))


def read(spark: SparkSession, path: str, namespace: str | None = None, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """(namespace, ordinal, data) of a namespace, or of all, with ordinals from lo up to hi; other pages aren't read."""
    spark.dataSource.register(SlabSource)
    r = spark.read.format("slab")
    for name, value in (("namespace", namespace), ("start", lo), ("end", hi)):
        if value is not None:
            r = r.option(name, value)
    df = r.load(path)
    df = df if lo is None else df.where(F.col("ordinal") >= lo)
    return df if hi is None else df.where(F.col("ordinal") < hi)


def pages_table(spark: SparkSession, uri: str) -> DataFrame:
    """(namespace, page, at, size, first, records): the index as rows."""
    rows = [(ns, i, p.at, p.size, p.first, p.records) for ns, pages in Store.open(uri).pages.items() for i, p in enumerate(pages)]
    return spark.createDataFrame(rows, "namespace string, page long, at long, size long, first long, records long")


def explain(uri: str) -> str:
    """The pages and the sizes of their records, for reading."""
    store, lines = Store.open(uri), []
    for ns, pages in store.pages.items():
        for p in pages:
            sizes = [len(r) for r in page_records(storage.read_range(uri, p.at, p.size))]
            lines.append(f"namespace {ns!r} page at {p.at}: {p.size} bytes, ordinals {p.first} to {p.end - 1}, record bytes {min(sizes, default=0)} to {max(sizes, default=0)}")
    return "\n".join(lines)


# --- import and export ---------------------------------------------------------------------------------------------


def sniff(path: str, head: bytes) -> str:
    """The import format of a file: by its extension, else cstrings where the first 8 KiB hold a NUL, else text."""
    known = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "csv": "csv", "tsv": "tsv", "yaml": "yaml", "yml": "yaml", "txt": "text", "slab": "slab"}
    return known.get(path.rpartition(".")[2].lower(), "cstrings" if b"\0" in head[:8192] else "text")


def split_records(raw: bytes, kind: str) -> list[bytes]:
    """The records of a file's bytes, delimiters kept. Invalid JSON or YAML raises with the place."""
    if kind == "cstrings":
        return _cut(raw, b"\0")
    if kind in ("text", "tsv"):
        return _cut(raw, b"\n")
    if kind == "csv":
        return _csv_records(raw)
    if kind == "jsonl":
        import json

        out, at = _cut(raw, b"\n"), 0
        for line in out:
            if line.strip():
                try:
                    json.loads(line)
                except ValueError as e:
                    raise ValueError(f"invalid JSON at byte {at}: {e}") from None
            at += len(line)
        return [x for x in out if x.strip()]
    if kind == "json":
        return _json_values(raw)
    if kind == "yaml":
        import yaml

        out = []
        for part in _yaml_documents(raw):
            try:
                yaml.safe_load(part)
            except yaml.YAMLError as e:
                raise ValueError(f"invalid YAML at byte {sum(map(len, out))}: {e}") from None
            out.append(part)
        return [x for x in out if x.strip()]
    raise ValueError(f"unknown format {kind!r}")


def _cut(raw: bytes, mark: bytes) -> list[bytes]:
    parts = raw.split(mark)
    return [p + mark for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _csv_records(raw: bytes) -> list[bytes]:
    """Lines, those inside quotes joined; a header line is a record too."""
    out, held = [], b""
    for line in _cut(raw, b"\n"):
        held += line
        if held.count(b'"') % 2 == 0:
            out.append(held)
            held = b""
    return out + ([held] if held else [])


def _json_values(raw: bytes) -> list[bytes]:
    """The elements of a JSON array, or the values that follow one another."""
    import json

    text, reader, at, out = raw.decode(), json.JSONDecoder(), 0, []
    try:
        whole = json.loads(text)
        if isinstance(whole, list):
            return [json.dumps(x, ensure_ascii=False).encode() for x in whole]
    except ValueError:
        pass
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            return out
        try:
            _, end = reader.raw_decode(text, at)
        except ValueError as e:
            raise ValueError(f"invalid JSON at byte {len(text[:at].encode())}: {e}") from None
        out.append(text[at:end].encode())
        at = end


def _yaml_documents(raw: bytes) -> list[bytes]:
    out, held = [], b""
    for line in _cut(raw, b"\n"):
        if line.startswith(b"---") and held.strip():
            out.append(held)
            held = b""
        held += line
    return out + ([held] if held else [])


def import_file(source: str, target: str, kind: str | None = None, namespace: str = "", add: bool = False, page_size: int = 1 << 16) -> int:
    """Records of a file into a store, from ordinal 0 or, with `add`, after the last one. Returns how many."""
    raw = storage.read_range(source, 0, storage.size(source))
    kind = kind or sniff(source, raw)
    if kind == "slab":
        rows = [r for _, _, r in scan(Store.open(source))]
    else:
        rows = split_records(raw, kind)
    if add:
        append(target, rows, namespace, page_size)
    else:
        write(target, ((namespace, i, r) for i, r in enumerate(rows)), page_size)
    return len(rows)


# What closes a record in the export formats that are made of records as they are.
_CLOSING = {"text": b"\n", "csv": b"\n", "tsv": b"\n", "jsonl": b"\n", "cstrings": b"\0"}


def export(df: DataFrame, kind: str = "raw") -> DataFrame:
    """(namespace, ordinal, out): records (namespace, ordinal, data) in an export format.

    raw leaves the bytes; text, csv, tsv, jsonl and cstrings end each with its mark where it isn't there; hex, base64,
    utf8 and ascii give text.
    """
    data = F.col("data")
    if kind == "raw":
        out = data
    elif kind in _CLOSING:
        mark = F.lit(_CLOSING[kind])
        out = F.when(F.endswith(data, mark), data).otherwise(F.concat(data, mark))
    elif kind in ("hex", "base64"):
        out = F.lower(F.hex(data)) if kind == "hex" else F.base64(data)
    elif kind == "utf8":
        out = F.try_validate_utf8(data.cast("string"))
    elif kind == "ascii":
        out = F.regexp_replace(data.cast("string"), r"[^\x00-\x7F]", "?")
    else:
        raise ValueError(f"unknown format {kind!r}")
    return df.select("namespace", "ordinal", out.alias("out"))
