"""Files by path or URI: byte ranges, sizes and listings, on local disks, on stores that pyarrow knows, and, for reading,
over HTTP by range requests."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from urllib.parse import urlparse
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; on a single machine, where that is unset,
    in one of our own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            root = known.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="facetry-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/facetry/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared store, read again: what depends on a task's own order or number is fixed."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _local(uri: str) -> str | None:
    at = urlparse(uri)
    return at.path if at.scheme == "file" else uri if at.scheme == "" else None


#: Seconds that a request may take, and how often it is tried.
TIMEOUT, TRIES = 60, 3


def _remote(uri: str) -> bool:
    return urlparse(uri).scheme in ("http", "https")


def _asked(uri: str, first: int, last: int):
    """(bytes first to last, length of the whole); what a server says about a range it doesn't have is empty."""
    for left in range(TRIES - 1, -1, -1):
        try:
            with urlopen(Request(uri, headers={"Range": f"bytes={first}-{last}"}), timeout=TIMEOUT) as r:
                span = re.fullmatch(r"bytes (\d+)-(\d+)/(\d+)", r.headers.get("Content-Range", ""))
                data = r.read()
                if r.status == 206 and span:
                    return data, int(span[3])
                # A server without ranges sends everything.
                return data[first : last + 1], len(data)
        except OSError as e:
            if getattr(e, "code", None) == 416:
                whole = re.fullmatch(r"bytes \*/(\d+)", e.headers.get("Content-Range", ""))
                return b"", int(whole[1]) if whole else 0
            if getattr(e, "code", None) in (401, 403, 404) or not left:
                raise
    raise OSError(uri)


class _Http:
    """A file over HTTP: read() asks for the range from the present place on."""

    def __init__(self, uri: str):
        self.uri, self.at, self.length = uri, 0, size(uri)

    def seek(self, place: int, whence: int = 0) -> int:
        self.at = max(0, place + (0, self.at, self.length)[whence])
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        end = self.length if n is None or n < 0 else min(self.length, self.at + n)
        if end <= self.at:
            return b""
        data, _ = _asked(self.uri, self.at, end - 1)
        self.at += len(data)
        return data

    def close(self) -> None:
        pass

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        pass


def open_read(uri: str):
    path = _local(uri)
    if path is not None:
        return open(path, "rb")
    if _remote(uri):
        return _Http(uri)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def open_write(uri: str):
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path)


def size(uri: str) -> int:
    path = _local(uri)
    if path is not None:
        return os.path.getsize(path)
    if _remote(uri):
        return _asked(uri, 0, 0)[1]
    with open_read(uri) as f:
        return f.size()


def read_range(uri: str, offset: int, length: int) -> bytes:
    """`length` bytes from `offset`; fewer where the file ends."""
    if _remote(uri):
        return _asked(uri, offset, offset + length - 1)[0] if length > 0 else b""
    with open_read(uri) as f:
        f.seek(offset)
        return f.read(length)


def files(uri: str, suffixes: tuple[str, ...] = ()) -> list[str]:
    """The file, or the files below a folder in order of their names; over HTTP only the file."""
    if _remote(uri):
        return [uri]
    path = _local(uri)
    if path is not None:
        if not os.path.isdir(path):
            return [uri]
        found = [os.path.join(d, n) for d, _, names in os.walk(path) for n in names if not n.startswith((".", "_"))]
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        info = store.get_file_info(inner)
        if info.type != fs.FileType.Directory:
            return [uri]
        scheme = uri[: uri.index(inner)] if inner in uri else ""
        found = [scheme + f.path for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
    return sorted(f for f in found if not suffixes or f.endswith(suffixes))


def replace(source: str, target: str) -> None:
    """Put a finished file in its place in one step."""
    a, b = _local(source), _local(target)
    if a is not None and b is not None:
        os.replace(a, b)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(target)
    store.move(fs.FileSystem.from_uri(source)[1], inner)
