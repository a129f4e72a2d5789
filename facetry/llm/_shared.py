"""Shared folder, written intermediates and small helpers for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file: in `folder`, else where the installed package has it."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a single machine one of our own where that
    is unset. On a cluster a machine's own folder would not do: there it must be set."""
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
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/facetry/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._facetry_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables of written() that no later plan reads, and let Spark's cleaner drop unreferenced shuffles."""
    for df in frames:
        path = getattr(df, "_facetry_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def sweep(spark: SparkSession) -> None:
    """Let shuffle files of finished stages leave the disks before the next stage writes its own.

    Spark removes them once its driver has collected their plans. The scheduler keeps its last job in hand, so a job of
    one row takes that place first.
    """
    gc.collect()
    spark.range(1).collect()
    spark._jvm.System.gc()


def small(batches, rows: int = 1024):
    """Arrow batches in slices of at most `rows` rows, so that what a worker holds of long texts as objects stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


_kept: dict = {}


def kept(key, make=lambda: True):
    """What this worker process keeps under `key` from one task to the next, made at its first use.

    A worker outlives its tasks and may come to serve several operators. Each names its key at the start of a task, and
    what another operator has kept goes, so that their bounds don't add up.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
        try:
            # Freed blocks go back to the system where the C library can do that.
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass
        _kept[key] = make()
    return _kept[key]


class Memo:
    """Values of strings, in two generations of about `most` bytes each: what is used stays, what isn't used for a
    generation goes. Strings of over LONGEST characters are computed each time.

    `compute` gives the values of a list of strings; an entry is taken to hold `each` bytes and 6 for each character.
    lookup() is for the strings of a bounded part of the input.
    """

    LONGEST = 64
    PART = 1 << 15

    def __init__(self, compute, most: int = 96 << 20, each: int = 180):
        self.compute, self.most, self.each = compute, most, each
        self.new, self.old, self.bytes, self.passing = {}, {}, 0, []

    def lookup(self, lists) -> dict:
        """A table that has all strings of the lists, until the next call."""
        self._turn()
        fresh = self.unknown(set().union(*lists))
        if fresh:
            self.hold(dict(zip(fresh, self.compute(fresh))))
        return self.new

    def values(self, keys: list) -> list:
        """The values, none of them None, of distinct strings: one search of a key that the new generation has. Generations
        end within long lists, too."""
        out = []
        for at in range(0, len(keys), self.PART):
            out += self._values(keys[at : at + self.PART])
        return out

    def _values(self, keys: list) -> list:
        self._turn()
        out, old, held, fresh = list(map(self.new.get, keys)), self.old.get, {}, []
        for i, v in enumerate(out):
            if v is None:
                v = old(keys[i])
                if v is None:
                    fresh.append(i)
                else:
                    held[keys[i]] = out[i] = v
        if fresh:
            for i, v in zip(fresh, self.compute([keys[i] for i in fresh])):
                held[keys[i]] = out[i] = v
        self.hold(held)
        return out

    def _turn(self) -> None:
        """What only passed through goes, and a full generation becomes the old one."""
        for k in self.passing:
            self.new.pop(k, None)
        self.passing = []
        if self.bytes > self.most:
            self.old, self.new, self.bytes = self.new, {}, 0

    def unknown(self, keys: set) -> list:
        """Those of `keys` that are in neither generation; what the old one has comes to the new one."""
        missing = keys.difference(self.new)
        again = self.old.keys() & missing
        if again:
            self.hold({k: self.old[k] for k in again})
            missing -= again
        return list(missing)

    def hold(self, entries: dict) -> None:
        self.new.update(entries)
        self.passing += [k for k in entries if len(k) > self.LONGEST]
        self.bytes += self.each * len(entries) + 6 * sum(map(len, entries))


def slices(lengths, most: int):
    """Index ranges whose summed lengths are at most `most` (or that hold one element)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
