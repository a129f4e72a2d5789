"""Predicate stores in SQLite files: tables of (ordinal, data), read through Spark and written on the driver."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The tables of a predicate store.
TABLES = ("predicates", "result_indices", "metadata_layout", "metadata_content")
ROWS = 50_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


def _checked(table: str) -> str:
    if not table.replace("_", "").isalnum():
        raise ValueError(f"no table name: {table!r}")
    return table


@dataclass
class _Range(InputPartition):
    lo: int
    hi: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, _checked(table)

    def partitions(self):
        with _open(self.path) as db:
            lo, hi = db.execute(f"select min(ordinal), max(ordinal) from {self.table}").fetchone()
        return [] if lo is None else [_Range(a, min(a + ROWS, hi + 1)) for a in range(lo, hi + 1, ROWS)]

    def read(self, p) -> Iterator[pa.RecordBatch]:
        if isinstance(p, _Range):
            with _open(self.path) as db:
                found = db.execute(f"select ordinal, data from {self.table} where ordinal >= ? and ordinal < ? order by ordinal", (p.lo, p.hi))
                while rows := found.fetchmany(4096):
                    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["ordinal", "data"])


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_facet"

    def schema(self) -> str:
        return "ordinal long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"])


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(ordinal, data) of a table; the file must be where the executors can open it."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_facet").option("table", table).load(path)


def write(path: str, table: str, rows: Iterable[tuple[int, bytes]]) -> None:
    """Rows into a table; the last of an ordinal stays."""
    with sqlite3.connect(path.removeprefix("file://")) as db:
        db.execute(f"create table if not exists {_checked(table)} (ordinal integer primary key, data blob not null)")
        db.executemany(f"insert or replace into {table} values (?, ?)", rows)
