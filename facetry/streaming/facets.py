"""Facets as streams: an append-only folder of Parquet parts, filtered and measured row by row.

All operators here are stateless, so that no watermark is needed and any output mode will do.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import distances
from ..operators.predicates import Node, compile_predicate, solve
from ..operators.tags import TagFilter


def read(spark: SparkSession, folder: str, schema: T.StructType | str, files: int = 100) -> DataFrame:
    """Rows of the Parquet files that arrive in a folder, at most `files` files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def where(stream: DataFrame, node: Node) -> DataFrame:
    return stream.where(compile_predicate(node, stream.schema))


def solved(stream: DataFrame, predicates: Iterable[tuple[int, Node]], ordinal: str = "ordinal") -> DataFrame:
    """(query, ordinal) of every arriving record that meets a predicate."""
    return solve(stream, predicates, ordinal)


def tagged(stream: DataFrame, spec: str, tags: str = "tags") -> DataFrame:
    return stream.where(TagFilter.parse(spec).column(F.col(tags)))


def measured(stream: DataFrame, vector: list[float], metric: str | None = None, value: str = "vector") -> DataFrame:
    """Each arriving vector's distance from a given one."""
    return stream.withColumn("distance", distances.distance(F.col(value), F.array(*[F.lit(float(x)) for x in vector]), metric))


def append(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to another folder, each row once, and stop."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
