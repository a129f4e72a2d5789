"""A stated set of queries against all rows, for the vector searches (operators 1 and 10).

Rows are dealt round robin into segments of bounded size, whatever ids or vectors they have. A task receives a segment's
rows first and indexes them, then the queries, a batch at a time: neither grows with the table. Every query visits every
segment, and brings along its k-th score among a bounded sample of rows, which no segment's answers need to go below.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import kept, small

#: Rows of a segment, about; and of the sample for first thresholds, at most.
SEGMENT, SAMPLE = 8_192, 2_048


def usable(column):
    """An array column without null or non-finite components."""
    return column.isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column as rows of a matrix; components beyond a vector's end count as 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - (np.cumsum(sizes) - sizes)[row]] = values
    return out


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties to the smaller id."""
    if len(ids) > k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[near], scores[near]
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top]


def sampled(base: DataFrame, n: int, most: int = SAMPLE) -> pd.DataFrame:
    """At most `most` of the n rows (id, vector), those of the least hashes; only rows below a threshold are ordered."""
    draw = F.shiftrightunsigned(F.xxhash64("id", "vector"), 24).cast("double") / float(1 << 40)
    some = base.withColumn("draw", draw).where(F.col("draw") < 4 * most / max(1, n))
    return some.orderBy("draw", "id").limit(most).select("id", "vector").toPandas()


def answered(base: DataFrame, queries: DataFrame, k: int, score: Callable, index: Callable, segment: int, kind: str) -> DataFrame:
    """(query_id, rank, vec_id, score `kind`): for each query the k best rows that the segments' indexes give.

    base, queries: (id long, vector array<double>), without nulls; queries have distinct ids. score(rows, queries) is the
    matrix of scores; index(ids, rows, k) is called once a segment and gives a function of (ids, vectors, floors) of a
    batch of queries, whose result are arrays (query, id, score) without the queries' own ids.
    """
    spark = base.sparkSession
    n, dims = base.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    segments = max(1, -(-n // segment))
    sample = sampled(base, n)
    known = np.zeros((len(sample), dims))
    for i, v in enumerate(sample["vector"]):
        known[i, : len(v)] = v
    shared = spark.sparkContext.broadcast((sample["id"].to_numpy(np.int64), known))

    def floored(batches):
        kept("search")
        ids, rows = shared.value
        for b in small(batches, 256):
            own, vectors = b.column(0).to_numpy(), matrix(b.column(1), dims)
            floors = np.full(len(own), -np.inf)
            if len(ids) > k:
                s = np.where(ids[None, :] == own[:, None], -np.inf, score(rows, vectors).T)
                floors = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
            yield pa.record_batch([*b.columns, pa.array(floors, pa.float64())], names=["id", "vector", "floor"])

    def search(batches):
        kept("search")
        at, ids, rows, ready = None, [], [], None
        for b in small(batches, 512):
            where, of = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((where[1:] != where[:-1]) | (of[1:] != of[:-1])) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(where)]):
                part = b.slice(lo, hi - lo)
                if where[lo] != at:
                    at, ids, rows, ready = where[lo], [], [], None
                if not of[lo]:
                    ids.append(part.column(2).to_numpy())
                    rows.append(matrix(part.column(3), dims))
                elif ids:
                    if ready is None:
                        ready = index(np.concatenate(ids), np.concatenate(rows), k)
                        rows = []
                    found = ready(part.column(2).to_numpy(), matrix(part.column(3), dims), part.column(4).to_numpy())
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), out))], names=["query_id", "vec_id", "score"])

    out = pa.int64() if kind == "long" else pa.float64()
    left = base.select(F.pmod(F.monotonically_increasing_id(), F.lit(segments)).cast("int").alias("segment"), F.lit(0).alias("of"), "id", "vector", F.lit(None).cast("double").alias("floor"))
    right = queries.mapInArrow(floored, "id long, vector array<double>, floor double").select(F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"), F.lit(1).alias("of"), "id", "vector", "floor")
    both = left.union(right).repartition(segments, "segment").sortWithinPartitions("segment", "of")
    found = both.mapInArrow(search, f"query_id long, vec_id long, score {kind}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def prepared(rows: DataFrame, query_filter, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, vector) of all rows, and of those that meet `query_filter`: of several rows of one id, the least vector."""
    pick = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")]
    return rows.select(pick), rows.where(query_filter).select(pick).groupBy("id").agg(F.min("vector").alias("vector"))
