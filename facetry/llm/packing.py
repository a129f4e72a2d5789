"""Packing (operator 6) as a cutting-stock problem solved by column generation.

A document's ids are cut into full sequences and one remainder. The histogram of remainder lengths has at most as many
classes as a sequence has ids, whatever the number of documents: a linear program over filling patterns is solved on
it, new patterns being priced by an unbounded knapsack. Patterns are rounded down, what is left is filled first-fit,
and the patterns are dealt to the documents by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_bpe
from ._shared import tokenizer_path, written

CAPACITY = 1024
#: Documents whose ranks one task gives, about.
RANK_GROUP = 50_000
#: Of so many classes of lengths, rounding is held to lose one sequence at least.
ROUNDING = 100


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best sum of value[l - 1] over multisets of lengths l that sum to at most `capacity`, and the multiset's counts."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        got = value[:c] + best[c - 1 :: -1][:c]
        k = int(got.argmax())
        if got[k] > best[c - 1] + 1e-12:
            best[c], last[c] = got[k], k + 1
        else:
            best[c], last[c] = best[c - 1], 0
    counts, c = np.zeros(len(value), np.int64), capacity
    while c > 0:
        if last[c]:
            counts[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def first_fit(need: dict[int, int], capacity: int) -> Counter:
    """Patterns (sorted tuples of lengths) that hold all of `need`, longest lengths first, by counts of equal bins."""
    left = {k: v for k, v in need.items() if v}
    out: Counter = Counter()
    while left:
        pattern, room, times = [], capacity, None
        for k in sorted(left, reverse=True):
            n = min(room // k, left[k])
            if n:
                pattern += [k] * n
                room -= n * k
        times = min(left[k] // n for k, n in Counter(pattern).items())
        out[tuple(pattern)] += times
        for k, n in Counter(pattern).items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def cutting_stock(need: dict[int, int], capacity: int = CAPACITY, gap: float = 0.002, rounds: int = 1500) -> Counter:
    """Patterns with their counts that hold exactly `need` (length: how many).

    Column generation ends when the bound z / (best price) is within `gap` of the program's value z, or within what
    rounding its patterns loses anyway, or after `rounds` columns; each only decides how little is padded.
    """
    need = {int(k): int(v) for k, v in need.items() if v}
    if not need:
        return Counter()
    if min(need) < 1 or max(need) > capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    lengths = np.array(sorted(need))
    m, b = len(lengths), np.array([need[k] for k in sorted(need)], float)
    columns = [np.zeros(m) for _ in range(m)]
    for i, k in enumerate(lengths):
        columns[i][i] = capacity // k
    inverse = np.diag([1 / columns[i][i] for i in range(m)])
    x = inverse @ b

    def enter(a: np.ndarray) -> None:
        nonlocal x, inverse
        if inverse.sum(0) @ a <= 1 + 1e-9:
            return
        w = inverse @ a
        ratio = np.where(w > 1e-9, x / np.where(w > 1e-9, w, 1), np.inf)
        r = int(ratio.argmin())
        t = ratio[r]
        x = np.maximum(x - t * w, 0)
        x[r] = t
        row = inverse[r] / w[r]
        inverse -= np.outer(w, row)
        inverse[r] = row
        columns[r] = a

    at = {k: i for i, k in enumerate(lengths.tolist())}
    for pattern in first_fit(need, capacity):
        a = np.zeros(m)
        for k in pattern:
            a[at[k]] += 1
        enter(a)
    value = np.zeros(int(lengths[-1]))
    for _ in range(rounds):
        price = inverse.sum(0)
        value[lengths - 1] = price
        best, counts = knapsack(np.r_[value, np.zeros(capacity - len(value))], capacity)
        z = x.sum()
        if z - z / best <= max(gap * z, m / ROUNDING):
            break
        enter(counts[lengths - 1].astype(float))
    out: Counter = Counter()
    left = dict(need)
    for i in np.argsort(-x, kind="stable"):
        pattern = [k for k, n in zip(lengths.tolist(), columns[i].astype(int)) for _ in range(n)]
        each = Counter(pattern)
        times = min([int(x[i] + 1e-6), *(left[k] // n for k, n in each.items())])
        if times:
            out[tuple(sorted(pattern, reverse=True))] += times
            for k, n in each.items():
                left[k] -= n * times
    return out + first_fit(left, capacity)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids cut into pieces: (doc_id, start, length, ids_crc32, doc_tokens).

    All pieces but the last are full. A null or empty text has the end id alone. Repeated and null ids are kept as rows
    of their own; other columns are not read.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches):
        model = byte_bpe.load(path)
        for batch in batches:
            out = [[] for _ in schema]
            for d, ids in zip(batch.column(0).to_pylist(), model.ids(batch.column(1))):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    for column, v in zip(out, (d, s, len(part) // 4, zlib.crc32(part), n)):
                        column.append(v)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def assign(parts: DataFrame, capacity: int = CAPACITY, gap: float = 0.002) -> DataFrame:
    """`parts` (rows with doc_id, start and a length of 1 to `capacity`) with sequence_id and offset.

    The plan made on the driver depends on the histogram of lengths alone: at most `capacity` classes. Ranks are given
    in groups of a length and a hash of the document, so that a length that many documents share is ranked in parallel.
    """
    spark = parts.sparkSession
    n = parts.count()
    groups = max(1, -(-n // RANK_GROUP))
    parts = parts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)).cast("int"))
    counts = parts.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(counts.withColumn("_before", F.coalesce(before, F.lit(0))).select("length", "_group", "_n", "_before"), "pack-counts")
    need = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows, sequence, used = [], 0, Counter()
    for pattern, times in sorted(cutting_stock(need, capacity, gap).items(), reverse=True):
        place = 0
        for k, a in sorted(Counter(pattern).items(), reverse=True):
            rows.append((k, used[k], used[k] + a * times, a, place, sequence))
            used[k] += a * times
            place += a * k
        sequence += times
    plan = spark.createDataFrame(rows, "_length long, _from long, _to long, _each long, _place long, _sequence long")
    local = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "start", "ids_crc32"))
    ranked = parts.withColumn("_local", local - 1).join(F.broadcast(counts.drop("_n")) if groups <= 64 else counts.drop("_n"), ["length", "_group"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_local"))
    # The plan's rows are bounded by the capacity: a basis of patterns and one first-fit of what rounding left.
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    k = F.col("_rank") - F.col("_from")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.floor(k / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_place") + F.pmod(k, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document lies: pieces() placed by assign(). An empty table gives no rows."""
    return assign(written(pieces(docs, id_col, text_col, vocabulary, end_id, capacity), "pack-pieces"), capacity)
