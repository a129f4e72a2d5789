"""Exact nearest neighbours, filtered neighbours, their verification and measures drawn from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import distances
from .predicates import Node, solve

#: Base rows of one segment at most, as hashes deal them: what one task holds of them; query rows that meet it at a time;
#: pairs of one task; numbers that are held of the rows in question at a time.
SEGMENT, CHUNK, PAIRS, HELD = 65_536, 128, 1 << 27, 1 << 20


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "ordinal"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query", "rank", "ordinal", "distance")


def _rows(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; nulls and unequal lengths raise."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or column.flatten().null_count or len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors must be given, without nulls and of one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)


def _grid(n: int, m: int, segment: int = SEGMENT, pairs: int = PAIRS) -> tuple[int, int]:
    """Segments of n base rows and parts of m queries: tasks of about `pairs` pairs, and as few copies of rows as can be."""
    tasks = -(-n * m // pairs)
    segments = max(1, -(-n // segment), min(tasks, round((tasks * n / max(m, 1)) ** 0.5)))
    return segments, max(1, -(-tasks // segments))


class _Segment:
    """Base rows in memory, whose k nearest to queries are asked for a few queries at a time.

    A matrix product gives all distances but for its rounding. Rows whose distance may be among the k least, by a bound of
    that rounding and of `digits`, are scored pair by pair, so that a distance doesn't depend on where its row stands.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, name: str, k: int, digits: int | None):
        self.ids, self.rows, self.name, self.k, self.digits = ids, rows.astype(np.float64), name, k, digits
        n, d = self.rows.shape
        # The least of each of `wide` groups of rows are looked at first.
        self.fold = max(1, min(64, n // (4 * k)))
        self.wide = -(-n // self.fold)
        self.norms = np.abs(self.rows).sum(1) if name == distances.L1 else np.sqrt((self.rows**2).sum(1))
        self.error, self.far = 4 * (d + 8) * np.finfo(np.float64).eps, self.norms.max()
        self.tie = 0.0 if digits is None else 10.0**-digits
        # The last row goes with a 1 in the queries; what fills up the groups is infinitely far.
        self.sent = np.zeros((d + 1, self.fold * self.wide))
        self.sent[-1, n:] = np.inf
        if name == distances.EUCLIDEAN:
            self.sent[:-1, :n], self.sent[-1, :n] = -2 * self.rows.T, self.norms**2
        elif name == distances.COSINE:
            if not self.norms.all():
                raise ValueError("cosine of a zero vector")
            self.sent[:-1, :n] = -(self.rows / self.norms[:, None]).T
        elif name == distances.DOT_PRODUCT:
            self.sent[:-1, :n] = -self.rows.T
        self.out = np.empty((CHUNK, self.sent.shape[1]))

    def _scores(self, q: np.ndarray) -> np.ndarray:
        """What grows with the distance, for every row: for Euclidean distances their square without the query's."""
        out = self.out[: len(q)]
        if self.name == distances.L1:
            out[:, len(self.ids) :] = np.inf
            out[:, : len(self.ids)] = distances.bulk(q, self.rows, self.name)
            return out
        if self.name == distances.COSINE:
            norms = np.linalg.norm(q, axis=1)
            if not norms.all():
                raise ValueError("cosine of a zero vector")
            q = q / norms[:, None]
        return np.dot(np.c_[q, np.ones(len(q))], self.sent, out=out)

    def _reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The greatest score of a row that may be as near as one of `score`."""
        if self.name == distances.COSINE:
            return score + self.tie + 2 * self.error
        if self.name != distances.EUCLIDEAN:
            size = np.abs(q).sum(1) + self.far if self.name == distances.L1 else np.linalg.norm(q, axis=1) * self.far
            return score + self.tie + 2 * self.error * size
        square = (q**2).sum(1)
        error = self.error * (square + self.far**2)
        return (np.sqrt(np.maximum(score + square + error, 0)) + self.tie) ** 2 * (1 + self.error) - square + error

    def nearest(self, asked: np.ndarray, q: np.ndarray, but_self: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, ordinal, distance) of the k nearest to each of at most CHUNK queries."""
        q, k = q.astype(np.float64), self.k + but_self
        if q.shape[1:] != self.rows.shape[1:]:
            raise ValueError("vectors must be of one length")
        with np.errstate(invalid="ignore", over="ignore"):
            scores = self._scores(q).reshape(len(q), self.fold, self.wide)
            least = scores.min(axis=1)
            kth = np.partition(least, k - 1, axis=1)[:, k - 1] if k <= self.wide else np.full(len(q), np.inf)
            # What can't be compared is in question too.
            reach = self._reach(q, kth)[:, None]
            of, group = np.nonzero(~(least > reach))
            if len(q) > 1 and len(of) * self.fold > HELD:
                halves = (slice(0, len(q) // 2), slice(len(q) // 2, None))
                return tuple(np.concatenate(c) for c in zip(*(self.nearest(asked[h], q[h], but_self) for h in halves)))
            which, place = np.nonzero(~(scores[of, :, group] > reach[of]))
        of, at = of[which], place * self.wide + group[which]
        real = at < len(self.ids)
        if but_self:
            real[real] = self.ids[at[real]] != asked[of[real]]
        of, at = of[real], at[real]
        step = max(1, HELD // max(1, q.shape[1]))
        found = [distances.paired(q[of[i : i + step]], self.rows[at[i : i + step]], self.name) for i in range(0, len(of), step)]
        d = np.concatenate(found) if found else np.empty(0)
        d = d if self.digits is None else np.round(d, self.digits)
        order = np.lexsort((self.ids[at], d, of))
        of, at, d = of[order], at[order], d[order]
        first = np.arange(len(of)) - np.searchsorted(of, of) < self.k
        return asked[of[first]], self.ids[at[first]], d[first]


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str | None = None, digits: int | None = None, exclude_self: bool = False, segment: int = SEGMENT, by: str | None = None, pairs: int = PAIRS) -> DataFrame:
    """(query, rank, ordinal, distance) of the k nearest base rows of every query; ties to the smaller ordinal.

    base and queries: (ordinal, vector). Base rows are dealt into segments and queries into parts, by a hash of the
    ordinal; a task has one segment and one part, of about `pairs` pairs. It takes in the segment, then the queries as they
    come, a few at a time, and keeps each query's k best; only those are ranked after another shuffle. `digits` rounds
    distances before they are ranked. `by` names a column of whole numbers of both: queries meet the base rows of their own
    number. Nulls and unequal lengths raise.
    """
    name = distances.canonical(metric)
    segments, parts = _grid(base.count(), queries.count(), segment, pairs)
    vector = F.col("vector").cast("array<float>" if all(dict(df.dtypes)["vector"] == "array<float>" for df in (base, queries)) else "array<double>")
    columns = [(F.lit(0) if by is None else F.col(by)).cast("long"), F.col("ordinal").cast("long"), vector]
    dealt = lambda n: F.pmod(F.xxhash64(F.col("ordinal").cast("long")), F.lit(n)).cast("int")
    cells = F.sequence(dealt(segments) * parts, dealt(segments) * parts + (parts - 1), F.lit(1))
    left = base.select(F.explode(cells), F.lit(0), *columns)
    cells = F.sequence(dealt(parts), dealt(parts) + (segments - 1) * parts, F.lit(parts))
    both = left.union(queries.select(F.explode(cells), F.lit(1), *columns)).toDF("cell", "of", "by", "ordinal", "vector").where("by is not null")
    both = both.repartitionById(segments * parts, F.col("cell")).sortWithinPartitions("cell", "of", "by")

    def run(batches):
        cell, held, kind, rows = None, {}, None, None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]) if b.num_rows else ():
                where, of, number = keys[:, lo].tolist()
                if where != cell:
                    cell, held, kind, rows = where, {}, None, None
                ids, vectors = b.column(3).slice(lo, hi - lo).to_numpy(), _rows(b.column(4).slice(lo, hi - lo))
                if not of:
                    held.setdefault(number, []).append((ids, vectors))
                    continue
                if kind != number:
                    kind, rows = number, None
                    if number in held:
                        rows = _Segment(*(np.concatenate(x) for x in zip(*held.pop(number))), name, k, digits)
                for at in range(0, hi - lo, CHUNK) if rows else ():
                    found = rows.nearest(ids[at : at + CHUNK], vectors[at : at + CHUNK], exclude_self)
                    yield pa.record_batch([pa.array(c) for c in found], names=["query", "ordinal", "distance"])

    return _top(both.mapInArrow(run, "query long, ordinal long, distance double"), k)


def knn_expression(base: DataFrame, queries: DataFrame, k: int, metric: str | None = None, digits: int | None = None) -> DataFrame:
    """knn() whose distances are column expressions: knn() picks the rows, since expressions over all pairs take too long."""
    return filtered_knn(base, queries, knn(base, queries, k, metric, digits).select("query", "ordinal"), k, metric, digits)


def filtered_knn(base: DataFrame, queries: DataFrame, solved: DataFrame, k: int, metric: str | None = None, digits: int | None = None) -> DataFrame:
    """The k nearest among the base rows that each query's own predicate admits; solved: (query, ordinal) pairs."""
    pairs = solved.join(base.select("ordinal", "vector"), "ordinal").join(queries.select(F.col("ordinal").alias("query"), F.col("vector").alias("q_vector")), "query")
    d = distances.distance(F.col("q_vector"), F.col("vector"), metric)
    return _top(pairs.select("query", "ordinal", (d if digits is None else F.round(d, digits)).alias("distance")), k)


def shared_knn(base: DataFrame, queries: DataFrame, solved: DataFrame, own: DataFrame, k: int, metric: str | None = None, digits: int | None = None) -> DataFrame:
    """filtered_knn() where queries share predicates; solved: (query, ordinal) of each predicate's number, own: (query,
    predicate). Rows are kept once for each predicate that admits them, and no row is made of a pair."""
    left = solved.select(F.col("query").alias("predicate"), "ordinal").join(base.select("ordinal", "vector"), "ordinal")
    right = own.withColumnRenamed("query", "ordinal").join(queries.select("ordinal", "vector"), "ordinal")
    return knn(left, right, k, metric, digits, by="predicate")


def predicated_knn(base: DataFrame, queries: DataFrame, predicates: list[tuple[int, Node]], k: int, metric: str | None = None, digits: int | None = None) -> DataFrame:
    """filtered_knn() with the predicates solved over the base's own metadata columns, equal ones once."""
    # By their text: 1, 1.0 and True are equal, but not as comparands.
    nodes = {repr(node): node for _, node in predicates}
    numbers = {text: i for i, text in enumerate(nodes)}
    own = [(q, numbers[repr(node)]) for q, node in predicates]
    solved = solve(base, list(enumerate(nodes.values())))
    return shared_knn(base, queries, solved, base.sparkSession.createDataFrame(own, "query long, predicate long"), k, metric, digits)


def facets(found: DataFrame) -> DataFrame:
    """(ordinal, indices, distances): one row a query, by rank, as the neighbour facets store them."""
    rows = F.sort_array(F.collect_list(F.struct("rank", F.col("ordinal").alias("i"), "distance")))
    return found.groupBy(F.col("query").alias("ordinal")).agg(rows.alias("r")).select("ordinal", F.col("r.i").alias("indices"), F.col("r.distance").alias("distances"))


def ranked(facet: DataFrame, value: str = "indices") -> DataFrame:
    """(query, rank, value) of a neighbour facet."""
    return facet.select(F.col("ordinal").alias("query"), F.posexplode(value).alias("p", "value")).select("query", (F.col("p") + 1).alias("rank"), "value")


def max_k(facet: DataFrame, value: str = "indices") -> DataFrame:
    return facet.agg(F.max(F.size(value)).cast("int").alias("max_k"))


def truncated(facet: DataFrame, maxk: int, *values: str) -> DataFrame:
    return facet.select(*[F.slice(c, 1, maxk).alias(c) if c in (values or ("indices", "distances")) else F.col(c) for c in facet.columns])


def verify(found: DataFrame, stored: DataFrame, phi: float = 0.001, k: int | None = None) -> DataFrame:
    """Per query: how many stored distances are within `phi` of the exact one of their rank, and the recall of ordinals.

    found and stored: (query, rank, ordinal, distance). A rank that one side lacks counts as wrong.
    """
    s = stored if k is None else stored.where(F.col("rank") <= k)
    f = found if k is None else found.where(F.col("rank") <= k)
    both = f.alias("f").join(s.alias("s"), ["query", "rank"], "full")
    near = F.abs(F.col("f.distance") - F.col("s.distance")) <= phi
    ranks = both.groupBy("query").agg(F.count("*").alias("ranks"), F.sum(F.coalesce(near, F.lit(False)).cast("long")).alias("within"))
    hits = f.join(s.select("query", "ordinal"), ["query", "ordinal"], "left_semi").groupBy("query").agg(F.count("*").alias("hits"))
    return ranks.join(hits, "query", "left").select("query", "ranks", "within", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), (F.coalesce("hits", F.lit(0)) / F.col("ranks")).alias("recall"), (F.col("within") == F.col("ranks")).alias("passed"))


def verify_profiles(base: DataFrame, queries: DataFrame, sizes: dict[str, int], k: int, metric: str | None = None, digits: int | None = None) -> DataFrame:
    """Exact neighbours for several base counts: (profile, query, rank, ordinal, distance), one distance per pair.

    The profiles' rows are prefixes of one another: each slice from one size to the next is searched once by knn(), and
    a profile's neighbours are the nearest of those of its slices.
    """
    steps = sorted(sizes.items(), key=lambda x: x[1])
    found, low = None, None
    for high in sorted(set(sizes.values())):
        part = base.where(F.col("ordinal") < high) if low is None else base.where((F.col("ordinal") >= low) & (F.col("ordinal") < high))
        some = knn(part, queries, k, metric, digits).select("query", "ordinal", "distance")
        found, low = some if found is None else found.unionByName(some), high
    named = F.explode(F.array_compact(F.array(*[F.when(F.col("ordinal") < n, F.lit(name)) for name, n in steps])))
    rank = F.row_number().over(Window.partitionBy("profile", "query").orderBy("distance", "ordinal"))
    out = found.withColumn("profile", named).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return out.select("profile", "query", "rank", "ordinal", "distance")


def dereference(facet: DataFrame, base: DataFrame, value: str = "indices") -> DataFrame:
    """(query, rank, ordinal, vector): the base rows that a neighbour facet names."""
    return ranked(facet, value).withColumnRenamed("value", "ordinal").join(base.select("ordinal", "vector"), "ordinal").select("query", "rank", "ordinal", "vector")


def batch_get(requests: DataFrame, facet: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The facet's row for each request (position, ordinal), in the requests' positions; null where there is none."""
    return requests.join(facet, ordinal, "left")


def hubness(found: DataFrame) -> DataFrame:
    """(ordinal, n): how often each row is among the neighbours of others."""
    return found.groupBy("ordinal").agg(F.count("*").alias("n"))


def margin(found: DataFrame, k: int) -> DataFrame:
    """(query, margin): the distance of rank k over that of rank 1."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("distance")))
    return found.groupBy("query").agg(F.try_divide(at(k), at(1)).alias("margin"))


def local_dimensionality(found: DataFrame) -> DataFrame:
    """(query, lid): the maximum-likelihood local intrinsic dimensionality of the positive distances."""
    positive = found.where("distance > 0")
    far = positive.groupBy("query").agg(F.max("distance").alias("far"))
    return positive.join(far, "query").groupBy("query").agg((-1 / F.avg(F.when(F.col("distance") < F.col("far"), F.ln(F.col("distance") / F.col("far"))))).alias("lid"))


def vector_order(*columns: str) -> list[Column]:
    """Sort keys for vectors: by components, and of a vector and its own beginning the longer first."""
    out: list[Column] = []
    for c in columns:
        # A null after the last component sorts behind every number.
        out += [F.concat(F.transform(c, lambda x: F.struct(F.lit(0).alias("end"), x.cast("double").alias("x"))), F.array(F.struct(F.lit(1).alias("end"), F.lit(0.0).alias("x")))).asc()]
    return out
