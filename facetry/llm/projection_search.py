"""Approximate nearest neighbours (operator 1): stable random projections in a kd-tree, and a chi-square stopping test.

Unit vectors are projected to a few Gaussian directions. For a true squared distance d², the squared projected distance
over d² is chi-square with as many degrees of freedom as directions. A query descends the tree best-first, takes rows in
the order of their projected distance and verifies them on the original vectors. It stops at the first row so far away
in projection that, with the given confidence, a row at the present k-th distance would have come before it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._segments import SEGMENT, answered, best_of, prepared, usable

DIRECTIONS, LEAF, CONFIDENCE, SEED = 24, 64, 0.9, 20240601
#: Rows that are verified between two looks at the stopping test.
TURN = 128
#: Squared distances that rounding may add: equal rows lie in several leaves, and all of those are visited.
ROUNDING = 1e-9


def chi_square_quantile(confidence: float, degrees: int) -> float:
    """x at which the chi-square distribution of an even number of degrees reaches `confidence`."""
    if degrees % 2:
        raise ValueError("an even number of directions is needed")
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
    lo, hi = 0.0, 1.0
    while below(hi) < confidence:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < confidence else (lo, mid)
    return hi


def directions(dims: int, m: int = DIRECTIONS, seed: int = SEED) -> np.ndarray:
    """The Gaussian (2-stable) directions, the same in every task."""
    return np.random.default_rng([seed, m]).standard_normal((dims, m))


class KdTree:
    """Points halved at the median of the widest side down to leaves; every node has the box of its points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.rows, low, high = np.arange(len(points)), [], []
        # Per node: first and last place in `rows`, and the number of the first of its two children, or 0.
        self.span, self.child = [(0, len(points))], [0]
        for node, (a, b) in enumerate(self.span):
            at = self.rows[a:b]
            inside = points[at]
            low.append(inside.min(0))
            high.append(inside.max(0))
            if b - a > leaf:
                half = (b - a) // 2
                self.rows[a:b] = at[np.argpartition(inside[:, int((high[-1] - low[-1]).argmax())], half)]
                self.child[node] = len(self.span)
                self.span += [(a, a + half), (a + half, b)]
                self.child += [0, 0]
        self.points = points[self.rows]
        self.low, self.high = np.array(low), np.array(high)

    def nearing(self, q: np.ndarray, turn: int = TURN):
        """Batches of (squared distances ascending, places in `rows`) of the points in the order of their distance to q.

        send() a squared distance beyond which nothing is wanted any more.
        """
        far = (np.maximum(np.maximum(self.low - q, q - self.high), 0) ** 2).sum(1).tolist()
        heap, limit = [(far[0], 0)], math.inf
        held, places = np.empty(0), np.empty(0, np.int64)
        while heap or len(held):
            # Down the tree for as many points again as are in hand, so that sorting them stays cheap.
            fresh, count = [], 0
            while heap and heap[0][0] <= limit and count < max(turn, len(held)):
                _, node = heapq.heappop(heap)
                child = self.child[node]
                if child:
                    heapq.heappush(heap, (far[child], child))
                    heapq.heappush(heap, (far[child + 1], child + 1))
                else:
                    a, b = self.span[node]
                    fresh.append((a, b))
                    count += b - a
            if fresh:
                new = np.concatenate([np.arange(a, b) for a, b in fresh])
                held, places = np.r_[held, ((self.points[new] - q) ** 2).sum(1)], np.r_[places, new]
                order = held.argsort(kind="stable")
                held, places = held[order], places[order]
            next_ = min(heap[0][0] if heap else math.inf, limit)
            ready = int(np.searchsorted(held, next_, "right"))
            for s in range(0, ready, turn):
                limit = yield held[s : min(ready, s + turn)], places[s : min(ready, s + turn)]
                if held[min(ready, s + turn) - 1] > limit:
                    return
            held, places = held[ready:], places[ready:]
            if not heap or heap[0][0] > limit:
                if not len(held) or held[0] > limit:
                    return


class Index:
    """A segment's unit vectors in projection, and the vectors themselves."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, confidence: float = CONFIDENCE, m: int = DIRECTIONS, leaf: int = LEAF):
        self.net = directions(rows.shape[1], m)
        norms = np.sqrt((rows * rows).sum(1))
        self.tree = KdTree((rows / norms[:, None]) @ self.net, leaf)
        at = self.tree.rows
        self.k, self.ids, self.rows, self.norms = k, ids[at], rows[at], norms[at]
        self.stop = chi_square_quantile(confidence, m)
        self.verified = self.passed = 0

    def search(self, qids: np.ndarray, queries: np.ndarray, floors: np.ndarray):
        """(query, id, cosine) arrays of the k nearest found for each query, its own id left out; double precision.

        A floor is a cosine that k rows of the whole table reach: what is below it isn't returned.
        """
        out = []
        for q, vector, floor in zip(qids, queries, floors):
            length = math.sqrt(float((vector * vector).sum()))
            best_ids, best = np.empty(0, np.int64), np.empty(0)
            least = max(floor, -1.0) - ROUNDING
            walk = self.tree.nearing(vector / length @ self.net)
            batch = next(walk)
            while True:
                at = batch[1]
                self.verified += len(at)
                # Summed row by row: a matrix product rounds equal rows differently by their place in it.
                got, of = (self.rows[at] * vector).sum(1) / (self.norms[at] * length), self.ids[at]
                use = (of != q) & (got >= least)
                if use.any():
                    best_ids, best = best_of(np.r_[best_ids, of[use]], np.r_[best, got[use]], self.k)
                    if len(best) == self.k:
                        least = max(least, best[-1])
                # Squared distance of unit vectors at cosine c: 2 - 2c.
                try:
                    batch = walk.send(self.stop * max(0.0, 2 - 2 * least) + ROUNDING)
                except StopIteration:
                    break
            self.passed += len(self.ids)
            out.append((np.full(len(best), q, np.int64), best_ids, best))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]


def nearest(vectors: DataFrame, query_filter, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE, segment: int = SEGMENT) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets `query_filter` the k rows of largest cosine found.

    Every row is indexed, in segments of bounded size that all queries visit. Rows with a null id, or whose vector is
    null, empty, zero, or holds a null or non-finite component, take no part. Ties go to the smaller id; of several
    queries of one id the one of the least vector answers, and each row of a repeated id is a candidate of its own. Where
    lengths differ, missing components count as 0. With k rows or fewer besides the query all are returned. Other
    columns are not read. An empty table gives no rows.
    """
    rows = vectors.where(vectors[id_col].isNotNull() & usable(vectors[vector_col]) & F.exists(vectors[vector_col], lambda x: x != 0))
    base, queries = prepared(rows, query_filter, id_col, vector_col)

    def score(rows, asked):
        return (rows / np.linalg.norm(rows, axis=1)[:, None]) @ (asked / np.linalg.norm(asked, axis=1)[:, None]).T

    return answered(base, queries, k, score, lambda ids, rows, k: Index(ids, rows, k, confidence).search, segment, "double")
