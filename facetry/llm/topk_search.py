"""Exact top-k inner products (operator 10) by block-at-a-time pruning.

The rows of a segment are ordered so that alike ones are neighbours, and numbered in that order; a block is a range of
those numbers. It keeps, for each dimension (a term), its largest and smallest value; a query's bound for a block is the
sum of the larger product over its terms. Each query takes the blocks in descending order of bounds and scores whole
blocks through their forward index, the rows' values, until the next bound is below its k-th score, which starts at the
k-th score of a sample of rows. Every score at or above the k-th is found: the result is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ._segments import SEGMENT, answered, best_of, prepared, usable

BLOCK = 32
SCALE = 1024


def alike(rows: np.ndarray, size: int) -> list[np.ndarray]:
    """The numbers of `rows` in blocks of at most `size`, halved again and again across the direction of most spread."""
    blocks, todo = [], [np.arange(len(rows))]
    start = np.random.default_rng(1).standard_normal(rows.shape[1])
    while todo:
        at = todo.pop()
        if len(at) <= size:
            blocks.append(at)
            continue
        centred = rows[at] - rows[at].mean(0)
        way = start
        for _ in range(4):
            way = centred.T @ (centred @ way)
            length = np.sqrt(way @ way)
            way = way / length if length > 0 else start
        half = -(-(len(at) // 2) // size) * size if len(at) > 2 * size else size
        order = np.argsort(centred @ way, kind="stable")
        todo += [at[order[half:]], at[order[:half]]]
    return blocks


class Blocks:
    """A segment's blocks with their bounds and forward indexes; integers, in doubles where sums are exact in those."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK):
        order = alike(rows, block)
        # All blocks but one are full; that one is filled up with rows that are never answered.
        at = np.concatenate([np.r_[b, np.repeat(b[:1], block - len(b))] for b in order])
        self.live = np.concatenate([np.arange(block) < len(b) for b in order]).reshape(-1, block)
        self.k, self.ids, self.rows = k, ids[at].reshape(-1, block), rows[at].reshape(-1, block, rows.shape[1])
        self.high, self.low = self.rows.max(1), self.rows.min(1)
        self.most = float(np.abs(rows).max(initial=0)) * rows.shape[1]
        self.scored = self.passed = 0

    def search(self, qids: np.ndarray, queries: np.ndarray, floors: np.ndarray):
        """(query, id, score) arrays of the k best rows for each query whose score reaches the query's floor."""
        most = self.most * float(np.abs(queries).max(initial=0))
        if most >= 2.0**63:
            raise OverflowError("scores of these vectors don't fit 64 bits")
        kind = np.float64 if most < 2.0**53 else object
        whole = (lambda x: x) if kind is np.float64 else np.vectorize(int, otypes=[object])
        rows, high, low, queries = whole(self.rows), whole(self.high), whole(self.low), whole(queries)
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        out = []
        for q, vector, bound, floor in zip(qids, queries, bounds, floors):
            best_ids, best = np.empty(0, np.int64), np.empty(0, kind)
            order = np.argsort(-bound, kind="stable")
            done, step = 0, 4
            while done < len(order):
                least = max(floor, best[-1]) if len(best) == self.k else floor
                turn = order[done : done + step]
                # Bounds descend: what is left of a turn after the first below the threshold needs no score.
                live = turn[(bound[turn] >= least).astype(bool)]
                if not len(live):
                    break
                done, step = done + len(turn), 2 * step
                self.scored += len(live)
                got, of = rows[live] @ vector, self.ids[live]
                use = self.live[live] & (of != q) & (got >= least).astype(bool)
                if use.any():
                    best_ids, best = np.r_[best_ids, of[use]], np.r_[best, got[use]]
                    if kind is object:
                        top = sorted(range(len(best)), key=lambda i: (-best[i], best_ids[i]))[: self.k]
                        best_ids, best = best_ids[top], best[top]
                    else:
                        best_ids, best = best_of(best_ids, best, self.k)
            self.passed += len(order)
            out.append((np.full(len(best), q, np.int64), best_ids, best.astype(np.int64)))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3


def top_k(vectors: DataFrame, query_filter, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets `query_filter` the k rows of highest integer inner product.

    A component x counts as floor(scale * x). Rows with a null id or vector, an empty vector, or a null or non-finite
    component take no part; ties go to the smaller id; of repeated rows of one id each is a candidate of its own, and of
    repeated queries the one of the least vector answers. Where lengths differ, missing components count as 0. Scores
    that may not fit 64 bits raise. Other columns are not read. An empty table gives no rows.
    """
    base, queries = prepared(vectors.where(vectors[id_col].isNotNull() & usable(vectors[vector_col])), query_filter, id_col, vector_col)

    def score(rows, asked):
        # Only a floor: below 2^53 exact, beyond rounded down by more than sums in double precision are off.
        got = np.floor(scale * rows) @ np.floor(scale * asked).T
        most = float(np.abs(rows).max(initial=0) + 1) * float(np.abs(asked).max(initial=0) + 1) * scale * scale * rows.shape[1]
        return got if most < 2.0**53 else got - most * 1e-9

    def index(ids, rows, k):
        blocks = Blocks(ids, np.floor(scale * rows), k, block)
        return lambda qids, asked, floors: blocks.search(qids, np.floor(scale * asked), floors)

    return answered(base, queries, k, score, index, segment, "long")
