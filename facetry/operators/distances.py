"""Distances between vectors, as columns and in bulk."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of distance functions; a smaller value is nearer for all of them.
EUCLIDEAN, L1, DOT_PRODUCT, COSINE = "EUCLIDEAN", "L1", "DOT_PRODUCT", "COSINE"
_NAMES = {"EUCLIDEAN": EUCLIDEAN, "L2": EUCLIDEAN, "L1": L1, "DOT_PRODUCT": DOT_PRODUCT, "COSINE": COSINE}


def canonical(name: str | None) -> str:
    """The function of a name, COSINE where none is given; an unknown name raises."""
    if name is None:
        return COSINE
    try:
        return _NAMES[name.strip().upper()]
    except KeyError:
        raise ValueError(f"unknown distance function {name!r}") from None


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _paired(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f))


def dot(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a.cast("array<double>"), lambda x: x * x)))


def distance(a: Column, b: Column, name: str | None = None) -> Column:
    """The distance in double precision.

    A null vector or unequal lengths raise when the row is evaluated, as does a zero vector under COSINE.
    DOT_PRODUCT is the negated inner product.
    """
    name = canonical(name)
    if name == EUCLIDEAN:
        value = F.sqrt(_paired(a, b, lambda x, y: (x - y) * (x - y)))
    elif name == L1:
        value = _paired(a, b, lambda x, y: F.abs(x - y))
    elif name == DOT_PRODUCT:
        value = -dot(a, b)
    else:
        size = norm(a) * norm(b)
        value = F.when(size == 0, F.raise_error(F.lit("cosine of a zero vector"))).otherwise(1 - dot(a, b) / size)
    wrong = a.isNull() | b.isNull() | (F.size(a) != F.size(b))
    return F.when(wrong, F.raise_error(F.lit("vectors must be given and of one length"))).otherwise(value)


def bulk(queries: np.ndarray, base: np.ndarray, name: str | None = None) -> np.ndarray:
    """All distances (query, base) of two matrices in double precision."""
    name = canonical(name)
    q, b = queries.astype(np.float64, copy=False), base.astype(np.float64, copy=False)
    if q.shape[1:] != b.shape[1:]:
        raise ValueError("vectors must be of one length")
    if name == L1:
        return np.stack([np.abs(b - x).sum(1) for x in q]) if len(q) else np.empty((0, len(b)))
    if name == DOT_PRODUCT:
        return -(q @ b.T)
    if name == COSINE:
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(b, axis=1)
        if (size == 0).any():
            raise ValueError("cosine of a zero vector")
        return 1 - q @ b.T / size
    # Differences, not the expanded square: near distances keep their digits.
    return np.stack([np.sqrt(((b - x) ** 2).sum(1)) for x in q]) if len(q) else np.empty((0, len(b)))


def paired(a: np.ndarray, b: np.ndarray, name: str | None = None) -> np.ndarray:
    """Distances of the rows of two matrices that stand in the same place; what other rows there are changes none."""
    name = canonical(name)
    if name == EUCLIDEAN:
        return np.sqrt(((b - a) ** 2).sum(1))
    if name == L1:
        return np.abs(b - a).sum(1)
    dot = (a * b).sum(1)
    return -dot if name == DOT_PRODUCT else 1 - dot / (np.sqrt((a**2).sum(1)) * np.sqrt((b**2).sum(1)))
