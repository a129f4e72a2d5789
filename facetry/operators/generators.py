"""Generated vectors, shuffles, extracts, splits and predicate sets; all deterministic from their seeds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import predicates
from .neighbors import facets, knn


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, whatever the partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11)).cast("double") / float(1 << 53)


def _normal(seed: int, a: Column, b: Column) -> Column:
    u, v = _uniform(F.lit(seed), a, b, F.lit(1)), _uniform(F.lit(seed), a, b, F.lit(2))
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def random_vectors(spark: SparkSession, count: int, dim: int, kind: str = "float", lo: float = 0.0, hi: float = 1.0, seed: int = 42) -> DataFrame:
    """(ordinal, vector): components even from lo up to hi; whole numbers for integer types."""
    x = lambda i: _uniform(F.lit(seed), F.col("id"), i) * (hi - lo) + lo
    whole = kind in ("int", "short", "byte", "long")
    item = (lambda i: F.floor(x(i)).cast(kind)) if whole else (lambda i: x(i).cast(kind))
    return spark.range(count).select(F.col("id").alias("ordinal"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), item).alias("vector"))


def gaussian_vectors(spark: SparkSession, count: int, dim: int, seed: int = 42, variability: float = 1.0, scale: float = 0.0, zeroes: float = 0.0, dups: float = 0.0) -> DataFrame:
    """(ordinal, vector): normal components times `variability`, plus normal components times `scale` and the ordinal.

    round(zeroes * count) rows are zero and round(dups * count) others copy one of the rest.
    """
    n_zero, n_dup = round(zeroes * count), round(dups * count)
    if n_zero + n_dup > count or n_dup and n_zero + n_dup == count:
        raise ValueError("no rows are left to copy")
    plain = count - n_zero - n_dup
    # A keyed permutation deals the roles: multiplication by a number prime to the count.
    step = next(s for s in range(int(count * 0.6180339887) | 1, 2 * count + 3) if math.gcd(s, max(count, 1)) == 1) if count else 1
    role = F.pmod(F.col("id") * step + seed, F.lit(max(count, 1)))
    inverse = pow(step, -1, count) if count > 1 else 0
    source = F.floor(_uniform(F.lit(seed), F.col("id"), F.lit(-7)) * max(plain, 1)).cast("long")
    at = F.when(role < plain, F.col("id")).when(role < plain + n_dup, F.pmod((source - seed) * inverse, F.lit(max(count, 1)))).alias("at")
    rows = spark.range(count).select(F.col("id").alias("ordinal"), at)
    item = lambda i: (_normal(seed, F.col("at"), i) * variability + _normal(seed + 1, F.col("at"), i) * scale * F.col("at")).cast("float")
    dims = F.sequence(F.lit(0), F.lit(dim - 1))
    return rows.select("ordinal", F.when(F.col("at").isNull(), F.transform(dims, lambda i: F.lit(0.0).cast("float"))).otherwise(F.transform(dims, item)).alias("vector"))


def keyed(c: Column, seed: int) -> Column:
    """A shuffle key that any SQL engine computes alike."""
    return F.pmod((c + seed) * 48271, F.lit(2147483647))


def shuffled(rows: DataFrame, seed: int = 42, ordinal: str = "ordinal") -> DataFrame:
    """(place, ordinal): a permutation of the ordinals by a keyed order.

    Ranks are given within ranges of the key and shifted by what lies before, so that no task sorts everything.
    """
    from ..sources.xvec import dense

    keys = rows.select(F.col(ordinal).cast("long").alias("source"), keyed(F.col(ordinal), seed).alias("_key"))
    return dense(keys, "_key", "source").select(F.col("ordinal").alias("place"), F.col("source").alias("ordinal"))


def extract(facet: DataFrame, indices: DataFrame, lo: int = 0, hi: int | None = None) -> DataFrame:
    """(ordinal, ...): the rows that indices (place, ordinal) name at places lo up to hi, numbered by place."""
    some = indices.where((F.col("place") >= lo) & (F.lit(True) if hi is None else F.col("place") < hi))
    return some.join(facet, "ordinal").drop("ordinal").withColumnRenamed("place", "ordinal").withColumn("ordinal", F.col("ordinal") - lo)


def split_queries(facet: DataFrame, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(base, queries): n rows at random as queries, the rest as base, numbered anew."""
    order = shuffled(facet, seed)
    return extract(facet, order, n), extract(facet, order, 0, n)


def generate_dataset(spark: SparkSession, base: int = 10_000, queries: int = 1_000, dim: int = 128, k: int = 100, metric: str = "L2", seed: int = 42) -> dict[str, DataFrame]:
    """Base and query vectors with their exact neighbour facets."""
    b, q = random_vectors(spark, base, dim, seed=seed), random_vectors(spark, queries, dim, seed=seed + 1)
    found = facets(knn(b, q, k, metric))
    return {"base_vectors": b, "query_vectors": q, "neighbor_indices": found.select("ordinal", F.col("indices").alias("vector")), "neighbor_distances": found.select("ordinal", F.col("distances").alias("vector"))}


def metadata_records(spark: SparkSession, count: int, seed: int = 42) -> DataFrame:
    """(ordinal, name, number): names name_1 to name_100, numbers 1 to 100."""
    pick = lambda i: (F.floor(_uniform(F.lit(seed), F.col("id"), F.lit(i)) * 100) + 1).cast("long")
    return spark.range(count).select(F.col("id").alias("ordinal"), F.concat(F.lit("name_"), pick(1).cast("string")).alias("name"), pick(2).alias("number"))


def random_predicates(count: int, seed: int = 42) -> list[tuple[int, predicates.Node]]:
    """(query, tree): one comparison, or AND of a name and a number, over metadata_records()."""
    import random

    r = random.Random(seed)
    out = []
    for i in range(count):
        name = predicates.leaf("name", "EQ", f"name_{r.randint(1, 100)}")
        number = predicates.leaf("number", r.choice(("GT", "LT", "EQ", "GE", "LE")), r.randint(1, 100))
        out.append((i, r.choice((name, number, predicates.all_of(name, number)))))
    return out


def from_models(spark: SparkSession, models: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(ordinal, vector): components drawn from fitted models (dim, family, parameters) by their inverse functions.

    The models, a row for each dimension, go to every task.
    """
    u = _uniform(F.lit(seed), F.col("id"), F.col("dim"))
    p = lambda i: F.col("parameters")[i]
    z = _normal(seed, F.col("id"), F.col("dim"))
    knots = F.size("parameters") - 1
    at = u * knots
    low = F.floor(at).cast("int")
    between = F.element_at("parameters", low + 1) + (F.element_at("parameters", F.least(low + 2, knots + 1)) - F.element_at("parameters", low + 1)) * (at - low)
    x = (
        F.when(F.col("family") == "normal", p(0) + p(1) * z)
        .when(F.col("family") == "lognormal", F.exp(p(0) + p(1) * z))
        .when(F.col("family") == "uniform", p(0) + (p(1) - p(0)) * u)
        .when(F.col("family") == "exponential", p(0) - p(1) * F.ln(1 - u))
        .when(F.col("family") == "logistic", p(0) + p(1) * F.ln(F.greatest(u, F.lit(1e-16)) / (1 - u)))
        .when(F.col("family") == "laplace", p(0) - p(1) * F.signum(u - 0.5) * F.ln(F.greatest(1 - 2 * F.abs(u - 0.5), F.lit(1e-16))))
        .otherwise(between)
    )
    rows = spark.range(count).crossJoin(F.broadcast(models)).select(F.col("id").alias("ordinal"), "dim", x.cast("float").alias("x"))
    return rows.groupBy("ordinal").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s.x).alias("vector"))
