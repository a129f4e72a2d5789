"""Statistics of vectors and stored records: moments, histograms, duplicates, samples, comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import storage
from . import distances


def components(facet: DataFrame, value: str = "vector") -> DataFrame:
    """(dim, x) of every component, in double precision."""
    return facet.select(F.posexplode(F.col(value).cast("array<double>")).alias("dim", "x"))


def dimension_stats(facet: DataFrame, value: str = "vector") -> DataFrame:
    """(dim, n, mean, variance, skewness, kurtosis, lo, hi): population moments, kurtosis in excess of 3."""
    return components(facet, value).groupBy("dim").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.skewness("x").alias("skewness"),
        F.kurtosis("x").alias("kurtosis"), F.min("x").alias("lo"), F.max("x").alias("hi"),
    )


def is_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def describe(facet: DataFrame, value: str = "vector") -> DataFrame:
    """One row: rows, dimension, range of components and norms, zero vectors."""
    v = F.col(value)
    return facet.select(F.size(v).alias("d"), distances.norm(v).alias("norm"), F.array_min(v).cast("double").alias("lo"), F.array_max(v).cast("double").alias("hi"), is_zero(v).alias("zero")).agg(
        F.count("*").alias("rows"), F.min("d").cast("long").alias("min_dim"), F.max("d").cast("long").alias("max_dim"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min("norm").alias("min_norm"), F.avg("norm").alias("avg_norm"), F.max("norm").alias("max_norm"), F.coalesce(F.sum(F.col("zero").cast("long")), F.lit(0)).alias("zeros"),
    )


def duplicates(facet: DataFrame, value: str = "vector", ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, n): the first row of every vector that occurs more than once, and how often it does."""
    return facet.groupBy(value).agg(F.min(ordinal).alias("ordinal"), F.count("*").alias("n")).where("n > 1").select("ordinal", "n")


def checks(facet: DataFrame, value: str = "vector", ordinal: str = "ordinal", eps: float = 1e-3) -> DataFrame:
    """One row: is_zero_vector_free, is_duplicate_vector_free, is_normalized."""
    each = facet.groupBy(value).agg(F.count("*").alias("n")).select("n", is_zero(F.col(value)).alias("zero"), (F.abs(distances.norm(F.col(value)) - 1) <= eps).alias("unit"))
    return each.agg(F.coalesce(~F.bool_or("zero"), F.lit(True)).alias("is_zero_vector_free"), F.coalesce(F.max("n") == 1, F.lit(True)).alias("is_duplicate_vector_free"), F.coalesce(F.bool_and("unit"), F.lit(True)).alias("is_normalized"))


def cleaned(facet: DataFrame, value: str = "vector", ordinal: str = "ordinal") -> DataFrame:
    """Without zero vectors, and of equal vectors the one of the smallest ordinal."""
    rest = [c for c in facet.columns if c not in (value, ordinal)]
    first = facet.where(~is_zero(F.col(value))).groupBy(value).agg(F.min(F.struct(ordinal, *rest)).alias("_first"))
    return first.select([F.col(value) if c == value else F.col(f"_first.{c}") for c in facet.columns])


def histogram(rows: DataFrame, value: str, buckets: int = 10) -> DataFrame:
    """(bucket, lo, hi, n) of whole numbers: at most `buckets` of equal whole width; the last takes what is above.

    Empty buckets are left out.
    """
    v = F.col(value).cast("long")
    bounds = rows.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / buckets)).cast("long")
    bounds = bounds.withColumn("w", width)
    placed = rows.select(v.alias("v")).where("v is not null").join(F.broadcast(bounds))
    b = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")).cast("long"), F.lit(buckets - 1).cast("long"))
    out = placed.groupBy(b.alias("bucket"), "lo", "w").agg(F.count("*").alias("n"))
    return out.select("bucket", (F.col("lo") + F.col("bucket") * F.col("w")).alias("lo"), (F.col("lo") + (F.col("bucket") + 1) * F.col("w")).alias("hi"), "n")


def record_sizes(records: DataFrame, data: str = "data") -> DataFrame:
    """One row: count, min, avg and max of the records' bytes."""
    n = F.length(F.col(data).cast("binary")).cast("long")
    return records.agg(F.count("*").alias("records"), F.min(n).alias("min_bytes"), F.avg(n).alias("avg_bytes"), F.max(n).alias("max_bytes"))


def page_sizes(pages: DataFrame, used: str = "used", size: str = "size") -> DataFrame:
    """One row: pages, min, avg and max of their bytes, and how much of them is used."""
    return pages.agg(F.count("*").alias("pages"), F.min(size).alias("min_size"), F.avg(size).alias("avg_size"), F.max(size).alias("max_size"), (F.sum(used) / F.sum(size)).alias("utilization"))


def monotonicity(pages: DataFrame, order: str = "page", first: str = "first", records: str = "records") -> DataFrame:
    """One row: `strict` where pages follow without gaps, `sparse` with gaps, else `non-monotonic`."""
    before = F.lag(F.col(first) + F.col(records)).over(Window.orderBy(order))
    gap = (F.col(first) - before).alias("gap")
    return pages.select(gap).agg(F.when(F.coalesce(F.min("gap"), F.lit(0)) < 0, "non-monotonic").when(F.coalesce(F.max("gap"), F.lit(0)) > 0, "sparse").otherwise("strict").alias("ordinals"))


def content_type(records: DataFrame, data: str = "data") -> DataFrame:
    """One row (kind): what all records have in common: cstrings, jsonl, json, text or binary."""
    raw = F.col(data).cast("binary")
    text = F.try_validate_utf8(raw.cast("string"))
    plain = text.isNotNull() & ~text.rlike(r"[\x00-\x08\x0E-\x1F]")
    parsed = F.try_parse_json(F.when(plain, text)).isNotNull() & plain & text.rlike(r"\A\s*[\[{]")
    ends = F.endswith(raw, F.lit(b"\0"))
    flags = records.select(ends.alias("c"), parsed.alias("j"), F.endswith(raw, F.lit(b"\n")).alias("l"), plain.alias("t"))
    every = lambda c: F.coalesce(F.bool_and(F.coalesce(F.col(c), F.lit(False))), F.lit(False))
    return flags.agg(F.when(every("c"), "cstrings").when(every("j") & every("l"), "jsonl").when(every("j"), "json").when(every("t"), "text").otherwise("binary").alias("kind"))


def sample_size(total: int, samples: int | None = None, percent: float | None = None) -> int:
    if samples is not None:
        return min(samples, total)
    if percent is not None:
        return int(total * percent / 100)
    return min(1000, max(1, total // 100))


def sampled(rows: DataFrame, n: int, seed: int = 42, key: str = "ordinal") -> DataFrame:
    """n rows, the same for every run: those of the smallest hashes of their key."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def attribute_range(rows: DataFrame, value: str) -> DataFrame:
    """One row: `min`, or `mintomax` where they differ."""
    lo, hi = F.min(value).cast("string"), F.max(value).cast("string")
    return rows.agg(F.when(lo == hi, lo).otherwise(F.concat(lo, F.lit("to"), hi)).alias("range"))


def bitmask(rows: DataFrame, flag: str) -> DataFrame:
    """One row: the OR of one bit for each number in `flag`."""
    return rows.agg(F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(flag).cast("int"))), F.lit(0).cast("long")).alias("mask"))


def _running(rows: DataFrame, by: tuple[str, ...], order: str, sums: dict[str, str]) -> DataFrame:
    """`rows` with running sums (name: column) in the order of `order` within each group of `by`.

    Rows are dealt into ranges, summed in each, and the sums of earlier ranges of a group added: a row for each range
    and group is all that one task sees of the whole.
    """
    spread = storage.written(rows.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = spread.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = spread.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()]).join(before, [*by, "_part"])
    return out.select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def ks_two_sample(a: DataFrame, b: DataFrame, value: str = "x", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n1, n2, d, critical, same) of the two-sample Kolmogorov-Smirnov test at 5 %.

    Counts are summed for each distinct value before they are ordered, so ties and hot values are one row each; the
    distinct values' running sums are taken range by range.
    """
    count = lambda df, i: df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"), F.lit(i).alias("s"))
    each = count(a, 1).unionByName(count(b, 2)).groupBy(*by, "x").agg(*[F.sum((F.col("s") == i).cast("long")).alias(f"c{i}") for i in (1, 2)])
    steps = _running(each, by, "x", {"r1": "c1", "r2": "c2"})
    # The running sums end in the whole ones.
    whole = steps.groupBy(*by).agg(F.max("r1").alias("n1"), F.max("r2").alias("n2"))
    joined = steps.join(F.broadcast(whole), list(by)) if by else steps.crossJoin(F.broadcast(whole))
    out = joined.groupBy(*by, "n1", "n2").agg(F.max(F.abs(F.try_divide("r1", "n1") - F.try_divide("r2", "n2"))).alias("d"))
    critical = 1.36 * F.sqrt((F.col("n1") + F.col("n2")) / (F.col("n1") * F.col("n2")))
    return out.withColumn("critical", critical).withColumn("same", F.col("d") <= F.col("critical"))


def quantile_correlation(a: DataFrame, b: DataFrame, value: str = "x", points: int = 100) -> DataFrame:
    """One row (corr): the correlation of the two samples' quantiles."""
    at = F.array(*[F.lit((i + 0.5) / points) for i in range(points)])
    q = lambda df, n: df.agg(F.percentile(value, at).alias(n))
    return q(a, "p").crossJoin(q(b, "q")).select(F.explode(F.arrays_zip("p", "q")).alias("z")).agg(F.corr("z.p", "z.q").alias("corr"))


# --- models of a dimension -----------------------------------------------------------------------------------------

FAMILIES = ("normal", "uniform", "exponential", "laplace", "logistic", "lognormal", "empirical")
KNOTS = 33


def _fits(of: dict):
    """(family, parameters, distribution function) of each family that can hold values with these measures."""
    from math import erf

    mean, sd, lo, hi, med = of["mean"], of["sd"], of["lo"], of["hi"], of["knots"][KNOTS // 2]
    phi = np.vectorize(lambda z: 0.5 * (1 + erf(z / 2**0.5)), otypes=[float])
    if hi > lo and sd > 0:
        yield "normal", (mean, sd), lambda x: phi((x - mean) / sd)
        yield "uniform", (lo, hi), lambda x: (x - lo) / (hi - lo)
        s = sd * 3**0.5 / np.pi
        yield "logistic", (mean, s), lambda x: 1 / (1 + np.exp(-(x - mean) / s))
        scale = of["gap"] or sd

        def laplace(x):
            z = (x - med) / scale
            return np.where(z < 0, 0.5 * np.exp(np.minimum(z, 0)), 1 - 0.5 * np.exp(-np.maximum(z, 0)))

        yield "laplace", (med, scale), laplace
        if mean > lo:
            yield "exponential", (lo, mean - lo), lambda x: 1 - np.exp(-(x - lo) / (mean - lo))
        if lo > 0 and of["log_sd"]:
            m, t = of["log_mean"], of["log_sd"]
            yield "lognormal", (m, t), lambda x: phi((np.log(x) - m) / t)


def _knots(steps: DataFrame) -> DataFrame:
    """(dim, knots): the quantiles at 0, 1 / 32 ... 1, between two values in proportion; steps: (dim, x, c, r, n)."""
    last = KNOTS - 1
    low = lambda j: F.floor((F.col("n") - 1) * j / last)
    high = lambda j: F.least(low(j) + 1, F.col("n") - 1)
    here = lambda at: (at >= F.col("r") - F.col("c")) & (at < F.col("r"))
    some = steps.withColumn("j", F.explode(F.filter(F.sequence(F.lit(0), F.lit(last)), lambda j: here(low(j)) | here(high(j)))))
    j = F.col("j")
    ends = some.groupBy("dim", "n", "j").agg(F.max(F.when(here(low(j)), F.col("x"))).alias("a"), F.max(F.when(here(high(j)), F.col("x"))).alias("b"))
    x = F.col("a") + (F.col("b") - F.col("a")) * ((F.col("n") - 1) * j / last - low(j))
    return ends.groupBy("dim").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", x.alias("x")))), lambda k: k.x).alias("knots"))


def fit_models(facet: DataFrame, value: str = "vector", limit: float = 0.05) -> DataFrame:
    """(dim, family, parameters, distance): the family nearest to each dimension by its largest distance of distribution
    functions; the empirical one, as quantiles, where none is within `limit`.

    All values count, whatever the table's size: the distance is taken over the counts of distinct values, with their
    running sums range by range. A few numbers for each dimension come to the driver.
    """
    spark, cells = facet.sparkSession, components(facet, value)
    dims = [r["dim"] for r in cells.select("dim").distinct().collect()]
    held = cells.where(F.col("x").isNotNull() & ~F.isnan("x"))
    log = F.when(F.col("x") > 0, F.ln("x"))
    measures = held.groupBy("dim").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.avg(log).alias("log_mean"), F.stddev_pop(log).alias("log_sd"),
    )
    of = {r["dim"]: r.asDict() for r in measures.collect()}
    counted = held.groupBy("dim", "x").agg(F.count("*").alias("c"))
    whole = F.broadcast(measures.select("dim", "n"))
    steps = storage.written(_running(counted, ("dim",), "x", {"r": "c"}).join(whole, "dim"), "steps")
    for r in _knots(steps).collect():
        of[r["dim"]]["knots"] = r["knots"]
    if of:
        medians = spark.createDataFrame([(d, m["knots"][KNOTS // 2]) for d, m in of.items()], "dim int, med double")
        for r in held.join(F.broadcast(medians), "dim").groupBy("dim").agg(F.avg(F.abs(F.col("x") - F.col("med"))).alias("gap")).collect():
            of[r["dim"]]["gap"] = r["gap"]

    def run(batches):
        for pdf in batches:
            out = []
            for d, part in pdf.groupby("dim"):
                x, upper = part["x"].to_numpy(), (part["r"] / part["n"]).to_numpy()
                lower = ((part["r"] - part["c"]) / part["n"]).to_numpy()
                for name, _, f in _fits(of[d]):
                    at = f(x)
                    out.append((d, name, float(np.max(np.maximum(np.abs(at - upper), np.abs(at - lower))))))
            yield pd.DataFrame(out, columns=["dim", "family", "distance"])

    apart: dict = {}
    for r in steps.mapInPandas(run, "dim int, family string, distance double").groupBy("dim", "family").agg(F.max("distance").alias("distance")).collect():
        apart.setdefault(r["dim"], []).append((r["distance"], r["family"]))
    models = []
    for d in dims:
        distance, family = min(apart.get(d, []), default=(1.0, "empirical"))
        if d not in of:
            models.append((d, "empirical", [], 1.0))
        elif distance > limit:
            models.append((d, "empirical", of[d]["knots"], 0.0))
        else:
            models.append((d, family, [float(p) for name, ps, _ in _fits(of[d]) if name == family for p in ps], distance))
    return spark.createDataFrame(models, "dim int, family string, parameters array<double>, distance double")


def profile(facet: DataFrame, value: str = "vector", limit: float = 0.05) -> DataFrame:
    """A row for each dimension: the moments of dimension_stats() beside the model of fit_models()."""
    # Two tables of a row for each dimension.
    return dimension_stats(facet, value).join(F.broadcast(fit_models(facet, value, limit)), "dim")


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """(dim, family_a, family_b, same_family, drift): fitted models side by side; drift is the mean parameter distance."""
    j = a.select("dim", F.col("family").alias("family_a"), F.col("parameters").alias("p")).join(b.select("dim", F.col("family").alias("family_b"), F.col("parameters").alias("q")), "dim", "full")
    gap = F.aggregate(F.zip_with("p", "q", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("p")
    same = F.coalesce(F.col("family_a") == F.col("family_b"), F.lit(False))
    return j.select("dim", "family_a", "family_b", same.alias("same_family"), F.when(same, gap).alias("drift"))
