"""Distances, neighbours, statistics, generators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import distances as D
from facetry.operators import generators as G
from facetry.operators import neighbors as N
from facetry.operators import statistics as S
from facetry.operators.predicates import leaf


@pytest.mark.parametrize(
    "a, b, name, expected",
    [([1, 0, 0], [0, 1, 0], "EUCLIDEAN", 2**0.5), ([3, 0], [0, 4], "L2", 5), ([1, 2, 3], [4, 5, 6], "DOT_PRODUCT", -32), ([1, 2, 3], [4, 6, 3], "L1", 7), ([1, 0], [0, 2], "cosine", 1), ([1, 1], [2, 2], None, 0), ([1, 0], [-1, 0], "COSINE", 2)],
)
def test_distances(spark, a, b, name, expected):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>")
    assert df.select(D.distance(F.col("a"), F.col("b"), name)).first()[0] == pytest.approx(expected, abs=1e-9)
    assert D.bulk(np.array([a]), np.array([b]), name)[0, 0] == pytest.approx(expected, abs=1e-9)


def test_bad_vectors(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    for name, a, b in (("L2", "a", "b"), ("COSINE", "z", "z"), ("L1", "a", "n")):
        bad = df.withColumn("z", F.array(F.lit(0.0))).withColumn("n", F.lit(None).cast("array<double>"))
        with pytest.raises(Exception, match="(?i)vector"):
            bad.select(D.distance(F.col(a), F.col(b), name)).collect()
    with pytest.raises(ValueError):
        D.canonical("HAMMING")
    with pytest.raises(ValueError):
        D.bulk(np.zeros((1, 2)), np.zeros((1, 2)), "COSINE")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (300, 6)).astype(float)
    rows = [(i, [float(c) for c in v], i % 4) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "ordinal long, vector array<double>, label long").cache()


@pytest.mark.parametrize("metric", ["L2", "L1", "DOT_PRODUCT"])
def test_knn_with_ties(data, metric):
    x, base = data
    queries = base.where("ordinal % 30 = 0")
    brute = {}
    for q in range(0, 300, 30):
        d = np.round(D.bulk(x[q : q + 1], x, metric)[0], 6)
        brute[q] = [int(i) for i in np.lexsort((np.arange(300), d))[:7]]
    for found in (N.knn(base, queries, 7, metric, 6, segment=64), N.knn_expression(base, queries, 7, metric, 6)):
        got = {}
        for r in found.orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["ordinal"])
        assert got == brute


def test_knn_of_little(spark, data):
    _, base = data
    assert N.knn(base.limit(0), base, 3, "L2").count() == 0
    assert N.knn(base.where("ordinal < 2"), base.where("ordinal = 0"), 5, "L2", exclude_self=True).count() == 1


def _brute(x, queries, k, metric, digits=6):
    out = {}
    for q in queries:
        d = np.round(D.bulk(x[q : q + 1], x, metric)[0], digits)
        out[q] = [int(i) for i in np.lexsort((np.arange(len(x)), d))[:k]]
    return out


def _answers(found):
    out = {}
    for r in found.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append(r["ordinal"])
    return out


@pytest.mark.parametrize("metric", ["L2", "L1", "DOT_PRODUCT"])
def test_knn_by_segments_and_parts(data, metric):
    x, base = data
    queries = base.where("ordinal % 3 = 0")
    found = N.knn(base, queries, 7, metric, 6, segment=100, pairs=3000)
    assert _answers(found) == _brute(x, range(0, 300, 3), 7, metric)


def test_grid_bounds_a_task():
    for n, m in ((102_564, 5_129), (615_384, 30_770), (10**7, 10), (10, 10**7), (0, 0), (10**7, 5 * 10**5)):
        segments, parts = N._grid(n, m)
        assert n / segments <= N.SEGMENT and n * m / (segments * parts) <= N.PAIRS
        assert segments * parts <= max(1, 2 * n * m / N.PAIRS, 2 * n / N.SEGMENT)


def test_knn_expression_scores_no_pair_but_the_nearest(data):
    _, base = data
    plan = N.knn_expression(base, base.where("ordinal % 30 = 0"), 7, "L2", 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "MapInArrow" in plan


def test_nearest_of_a_segment():
    """Exact where a matrix product is not: far from the origin, beside NaN and infinity, among many alike, and of little."""
    rng = np.random.default_rng(5)
    near = 1e6 + rng.integers(0, 1000, (2000, 8)) / 1e5
    odd = rng.normal(size=(2000, 8))
    odd[7], odd[8, 3] = np.nan, np.inf
    alike = np.repeat(rng.normal(size=(4, 8)), 500, axis=0)
    for x in (near, odd, alike, near[:3], rng.normal(size=(997, 8)).astype(np.float32)):
        for metric in ("L2", "L1", "DOT_PRODUCT", "COSINE"):
            for digits in (None, 2):
                asked = np.arange(min(len(x), 20)) if x is not odd else np.arange(20, 40)
                q, ids = x[asked], np.arange(len(x))
                with np.errstate(invalid="ignore"):
                    d = np.stack([D.paired(np.tile(v.astype(float), (len(x), 1)), x.astype(float), metric) for v in q])
                    d = d if digits is None else np.round(d, digits)
                    of, found, far = N._Segment(ids, x, D.canonical(metric), 5, digits).nearest(asked, q)
                for i, row in zip(asked, d):
                    best = np.lexsort((ids, row))[:5]
                    assert found[of == i].tolist() == best.tolist() and np.array_equal(far[of == i], row[best], equal_nan=True)


def test_filtered_and_verified(data):
    x, base = data
    queries = base.where("ordinal < 4")
    found = N.predicated_knn(base, queries, [(q, leaf("label", "EQ", q)) for q in range(4)], 5, "L2", 6)
    assert all(r["ordinal"] % 4 == r["query"] for r in found.collect()) and found.count() == 20
    exact = N.knn(base, queries, 5, "L2", 6)
    ok = N.verify(exact, exact).collect()
    assert all(r["passed"] and r["recall"] == 1.0 for r in ok)
    worse = exact.withColumn("distance", F.when((F.col("query") == 2) & (F.col("rank") == 5), F.col("distance") + 1).otherwise(F.col("distance")))
    assert {r["query"]: r["within"] for r in N.verify(exact, worse).collect()} == {0: 5, 1: 5, 2: 4, 3: 5}
    facets = N.facets(exact)
    assert N.max_k(facets).first()[0] == 5 and N.max_k(N.truncated(facets, 3)).first()[0] == 3
    assert N.dereference(facets, base).count() == 20
    assert N.hubness(exact).agg(F.sum("n")).first()[0] == 20
    assert N.margin(exact, 5).count() == 4 and N.local_dimensionality(exact).count() == 4
    sizes = N.verify_profiles(base, queries, {"a": 50, "b": 300}, 5, "L2", 6)
    assert sizes.where("profile = 'b'").select("query", "rank", "ordinal").exceptAll(exact.select("query", "rank", "ordinal")).count() == 0


def test_queries_that_share_predicates(data):
    """Equal predicates are solved once; 1 and 1.0 are told apart; a query whose predicate admits nothing has no answer."""
    x, base = data
    queries = base.where("ordinal < 40")
    nodes = [leaf("label", "EQ", 1), leaf("label", "LE", 1.0), leaf("label", "GE", 2), leaf("label", "EQ", 9), leaf("label", "LE", 1)]
    admits = [lambda label: label == 1, lambda label: label <= 1, lambda label: label >= 2, lambda label: False, lambda label: label <= 1]
    got = _answers(N.predicated_knn(base, queries, [(q, nodes[q % 5]) for q in range(40)], 5, "L2", 6))
    for q, found in _brute(x, range(40), 300, "L2").items():
        assert got.get(q, []) == [i for i in found if admits[q % 5](i % 4)][:5]


def test_vector_order(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],), ([0.5, 9.0],), ([1.0, 1.0],)], "v array<double>")
    assert [r["v"] for r in df.orderBy(*N.vector_order("v")).collect()] == [[0.5, 9.0], [1.0, 1.0], [1.0, 2.0], [1.0]]


def test_statistics(spark, data):
    x, base = data
    got = {r["dim"]: r for r in S.dimension_stats(base).collect()}
    assert got[2]["mean"] == pytest.approx(x[:, 2].mean()) and got[2]["variance"] == pytest.approx(x[:, 2].var())
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.6, 0.8])], "ordinal long, vector array<double>")
    assert [(r["ordinal"], r["n"]) for r in S.duplicates(rows).collect()] == [(1, 2)]
    assert tuple(S.checks(rows).first()) == (False, False, False) and tuple(S.checks(rows.where("ordinal in (1, 3)")).first()) == (True, True, True)
    assert tuple(S.checks(rows.limit(0)).first()) == (True, True, True)
    assert sorted(r["ordinal"] for r in S.cleaned(rows).collect()) == [1, 3]
    assert S.describe(rows).first()["zeros"] == 1


def test_histogram_and_samples(spark):
    df = spark.range(95).select(F.col("id").alias("v"))
    rows = sorted(tuple(r) for r in S.histogram(df, "v").collect())
    assert rows[0] == (0, 0, 10, 10) and rows[-1] == (9, 90, 100, 5) and sum(r[3] for r in rows) == 95
    assert [tuple(r) for r in S.histogram(spark.createDataFrame([(7,), (None,)], "v long"), "v").collect()] == [(0, 7, 8, 1)]
    assert [S.sample_size(50_000), S.sample_size(10), S.sample_size(10, samples=20), S.sample_size(200, percent=10)] == [500, 1, 10, 20]
    one = S.sampled(spark.range(100).withColumnRenamed("id", "ordinal"), 7).collect()
    assert one == S.sampled(spark.range(100).withColumnRenamed("id", "ordinal").repartition(3), 7).collect()


def test_content_types(spark):
    kinds = {"cstrings": [b"a\0", b"b\0"], "jsonl": [b'{"a":1}\n', b"[1]\n"], "json": [b'{"a":1}', b"[1]"], "text": [b"a", b"b\n"], "binary": [b"a", b"\xff\x00\x01"]}
    for kind, records in kinds.items():
        assert S.content_type(spark.createDataFrame([(bytearray(r),) for r in records], "data binary")).first()[0] == kind


def test_monotonicity(spark):
    f = lambda pages: S.monotonicity(spark.createDataFrame([(i, a, n) for i, (a, n) in enumerate(pages)], "page long, first long, records long")).first()[0]
    assert f([(0, 5), (5, 3)]) == "strict" and f([(0, 5), (9, 3)]) == "sparse" and f([(0, 5), (4, 3)]) == "non-monotonic"


def test_kolmogorov_smirnov(spark):
    a = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    r = S.ks_two_sample(a, a.select((F.col("x") + 50).alias("x"))).first()
    assert r["d"] == pytest.approx(0.5) and r["critical"] == pytest.approx(1.36 * (200 / 10000) ** 0.5) and not r["same"]
    assert S.ks_two_sample(a, a).first()["same"]
    assert S.quantile_correlation(a, a).first()[0] == pytest.approx(1)


def test_generators(spark):
    v = G.random_vectors(spark, 200, 5, seed=1)
    assert v.collect() == G.random_vectors(spark, 200, 5, seed=1).collect() and S.describe(v).first()["hi"] < 1
    ints = G.random_vectors(spark, 50, 3, "int", 0, 100)
    assert dict(ints.dtypes)["vector"] == "array<int>"
    g = G.gaussian_vectors(spark, 1000, 4, zeroes=0.1, dups=0.2, scale=0.001)
    assert S.describe(g).first()["zeros"] == 100
    assert g.where(~S.is_zero(F.col("vector"))).groupBy("vector").count().agg(F.sum(F.col("count") - 1)).first()[0] == 200
    base, queries = G.split_queries(v, 20)
    assert sorted(r["ordinal"] for r in queries.collect()) == list(range(20)) and sorted(r["ordinal"] for r in base.collect()) == list(range(180))
    assert base.select("vector").unionAll(queries.select("vector")).exceptAll(v.select("vector")).count() == 0
    order = G.shuffled(v, 5).collect()
    assert sorted(r["place"] for r in order) == sorted(r["ordinal"] for r in order) == list(range(200))
    assert G.metadata_records(spark, 100).where("number between 1 and 100 and name rlike '^name_[0-9]+$'").count() == 100
    assert len(G.random_predicates(7)) == 7
    parts = G.generate_dataset(spark, 100, 5, 4, 3)
    assert {k: d.count() for k, d in parts.items()} == {"base_vectors": 100, "query_vectors": 5, "neighbor_indices": 5, "neighbor_distances": 5}


def test_models(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(zip(rng.normal(3, 2, 3000), rng.uniform(-1, 1, 3000)))]
    fitted = S.fit_models(spark.createDataFrame(rows, "ordinal long, vector array<double>"))
    got = {r["dim"]: r["family"] for r in fitted.collect()}
    assert got[0] in ("normal", "logistic") and got[1] == "uniform"
    made = S.dimension_stats(G.from_models(spark, fitted, 4000)).orderBy("dim").collect()
    assert made[0]["mean"] == pytest.approx(3, abs=0.2) and -1.001 <= made[1]["lo"] < made[1]["hi"] <= 1.001
    assert S.compare_models(fitted, fitted).where("same_family and drift = 0").count() == 2


def test_models_take_all_values(spark):
    n, p = 110_000, 110_003
    x = np.sort(np.arange(n) * 7919 % p / p)
    column = F.array((F.col("id") * 7919 % p) / float(p), F.lit(None).cast("double"), F.when(F.col("id") < n // 4, 5.0).otherwise(F.col("id") % 4))
    got = {r["dim"]: r for r in S.fit_models(spark.range(n).select(F.col("id").alias("ordinal"), column.alias("vector"))).collect()}
    at = (x - x[0]) / (x[-1] - x[0])
    most = max(np.abs(at - np.arange(1, n + 1) / n).max(), np.abs(at - np.arange(n) / n).max())
    assert got[0]["family"] == "uniform" and got[0]["parameters"] == [x[0], x[-1]] and got[0]["distance"] == pytest.approx(most, abs=1e-12)
    assert (got[1]["family"], got[1]["parameters"], got[1]["distance"]) == ("empirical", [], 1.0)
    ids = np.arange(n)
    assert got[2]["parameters"] == pytest.approx(np.quantile(np.where(ids < n // 4, 5, ids % 4), np.linspace(0, 1, S.KNOTS)).tolist())
