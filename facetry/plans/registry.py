"""Registered queries over the given tables, each with its SQL where SQL can express it.

Embeddings are the base vectors (vec_id the ordinal, label a metadata field); part, lineitem and customer are metadata;
events.props is a map of tags; the texts of documents are content for hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import literals
from ..operators import distances, generators, integrity, neighbors, statistics, windows
from ..operators.predicates import all_of, any_of, compile_predicate, leaf, parse_json, render_cddl, render_cql, render_sql, solve
from ..operators.tags import TagFilter
from ..sources import xvec

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
DIGITS = 6
EVERY = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"), "label")


def _query_vectors(base: DataFrame) -> DataFrame:
    """Every row whose ordinal is divisible by 20 is a query against all rows."""
    return base.where(F.col("ordinal") % EVERY == 0)


# --- predicates ----------------------------------------------------------------------------------------------------

_NUMERIC = [
    (0, leaf("p_size", "GT", 25)), (1, leaf("p_size", "LT", 25)), (2, leaf("p_size", "GE", 25)), (3, leaf("p_size", "LE", 25)), (4, leaf("p_size", "EQ", 25)), (5, leaf("p_size", "NE", 25)),
    (6, leaf("p_retailprice", "GT", 1000.5)), (7, leaf("p_retailprice", "LE", 1000.5)), (8, leaf("p_retailprice", "NE", 1000.5)),
]
_NUMERIC_SQL = ["p_size > 25", "p_size < 25", "p_size >= 25", "p_size <= 25", "p_size = 25", "p_size <> 25", "p_retailprice > 1000.5::double", "p_retailprice <= 1000.5::double", "p_retailprice <> 1000.5::double"]


def _solved_sql(conditions: list[str], table: str, key: str) -> str:
    return " union all ".join(f"select {i}::bigint query, {key}::bigint ordinal from {table} where {c}" for i, c in enumerate(conditions))


@query(_solved_sql(_NUMERIC_SQL, "part", "p_partkey"))
def pred_numeric_ops(spark, sf_dir):
    return solve(_table(spark, sf_dir, "part"), _NUMERIC, "p_partkey")


@query("select p_partkey, p_size from part where p_size in (1, 5, 9, 49) or p_brand in ('Brand#11', 'Brand#23')")
def pred_in(spark, sf_dir):
    df = _table(spark, sf_dir, "part")
    # 2.5 is of another kind than the first comparand and doesn't count.
    node = any_of(leaf("p_size", "IN", 1, 5, 9, 49, 2.5), leaf("p_brand", "IN", "Brand#11", "Brand#23"))
    return df.where(compile_predicate(node, df.schema)).select("p_partkey", "p_size")


@query(_solved_sql(["c_name > 'Customer#000000700'", "c_name < 'Customer#000000100'", "c_mktsegment = 'BUILDING'", "c_mktsegment <> 'BUILDING'", "c_mktsegment >= 'FURNITURE'", "c_mktsegment <= 'BUILDING'"], "customer", "c_custkey"))
def pred_text_cmp(spark, sf_dir):
    tests = [("c_name", "GT", "Customer#000000700"), ("c_name", "LT", "Customer#000000100"), ("c_mktsegment", "EQ", "BUILDING"), ("c_mktsegment", "NE", "BUILDING"), ("c_mktsegment", "GE", "FURNITURE"), ("c_mktsegment", "LE", "BUILDING")]
    return solve(_table(spark, sf_dir, "customer"), [(i, leaf(*t)) for i, t in enumerate(tests)], "c_custkey")


@query("select l_orderkey, l_linenumber from lineitem where (l_quantity > 45 and (l_returnflag = 'R' or l_linestatus = 'F')) or (l_discount = 0.05::double and l_tax < 0.02::double)")
def pred_and_or_nested(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    node = any_of(all_of(leaf("l_quantity", "GT", 45.0), any_of(leaf("l_returnflag", "EQ", "R"), leaf("l_linestatus", "EQ", "F"))), all_of(leaf("l_discount", "EQ", 0.05), leaf("l_tax", "LT", 0.02)))
    return df.where(compile_predicate(node, df.schema)).select("l_orderkey", "l_linenumber")


@query("select p_partkey from part where regexp_full_match(p_type, '[A-Z]+ .*(STEEL|COPPER)') or regexp_full_match(p_brand, 'Brand#[1-3][0-9]')")
def pred_matches(spark, sf_dir):
    df = _table(spark, sf_dir, "part")
    node = any_of(leaf("p_type", "MATCHES", "[A-Z]+ .*(STEEL|COPPER)"), leaf("p_brand", "MATCHES", "Brand#[1-3][0-9]"))
    return df.where(compile_predicate(node, df.schema)).select("p_partkey")


def _with_nulls(spark, sf_dir):
    return _table(spark, sf_dir, "part").withColumn("size", F.nullif(F.col("p_size"), F.lit(1)))


@query("select p_partkey from part where p_size = 1")
def pred_null_eq(spark, sf_dir):
    df = _with_nulls(spark, sf_dir)
    node = all_of(leaf("size", "EQ", None), leaf("no_such_field", "EQ", None))
    return df.where(compile_predicate(node, df.schema)).select("p_partkey")


@query("select p_partkey from part where p_size <> 1 and p_size <> 7")
def pred_null_ne(spark, sf_dir):
    df = _with_nulls(spark, sf_dir)
    return df.where(compile_predicate(leaf("size", "NE", 7), df.schema)).select("p_partkey")


@query("select p_partkey from part where false")
def pred_type_mismatch(spark, sf_dir):
    df = _table(spark, sf_dir, "part")
    node = any_of(leaf("p_size", "NE", "5"), leaf("p_name", "NE", 5), leaf("p_size", "NE", True), leaf("p_size", "GT", b"1"))
    return df.where(compile_predicate(node, df.schema)).select("p_partkey")


@query(_solved_sql(["trunc(p_retailprice)::bigint = 950", "trunc(p_retailprice)::bigint > 1200", "trunc(p_retailprice)::bigint <> 950"], "part", "p_partkey"))
def pred_trunc_int_family(spark, sf_dir):
    return solve(_table(spark, sf_dir, "part"), [(0, leaf("p_retailprice", "EQ", 950)), (1, leaf("p_retailprice", "GT", 1200)), (2, leaf("p_retailprice", "NE", 950))], "p_partkey")


@query("select p_partkey from part where p_size >= 10 and (p_brand = 'Brand#12' or p_type like 'PROMO%')")
def pred_json(spark, sf_dir):
    df = _table(spark, sf_dir, "part")
    node = parse_json('{"op": "AND", "nodes": [{"field": "p_size", "op": ">=", "values": [10]}, {"op": "OR", "nodes": [{"field": "p_brand", "op": "EQ", "values": ["Brand#12"]}, {"field": "p_type", "op": "MATCHES", "values": ["PROMO.*"]}]}]}')
    return df.where(compile_predicate(node, df.schema)).select("p_partkey")


_BATCH = [(i, all_of(leaf("p_size", "GE", 5 * i), leaf("p_size", "LT", 5 * i + 5), leaf("p_retailprice", "GT", 900.0 + 20 * i))) for i in range(10)]


@query(_solved_sql([f"p_size >= {5 * i} and p_size < {5 * i + 5} and p_retailprice > {900 + 20 * i}::double" for i in range(10)], "part", "p_partkey"))
def pred_solve_batch(spark, sf_dir):
    return solve(_table(spark, sf_dir, "part"), _BATCH, "p_partkey")


@query("select * from (values ('sql', '(age > 20 AND name = ''O''''Brien'')'), ('cql', 'age > 20 AND name = ''O''''Brien'''), ('cddl', 'AND { age: int > 20, name: tstr = \"O''Brien\" }')) t(dialect, shown)")
def pred_render(spark, sf_dir):
    node = all_of(leaf("age", "GT", 20), leaf("name", "EQ", "O'Brien"))
    return spark.createDataFrame([(n, f(node)) for n, f in (("sql", render_sql), ("cql", render_cql), ("cddl", render_cddl))], "dialect string, shown string")


# --- distances and neighbours --------------------------------------------------------------------------------------

_PAIRS_SQL = "select a.vec_id, round({f}, 6) distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"
_LISTS = "list_zip(a.embedding::double[], b.embedding::double[])"
_DISTANCE_SQL = {
    "l2": "list_distance(a.embedding::double[], b.embedding::double[])",
    "l1": f"list_sum(list_transform({_LISTS}, lambda z: abs(z[1] - z[2])))",
    "dot": "list_negative_inner_product(a.embedding::double[], b.embedding::double[])",
    "cosine": "list_cosine_distance(a.embedding::double[], b.embedding::double[])",
}


def _neighbouring(spark, sf_dir, metric):
    a = _base(spark, sf_dir)
    b = a.select((F.col("ordinal") - 1).alias("ordinal"), F.col("vector").alias("other"))
    return a.join(b, "ordinal").select(F.col("ordinal").alias("vec_id"), F.round(distances.distance(F.col("vector"), F.col("other"), metric), DIGITS).alias("distance"))


@query(_PAIRS_SQL.format(f=_DISTANCE_SQL["l2"]))
def dist_l2(spark, sf_dir):
    return _neighbouring(spark, sf_dir, "L2")


@query(_PAIRS_SQL.format(f=_DISTANCE_SQL["l1"]))
def dist_l1(spark, sf_dir):
    return _neighbouring(spark, sf_dir, "L1")


@query(_PAIRS_SQL.format(f=_DISTANCE_SQL["dot"]))
def dist_dot(spark, sf_dir):
    return _neighbouring(spark, sf_dir, "DOT_PRODUCT")


@query(_PAIRS_SQL.format(f=_DISTANCE_SQL["cosine"]))
def dist_cosine(spark, sf_dir):
    return _neighbouring(spark, sf_dir, "COSINE")


_FOUND_SQL = """
    select query, rank, ordinal, distance from (
      select *, row_number() over (partition by query order by distance, ordinal)::int rank from (
        select b.vec_id query, a.vec_id ordinal, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) distance
        from embeddings a join embeddings b on {on}))
    where rank <= {k}"""
_KNN_SQL = _FOUND_SQL.format(on="b.vec_id % 20 = 0", k=10)


def _knn(spark, sf_dir, k=10):
    base = _base(spark, sf_dir)
    return neighbors.knn(base, _query_vectors(base), k, "L2", DIGITS)


@query(_KNN_SQL)
def knn_exact(spark, sf_dir):
    return _knn(spark, sf_dir)


@query(_KNN_SQL)
def knn_expression(spark, sf_dir):
    base = _base(spark, sf_dir)
    return neighbors.knn_expression(base, _query_vectors(base), 10, "L2", DIGITS)


@query(_FOUND_SQL.format(on="b.vec_id % 20 = 0 and a.label in (1, 2, 3) and a.vec_id >= 100", k=5))
def knn_filtered(spark, sf_dir):
    base = _base(spark, sf_dir)
    node = all_of(leaf("label", "IN", 1, 2, 3), leaf("ordinal", "GE", 100))
    return neighbors.knn(base.where(compile_predicate(node, base.schema)), _query_vectors(base), 5, "L2", DIGITS)


@query(_FOUND_SQL.format(on="b.vec_id % 20 = 0 and a.label = (b.vec_id // 20) % 10", k=5))
def knn_predicated(spark, sf_dir):
    """Each query has a predicate of its own: query i admits the label i mod 10."""
    base = _base(spark, sf_dir)
    queries = _query_vectors(base)
    solved = solve(base, [(label, leaf("label", "EQ", label)) for label in range(10)])
    own = queries.select(F.col("ordinal").alias("query"), F.pmod(F.floor(F.col("ordinal") / EVERY), F.lit(10)).alias("predicate"))
    return neighbors.shared_knn(base, queries, solved, own, 5, "L2", DIGITS)


_STORED_KNN_SQL = _FOUND_SQL.format(on="b.vec_id % 20 = 0 and a.vec_id % 3 <> 1", k=8)


@query(f"""with f as ({_KNN_SQL}), s as ({_STORED_KNN_SQL}),
      r as (select coalesce(f.query, s.query) query, coalesce(abs(f.distance - s.distance) <= 0.001, false) near from f full join s on s.query = f.query and s.rank = f.rank),
      h as (select f.query, count(*) hits from f join s using (query, ordinal) group by 1)
    select r.query, count(*) ranks, count(*) filter (where near) "within", coalesce(any_value(hits), 0) hits, round(coalesce(any_value(hits), 0) / count(*), 6) recall, bool_and(near) passed from r left join h using (query) group by r.query""")
def knn_verify_recall(spark, sf_dir):
    """Stored answers that lack two ranks of each query and a third of the base, judged by the exact ones."""
    base = _base(spark, sf_dir)
    stored = neighbors.knn_expression(base.where("ordinal % 3 <> 1"), _query_vectors(base), 8, "L2", DIGITS)
    return neighbors.verify(_knn(spark, sf_dir), stored).withColumn("recall", F.round("recall", DIGITS))


@query(f"with f as ({_KNN_SQL}) select ordinal, count(*) n from f group by ordinal")
def knn_hubness(spark, sf_dir):
    return neighbors.hubness(_knn(spark, sf_dir))


@query(f"with f as ({_KNN_SQL}) select query, rank, ordinal, round(embedding[1]::double, 6) x from f join embeddings on vec_id = ordinal")
def neighbor_dereference(spark, sf_dir):
    base = _base(spark, sf_dir)
    facet = neighbors.facets(_knn(spark, sf_dir))
    return neighbors.dereference(facet, base).select("query", "rank", "ordinal", F.round(F.col("vector")[0].cast("double"), DIGITS).alias("x"))


_SHARES = (("quarter", 4), ("half", 2), ("whole", 1))


@query(" union all ".join(f"select '{name}' profile, * from ({_FOUND_SQL.format(on=f'b.vec_id % 20 = 0 and a.vec_id < (select max(vec_id) + 1 from embeddings) // {part}', k=3)})" for name, part in _SHARES))
def verify_profiles(spark, sf_dir):
    """Profiles of a quarter, half and all of the base, whatever its size."""
    base = _base(spark, sf_dir)
    n = (base.agg(F.max("ordinal")).first()[0] or 0) + 1
    return neighbors.verify_profiles(base, _query_vectors(base), {name: n // part for name, part in _SHARES}, 3, "L2", DIGITS)



@query("select vec_id ordinal, row_number() over (order by embedding)::bigint place from embeddings")
def vector_sort(spark, sf_dir):
    """Components in order; all vectors here have one length, so that the rule for prefixes plays no part."""
    return xvec.dense(_base(spark, sf_dir).select(F.col("ordinal").alias("row"), "vector"), "vector", "row").select(F.col("row").alias("ordinal"), (F.col("ordinal") + 1).alias("place"))


# --- windows, batches, splits --------------------------------------------------------------------------------------


@query("select vec_id - 100 ordinal, label from embeddings where vec_id between 100 and 300")
def window_slice(spark, sf_dir):
    return windows.Window.of("100..300").apply(_base(spark, sf_dir)).select("ordinal", "label")


@query("select vec_id - 200 ordinal, label from embeddings where vec_id >= 200 and vec_id < 250 union all select vec_id - 10 + 50, label from embeddings where vec_id between 10 and 40 union all select vec_id - 240 + 81, label from embeddings where vec_id = 240")
def window_multi(spark, sf_dir):
    return windows.Window.of(["[200..250)", "[10..40]", "[240]"]).apply(_base(spark, sf_dir)).select("ordinal", "label")


@query("select n || '' profile, (select count(*) from embeddings where vec_id < n) n from (values (100), (200), (300), (400), (500)) t(n)")
def sized_profile_counts(spark, sf_dir):
    """Rows of each profile of 100..500/100, all counted in one scan."""
    sizes = windows.sized_profiles(["100..500/100u"])
    base = _base(spark, sf_dir)
    counts = base.agg(*[F.count_if(F.col("ordinal") < n).alias(name) for name, n in sizes.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in sizes]), F.array(*[F.col(f"`{n}`") for n in sizes]))).alias("profile", "n"))


@query("select * from (values ('1M', 0::bigint, 1000000::bigint), ('0..1000', 0, 1001), ('0..1_000', 0, 1001), ('0..1M', 0, 1000001), ('[0..1000)', 0, 1000), ('[0..100]', 0, 101), ('(5..10)', 6, 10), ('[7]', 7, 8)) t(spec, lo, hi)")
def interval_grammar(spark, sf_dir):
    specs = ["1M", "0..1000", "0..1_000", "0..1M", "[0..1000)", "[0..100]", "(5..10)", "[7]"]
    return spark.createDataFrame([(s, windows.Interval.parse(s).lo, windows.Interval.parse(s).hi) for s in specs], "spec string, lo long, hi long")


@query("select p position, r ordinal, o_orderstatus status from (select i p, (i * 7919) % 20000 r from range(1000) t(i)) left join orders on o_orderkey = r")
def batch_get(spark, sf_dir):
    requests = spark.range(1000).select(F.col("id").alias("position"), (F.col("id") * 7919 % 20000).alias("ordinal"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("status"))
    return neighbors.batch_get(requests, orders).select("position", "ordinal", "status")


_SHUFFLE_SQL = "select vec_id, label, row_number() over (order by ((vec_id + 42) * 48271) % 2147483647, vec_id)::bigint - 1 place from embeddings"


@query(f"select place ordinal, label from ({_SHUFFLE_SQL}) where place >= 50 and place < 150")
def extract_shuffle(spark, sf_dir):
    base = _base(spark, sf_dir)
    return generators.extract(base, generators.shuffled(base, 42), 50, 150).select((F.col("ordinal") + 50).alias("ordinal"), "label")


@query(f"select case when place < 50 then 'query' else 'base' end role, case when place < 50 then place else place - 50 end ordinal, label from ({_SHUFFLE_SQL})")
def split_train_query(spark, sf_dir):
    base, queries = generators.split_queries(_base(spark, sf_dir), 50, 42)
    return queries.select(F.lit("query").alias("role"), "ordinal", "label").unionByName(base.select(F.lit("base").alias("role"), "ordinal", "label"))


# --- statistics ----------------------------------------------------------------------------------------------------

_UNNESTED = "select generate_subscripts(embedding, 1)::int - 1 dim, unnest(embedding)::double x from embeddings"


@query(f"select dim, count(*) n, round(avg(x), 6) mean, round(var_pop(x), 6) variance, min(x) lo, max(x) hi from ({_UNNESTED}) group by dim")
def vec_dim_stats(spark, sf_dir):
    s = statistics.dimension_stats(_base(spark, sf_dir))
    return s.select("dim", "n", F.round("mean", DIGITS).alias("mean"), F.round("variance", DIGITS).alias("variance"), "lo", "hi")


@query("""select dim, round((sum((x - m) ^ 3) / count(*)) / sd ^ 3, 5) skewness, round((sum((x - m) ^ 4) / count(*)) / sd ^ 4 - 3, 5) kurtosis
    from (select *, avg(x) over (partition by dim) m, stddev_pop(x) over (partition by dim) sd from (%s)) group by dim, m, sd""" % _UNNESTED)
def vec_dim_shape(spark, sf_dir):
    return statistics.dimension_stats(_base(spark, sf_dir)).select("dim", F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"))


@query("select vec_id ordinal, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) norm from embeddings")
def vec_norms(spark, sf_dir):
    return _base(spark, sf_dir).select("ordinal", F.round(distances.norm(F.col("vector")), DIGITS).alias("norm"))


@query("select count(*)::bigint \"rows\", min(len(embedding))::bigint min_dim, max(len(embedding))::bigint max_dim, count(*) filter (where list_max(embedding) = 0 and list_min(embedding) = 0)::bigint zeros, min(list_min(embedding))::double lo, max(list_max(embedding))::double hi from embeddings")
def vec_describe(spark, sf_dir):
    return statistics.describe(_base(spark, sf_dir)).select("rows", "min_dim", "max_dim", "zeros", "lo", "hi")


@query("select not bool_or(list_max(embedding) = 0 and list_min(embedding) = 0) is_zero_vector_free, count(*) = count(distinct embedding) is_duplicate_vector_free, bool_and(abs(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) - 1) <= 0.001) is_normalized from embeddings")
def vec_checks(spark, sf_dir):
    return statistics.checks(_base(spark, sf_dir))


def _halved(spark, sf_dir):
    """Vectors cut to the sign of their first four components, with a zero for the label 0: duplicates and zeros."""
    cut = F.transform(F.slice("vector", 1, 4), lambda x: F.when(F.col("label") == 0, F.lit(0)).otherwise(F.when(x > 0, 1).otherwise(-1)))
    return _base(spark, sf_dir).select("ordinal", cut.alias("vector"))


_HALVED = "select vec_id ordinal, list_transform(embedding[1:4], lambda x: case when label = 0 then 0 when x > 0 then 1 else -1 end) v from embeddings"


@query(f"select min(ordinal) ordinal, count(*) n from ({_HALVED}) group by v having count(*) > 1")
def vec_duplicates(spark, sf_dir):
    return statistics.duplicates(_halved(spark, sf_dir))


@query(f"select min(ordinal) ordinal, sum(v[1])::bigint // count(*) x from ({_HALVED}) where list_max(v) <> 0 or list_min(v) <> 0 group by v")
def dedup_vectors(spark, sf_dir):
    return statistics.cleaned(_halved(spark, sf_dir)).select("ordinal", F.col("vector")[0].cast("long").alias("x"))


@query(f"select count(*) n from ({_HALVED}) where list_max(v) = 0 and list_min(v) = 0")
def zero_count(spark, sf_dir):
    return _halved(spark, sf_dir).where(statistics.is_zero(F.col("vector"))).agg(F.count("*").alias("n"))


@query("""with b as (select min(v) lo, greatest(1, ceil((max(v) - min(v) + 1) / 10.0)::bigint) w from (select l_quantity::bigint v from lineitem))
    select least((l_quantity::bigint - lo) // w, 9) bucket, lo + least((l_quantity::bigint - lo) // w, 9) * w lo, lo + (least((l_quantity::bigint - lo) // w, 9) + 1) * w hi, count(*) n
    from lineitem, b group by lo, w, least((l_quantity::bigint - lo) // w, 9)""")
def histogram_equal_width(spark, sf_dir):
    return statistics.histogram(_table(spark, sf_dir, "lineitem"), "l_quantity")


@query("""with e as (select l_extendedprice x, count(*) filter (where l_returnflag = 'R') c1, count(*) filter (where l_returnflag = 'A') c2 from lineitem where l_returnflag in ('R', 'A') group by 1),
      r as (select sum(c1) over (order by x) r1, sum(c2) over (order by x) r2, sum(c1) over () n1, sum(c2) over () n2 from e)
    select n1::bigint n1, n2::bigint n2, round(max(abs(r1 / n1 - r2 / n2)), 6) d, round(1.36 * sqrt((n1 + n2) / (n1::double * n2)), 6) critical, max(abs(r1 / n1 - r2 / n2)) <= 1.36 * sqrt((n1 + n2) / (n1::double * n2)) same from r group by n1, n2""")
def ks_two_sample(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"))
    out = statistics.ks_two_sample(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"))
    return out.select("n1", "n2", F.round("d", DIGITS).alias("d"), F.round("critical", DIGITS).alias("critical"), "same")


@query("select count(*) records, min(octet_length(encode(text)))::bigint min_bytes, round(avg(octet_length(encode(text))), 6) avg_bytes, max(octet_length(encode(text)))::bigint max_bytes from documents")
def record_sizes(spark, sf_dir):
    s = statistics.record_sizes(_table(spark, sf_dir, "documents"), "text")
    return s.select("records", "min_bytes", F.round("avg_bytes", DIGITS).alias("avg_bytes"), "max_bytes")


@query("select min(p_size)::varchar || 'to' || max(p_size)::varchar \"range\" from part")
def attribute_range(spark, sf_dir):
    return statistics.attribute_range(_table(spark, sf_dir, "part"), "p_size")


@query("select bit_or(1::bigint << n_regionkey) mask from nation")
def feature_bitmask(spark, sf_dir):
    return statistics.bitmask(_table(spark, sf_dir, "nation"), "n_regionkey")


@query("select case when bool_and(json_valid(props)) then 'json' else 'text' end kind from events")
def content_type(spark, sf_dir):
    return statistics.content_type(_table(spark, sf_dir, "events"), "props")


@query("select case when min(gap) < 0 then 'non-monotonic' when max(gap) > 0 then 'sparse' else 'strict' end ordinals from (select o_orderkey - lag(o_orderkey + 1) over (order by o_orderkey) gap from orders)")
def ordinal_monotonicity(spark, sf_dir):
    # Orders in blocks of a thousand keys stand for pages; a block is a page of the records from its first to its last key.
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    pages = orders.groupBy(F.floor(F.col("k") / 1000).alias("page")).agg(F.min("k").alias("first"), F.count("*").alias("records"))
    return statistics.monotonicity(pages)


# --- tags, literals, hashes ----------------------------------------------------------------------------------------

_TAGS = [("k", "all(k)"), ("regex", "all(k:[1-3].*)"), ("any", "any(k:7.*,z)"), ("none", "none(k=[0-4].*)"), ("plural", "ks:9")]


@query("""with t as (select event_id, json_extract_string(props, '$.k') k from events)
    select event_id, 'k' "filter" from t where k is not null union all select event_id, 'regex' from t where regexp_full_match(k, '[1-3].*')
    union all select event_id, 'any' from t where regexp_full_match(k, '7.*') union all select event_id, 'none' from t where not coalesce(regexp_full_match(k, '[0-4].*'), false)
    union all select event_id, 'plural' from t where k = '9'""")
def tag_filter_any_all_none(spark, sf_dir):
    tags = F.from_json("props", "map<string,string>")
    hits = F.array_compact(F.array(*[F.when(TagFilter.parse(s).column(tags), F.lit(n)) for n, s in _TAGS]))
    return _table(spark, sf_dir, "events").select("event_id", F.explode(hits).alias("filter"))


_LITERALS = ["12b", "1234567890", "12L", "12s", "12", "-12", "12i", "1.5", "123.45678", "1.5f", "2d", "x1", "", "1e5"]


@query("select * from (values " + ", ".join(f"('{v}', '{t}')" for v, t in zip(_LITERALS, ["BYTE", "LONG", "LONG", "SHORT", "INT", "INT", "INT", "FLOAT", "DOUBLE", "FLOAT", "DOUBLE", "STRING", "STRING", "STRING"])) + ") t(literal, type)")
def literal_typing(spark, sf_dir):
    return spark.createDataFrame([(v,) for v in _LITERALS], "literal string").select("literal", literals.literal_type_column(F.col("literal")).alias("type"))


@query("""select doc_id, c chunk, c * 1024 start, least((c + 1) * 1024, n) "end", sha256(d[(c * 1024 + 1):least((c + 1) * 1024, n)]) hash
    from (select doc_id, encode(text) d, octet_length(encode(text)) n, unnest(range((octet_length(encode(text)) + 1023) // 1024)) c from documents where text <> '')""")
def chunk_hashes(spark, sf_dir):
    """Chunk hashes of the bytes of all texts; a chunk may end within a character."""
    return integrity.content_chunks(_table(spark, sf_dir, "documents"), "doc_id", "text", 1024)


@query("""with recursive leaves as (select list(sha256(coalesce(text, '')) order by doc_id) h from documents),
      padded as (select h || list_transform(range(0, (2 ^ ceil(log2(greatest(len(h), 1))))::bigint - len(h)), lambda i: repeat('00', 32)) h from leaves),
      up(h) as (select h from padded union all select list_transform(range(0, len(h) // 2), lambda i: sha256(unhex(h[2 * i + 1] || h[2 * i + 2]))) from up where len(h) > 1)
    select h[1] hash from up where len(h) = 1""")
def chunk_hash_root(spark, sf_dir):
    """The Merkle root over the documents' own hashes, in the order of their ids: a leaf for each document."""
    leaves = xvec.dense(_table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash")), "doc_id", "hash")
    return integrity.root(leaves.select(F.col("ordinal").alias("chunk"), "hash"), leaves.count())


@query("select doc_id chunk from documents where upper(text) <> text")
def merkle_diff(spark, sf_dir):
    hashes = lambda c: _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), F.sha2(c.cast("binary"), 256).alias("hash"))
    return integrity.mismatches(hashes(F.col("text")), hashes(F.upper("text")))


@query("select event_id, json_extract_string(props, '$.k')::bigint k from events where json_extract_string(props, '$.k')::bigint >= 50")
def json_select(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return _table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 50")


# --- generators ----------------------------------------------------------------------------------------------------


@query("select i tenth, 32000::bigint n, true near from range(10) t(i)")
def generate_vectors(spark, sf_dir):
    """Components of uniform vectors by tenths of their range: each is near a tenth of all."""
    x = windows.flattened(generators.random_vectors(spark, 10_000, 32)).select(F.col("vector").cast("double").alias("x")).where("x >= 0 and x < 1")
    counts = x.groupBy(F.floor(F.col("x") * 10).cast("long").alias("tenth")).agg(F.count("*").alias("c"))
    return counts.select("tenth", (F.round(F.col("c") / 2000) * 2000).cast("long").alias("n"), (F.abs(F.col("c") - 32_000) < 1_000).alias("near"))


@query("select 10000::bigint \"rows\", 500::bigint zeros, true copies")
def generate_gaussian(spark, sf_dir):
    facet = generators.gaussian_vectors(spark, 10_000, 16, zeroes=0.05, dups=0.1)
    copies = facet.where(~statistics.is_zero(F.col("vector"))).groupBy("vector").count().agg((F.sum(F.col("count") - 1) == 1000).alias("copies"))
    return statistics.describe(facet).select("rows", "zeros").crossJoin(copies)


@query()
def generate_predicated(spark, sf_dir):
    return solve(generators.metadata_records(spark, 10_000), generators.random_predicates(20))


@query()
def model_fit(spark, sf_dir):
    return statistics.fit_models(_base(spark, sf_dir)).select("dim", "family", F.round("distance", 4).alias("distance"))


@query(f"select distinct dim, 5000::bigint n, true near from ({_UNNESTED})")
def generate_from_model(spark, sf_dir):
    """Values drawn from each dimension's model: their number, and whether their mean is near that of the values it was fitted on."""
    models = statistics.fit_models(_base(spark, sf_dir))
    of = statistics.dimension_stats(_base(spark, sf_dir)).select("dim", F.col("mean").alias("m"), F.sqrt("variance").alias("s"))
    drawn = statistics.dimension_stats(generators.from_models(spark, models, 5_000)).join(F.broadcast(of), "dim")
    return drawn.select("dim", "n", (F.abs(F.col("mean") - F.col("m")) < 0.2 * F.col("s")).alias("near"))
