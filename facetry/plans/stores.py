"""Registered queries over files and stores: each writes given tables with a sink, reads them back with a source, and
returns what came back, beside the SQL of the table itself.

Files lie in a new folder of the shared store; every query takes its whole tables.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import literals, records, units
from ..functions.records import Field, MetadataLayout, Record
from ..operators import integrity, predicates, statistics, windows
from ..operators.predicates import all_of, any_of, leaf
from ..operators.tags import TagFilter
from ..sources import datasets, slab, sqlite, storage, xvec
from .registry import _base, _solved_sql, _table, query

# --- vector files --------------------------------------------------------------------------------------------------

#: How each format's vectors are drawn from the embeddings, in Spark and in SQL; half floats hold these exactly.
_KINDS = {
    "fvec": (lambda x: x.cast("float"), "x::float"),
    "dvec": (lambda x: x.cast("double") / 3, "x::double / 3"),
    "ivec": (lambda x: F.floor(x.cast("double") * 100000).cast("int"), "floor(x::double * 100000)::int"),
    "svec": (lambda x: F.floor(x.cast("double") * 1000).cast("smallint"), "floor(x::double * 1000)::smallint"),
    "bvec": (lambda x: F.floor(F.least(F.abs(x.cast("double")), F.lit(1.0)) * 255).cast("smallint"), "floor(least(abs(x::double), 1) * 255)::smallint"),
    "mvec": (lambda x: (F.floor(x.cast("double") * 64) / 64).cast("float"), "(floor(x::double * 64) / 64)::float"),
}


def _summed(df, kind: str):
    total = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return df.select(F.lit(kind).alias("kind"), "ordinal", F.size("vector").cast("long").alias("n"), F.element_at("vector", 1).cast("double").alias("first"), F.element_at("vector", -1).cast("double").alias("last"), F.round(total, 5).alias("total"))


@query(" union all ".join(f"select '{k}' kind, vec_id ordinal, len(v)::bigint n, v[1]::double \"first\", v[-1]::double \"last\", round(list_sum(list_transform(v, lambda y: y::double)), 5) total from (select vec_id, list_transform(embedding, lambda x: {sql}) v from embeddings)" for k, (_, sql) in _KINDS.items()))
def xvec_round_trip(spark, sf_dir):
    """Vector files of each element type, written in parts and read again."""
    base, out = _base(spark, sf_dir), None
    for kind, (cast, _) in _KINDS.items():
        folder = storage.shared_folder(spark, f"xvec-{kind}")
        xvec.write(base.select("ordinal", F.transform("vector", cast).alias("vector")), folder, kind)
        back = _summed(xvec.read(spark, folder, kind), kind)
        out = back if out is None else out.unionByName(back)
    return out


@query("select vec_id - 100 ordinal, embedding[1]::double \"first\" from embeddings where vec_id between 100 and 299")
def xvec_window(spark, sf_dir):
    """A window of a vector folder: the reader opens only its byte ranges."""
    folder = storage.shared_folder(spark, "xvec-window")
    xvec.write(_base(spark, sf_dir), folder, "fvec")
    return xvec.read(spark, folder, "fvec", window="[100..300)").select("ordinal", F.col("vector")[0].cast("double").alias("first"))


@query("select len(v)::bigint n, v[1] \"first\", v[-1] \"last\", list_sum(v)::bigint total from (select list_transform(embedding, lambda x: floor(x::double * 1000)::int) v from embeddings)")
def csv_json_vectors(spark, sf_dir):
    """Vectors of CSV files in which one column holds JSON arrays."""
    folder = storage.shared_folder(spark, "csv")
    array = F.to_json(F.transform("vector", lambda x: F.floor(x.cast("double") * 1000).cast("int")))
    _base(spark, sf_dir).select("ordinal", array.alias("vec"), "label").write.option("header", True).option("quote", '"').option("escape", '"').csv(folder)
    total = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x)
    return xvec.read_json_csv(spark, folder, "int").select(F.size("vector").cast("long").alias("n"), F.element_at("vector", 1).alias("first"), F.element_at("vector", -1).alias("last"), total.alias("total"))


@query("select vec_id ordinal, embedding[1]::double \"first\" from embeddings")
def parquet_vectors(spark, sf_dir):
    """Vectors of Parquet files in reading order: numbered by file and row without one task for all."""
    folder = storage.shared_folder(spark, "parquet")
    _base(spark, sf_dir).repartitionByRange("ordinal").sortWithinPartitions("ordinal").select(F.col("vector").alias("emb")).write.parquet(folder)
    paths = [f for group in xvec.ordered_groups(storage.files(folder, (".parquet",))) for f in group]
    return xvec.dense(xvec.read_parquet(spark, paths), "file", "place").select("ordinal", F.col("vector")[0].cast("double").alias("first"))


_MANIFEST = """
attributes: {distance_function: l2, model: m1}
profiles:
  default: {base: base.fvec, maxk: 5}
  cut: {train: {source: base.fvec, window: "[5..25]"}}
  sized: {ranges: [100..300/100u], facets: {base: "base.fvec${range}"}}
  own: {base: base.fvec, base_count: 40}
"""


@query("""select p profile, vec_id - lo ordinal, embedding[1]::double "first" from embeddings,
    (values ('default', 0, 9223372036854775807), ('cut', 5, 26), ('100', 0, 100), ('200', 0, 200), ('300', 0, 300), ('own', 0, 40)) t(p, lo, hi) where vec_id >= lo and vec_id < hi""")
def manifest_facets(spark, sf_dir):
    """The base facet of every profile of a manifest: default, windowed, sized and counted."""
    home = storage.shared_folder(spark, "manifest")
    xvec.write(_base(spark, sf_dir), f"{home}/base.fvec", "fvec")
    with storage.open_write(f"{home}/dataset.yaml") as f:
        f.write(_MANIFEST.encode())
    data = datasets.Dataset.load(home)
    out = None
    for name in ("default", "cut", "100", "200", "300", "own"):
        facet = data.facet(spark, "base", name).select(F.lit(name).alias("profile"), "ordinal", F.col("vector")[0].cast("double").alias("first"))
        out = facet if out is None else out.unionByName(facet)
    return out


@query("select vec_id * 64 + i ordinal, embedding[i + 1]::double x from embeddings, range(64) t(i)")
def vectors_flattened(spark, sf_dir):
    return windows.flattened(_base(spark, sf_dir).where("vector is not null")).select((F.col("ordinal") * 64 + F.col("position")).alias("ordinal"), F.col("vector").cast("double").alias("x"))


# --- slab stores ---------------------------------------------------------------------------------------------------


def _customers(spark, sf_dir):
    """Customers as records of bytes: a namespace for each segment, their keys as ordinals."""
    return _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("namespace"), F.col("c_custkey").cast("long").alias("ordinal"), F.encode("c_name", "utf-8").alias("data"))


def _store(spark, sf_dir):
    folder = storage.shared_folder(spark, "slab")
    slab.write_parts(_customers(spark, sf_dir), folder)
    return folder


@query("select c_mktsegment namespace, c_custkey::bigint ordinal, c_name data from customer")
def slab_round_trip(spark, sf_dir):
    """Records of several namespaces, written by all tasks as stores of their own and read by runs of pages."""
    return slab.read(spark, _store(spark, sf_dir)).select("namespace", "ordinal", F.col("data").cast("string").alias("data"))


@query("select c_mktsegment namespace, c_custkey::bigint ordinal, c_name data from customer where c_mktsegment = 'BUILDING' and c_custkey >= 100 and c_custkey < 900")
def slab_range(spark, sf_dir):
    """One namespace and a range of ordinals: pages outside aren't read."""
    return slab.read(spark, _store(spark, sf_dir), "BUILDING", 100, 900).select("namespace", "ordinal", F.col("data").cast("string").alias("data"))


@query("select i position, 'BUILDING' namespace, (i * 7919) % 2000 ordinal, c_name data from range(1000) t(i) left join customer on c_custkey = (i * 7919) % 2000 and c_mktsegment = 'BUILDING'")
def slab_batch_get(spark, sf_dir):
    """The record of each of a thousand requests, null where the namespace lacks the ordinal."""
    requests = spark.range(1000).select(F.col("id").alias("position"), F.lit("BUILDING").alias("namespace"), (F.col("id") * 7919 % 2000).alias("ordinal"))
    return slab.lookup(slab.read(spark, _store(spark, sf_dir), "BUILDING"), requests).select("position", "namespace", "ordinal", F.col("data").cast("string").alias("data"))


@query("""select c_mktsegment namespace, count(*) records, min(c_custkey)::bigint "first", max(c_custkey)::bigint "last",
      case when max(c_custkey) - min(c_custkey) + 1 > count(*) then 'sparse' else 'strict' end ordinals,
      min(strlen(c_name))::bigint min_bytes, round(avg(strlen(c_name)), 6) avg_bytes, max(strlen(c_name))::bigint max_bytes, 'text' content
    from customer group by c_mktsegment
    union all select 'events', count(*), min(event_id)::bigint, max(event_id)::bigint, case when max(event_id) - min(event_id) + 1 > count(*) then 'sparse' else 'strict' end,
      min(strlen(props))::bigint, round(avg(strlen(props)), 6), max(strlen(props))::bigint, case when bool_and(json_valid(props)) then 'json' else 'text' end from events""")
def slab_analyze(spark, sf_dir):
    """Sizes, ordinals and content of every namespace of stores."""
    folder = _store(spark, sf_dir)
    events = _table(spark, sf_dir, "events").select(F.lit("events").alias("namespace"), F.col("event_id").alias("ordinal"), F.encode("props", "utf-8").alias("data"))
    slab.write_parts(events, folder)
    return slab.analyze(slab.read(spark, folder)).withColumn("avg_bytes", F.round("avg_bytes", 6))


@query("select c_custkey::bigint ordinal, lower(hex(c_name)) h, to_base64(encode(c_name)) b, c_name || chr(10) t, c_name u from customer where c_mktsegment = 'MACHINERY'")
def slab_export(spark, sf_dir):
    """Export formats of the records of a namespace."""
    rows = slab.read(spark, _store(spark, sf_dir), "MACHINERY")
    out = None
    for name, kind in (("h", "hex"), ("b", "base64"), ("t", "text"), ("u", "utf8")):
        part = slab.export(rows, kind).select("ordinal", F.col("out").cast("string").alias(name))
        out = part if out is None else out.join(part, "ordinal")
    return out


@query("select 'all' part, n_nationkey::bigint ordinal, n_name data from nation union all select 'after', n_nationkey + (select max(n_nationkey) + 1 from nation), upper(n_name) || '!' from nation")
def slab_append_rewrite(spark, sf_dir):
    """A store of one file: written, appended to, packed anew and checked."""
    home = storage.shared_folder(spark, "slab-one")
    nation = _table(spark, sf_dir, "nation")
    slab.write_frame(nation.select(F.lit("").alias("namespace"), F.col("n_nationkey").cast("long").alias("ordinal"), F.encode("n_name", "utf-8").alias("data")), f"{home}/a.slab")
    # The 25 nations of the fixed table.
    first = slab.append(f"{home}/a.slab", [f"{r['n_name'].upper()}!".encode() for r in nation.orderBy("n_nationkey").collect()])
    slab.rewrite(f"{home}/a.slab", f"{home}/b.slab")
    if slab.check(f"{home}/b.slab"):
        raise ValueError(f"faults in {home}/b.slab")
    return slab.read(spark, f"{home}/b.slab").select(F.when(F.col("ordinal") < first, "all").otherwise("after").alias("part"), "ordinal", F.col("data").cast("string").alias("data"))


@query("select event_id::bigint ordinal, props data from events")
def slab_import_lines(spark, sf_dir):
    """Lines of JSON from text files, numbered in the order of a key, as records of a store."""
    folder, target = storage.shared_folder(spark, "lines"), storage.shared_folder(spark, "slab-lines")
    _table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "props")).alias("value")).write.text(folder)
    lines = spark.read.text(folder).select(F.from_json("value", "event_id long, props string").alias("r"))
    slab.write_parts(lines.select(F.lit("").alias("namespace"), F.col("r.event_id").alias("ordinal"), F.encode("r.props", "utf-8").alias("data")), target)
    return slab.read(spark, target).select("ordinal", F.col("data").cast("string").alias("data"))


# --- predicates and records in stores ------------------------------------------------------------------------------

_STORED = [
    (0, all_of(leaf("p_size", "GE", 10), leaf("p_size", "LT", 20))), (1, any_of(leaf("p_brand", "EQ", "Brand#11"), leaf("p_type", "MATCHES", "PROMO .*"))), (2, leaf("p_retailprice", "GT", 1500.25)),
    (3, leaf("p_size", "IN", 1, 2, 3)), (4, all_of(leaf("p_size", "NE", 7), any_of(leaf("p_brand", "EQ", "Brand#12"), leaf("p_type", "GE", "STANDARD")))),
]
_STORED_SQL = ["p_size >= 10 and p_size < 20", "p_brand = 'Brand#11' or regexp_full_match(p_type, 'PROMO .*')", "p_retailprice > 1500.25::double", "p_size in (1, 2, 3)", "p_size <> 7 and (p_brand = 'Brand#12' or p_type >= 'STANDARD')"]


def _framed(spark):
    return [(i, predicates.frame(node)) for i, node in _STORED]


def _unframed(rows):
    """The predicates of a predicate facet: as many as its plan may hold, a few bytes each."""
    return [(r["ordinal"], predicates.unframe(bytes(r["data"]))) for r in rows.orderBy("ordinal").collect()]


@query(_solved_sql(_STORED_SQL, "part", "p_partkey"))
def pred_slab_facet(spark, sf_dir):
    """Predicates in binary form in a slab, read back and solved over the parts."""
    path = f"{storage.shared_folder(spark, 'predicates')}/p.slab"
    slab.write(path, [("predicates", i, raw) for i, raw in _framed(spark)])
    return predicates.solve(_table(spark, sf_dir, "part"), _unframed(slab.read(spark, path, "predicates")), "p_partkey")


@query(_solved_sql(_STORED_SQL, "part", "p_partkey"))
def pred_sqlite_facet(spark, sf_dir):
    """The same predicates in an SQLite store."""
    path = f"{storage.shared_folder(spark, 'sqlite')}/p.db"
    with storage.open_write(path):
        pass
    sqlite.write(path, "predicates", _framed(spark))
    return predicates.solve(_table(spark, sf_dir, "part"), _unframed(sqlite.read(spark, path, "predicates")), "p_partkey")


@query(f"select query, row_number() over (partition by query order by ordinal) - 1 position, ordinal from ({_solved_sql(_STORED_SQL, 'part', 'p_partkey')})")
def pred_result_indices(spark, sf_dir):
    """Result lists of predicates in their stored form, decoded again."""
    lists = predicates.result_indices(predicates.solve(_table(spark, sf_dir, "part"), _STORED, "p_partkey"))

    def encode(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([records.encode_results(x) for x in b.column(1).to_pylist()], pa.binary())], names=["ordinal", "data"])

    folder = storage.shared_folder(spark, "results")
    slab.write_parts(lists.mapInArrow(encode, "ordinal long, data binary").select(F.lit("").alias("namespace"), "ordinal", "data"), folder)
    found = records.results_frame(slab.read(spark, folder).select("ordinal", "data"))
    return found.select("query", F.posexplode("ordinals").alias("position", "ordinal")).select("query", F.col("position").cast("long").alias("position"), F.col("ordinal").cast("long").alias("ordinal"))


_LAYOUT = MetadataLayout((Field("p_name", "TEXT"), Field("p_size", "INT"), Field("p_retailprice", "FLOAT"), Field("small", "BOOL"), Field("third", "ENUM", ("none", "one", "two"))))


@query("select p_partkey::bigint ordinal, p_name, case when p_size % 7 <> 0 then p_size::bigint else -1 end p_size, p_retailprice::double p_retailprice, p_size < 10 small, ['none', 'one', 'two'][p_partkey % 3 + 1] third from part")
def metadata_layout_records(spark, sf_dir):
    """Parts as records of a fixed layout, with nulls, stored and decoded into columns."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("ordinal"), "p_name", F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"), (F.col("p_size") < 10).alias("small"), F.element_at(F.array(*map(F.lit, ("none", "one", "two"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("third"))
    folder = storage.shared_folder(spark, "metadata")
    slab.write_parts(records.encode_frame(part, _LAYOUT).select(F.lit("metadata_content").alias("namespace"), "ordinal", "data"), folder)
    with storage.open_write(f"{folder}/layout.bin") as f:
        f.write(_LAYOUT.encode())
    size = storage.size(f"{folder}/layout.bin")
    layout = MetadataLayout.decode(storage.read_range(f"{folder}/layout.bin", 0, size))
    return records.decode_frame(slab.read(spark, folder, "metadata_content").select("ordinal", "data"), layout).withColumn("p_size", F.coalesce("p_size", F.lit(-1)))


#: Records that a task encodes, where records are dealt out before they are.
_DEALT = 1 << 16


@query("select o_orderkey::bigint ordinal, o_orderstatus status, o_totalprice::double price, year(o_orderdate)::bigint \"year\", o_totalprice > 100000 large from orders")
def metadata_typed_records(spark, sf_dir):
    """Orders as self-describing records: printed, parsed, encoded and decoded again."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [[], [], [], []]
            for status, price, year, large in zip(*(c.to_pylist() for c in b.columns[1:])):
                r = records.decode(records.encode(records.parse_record(records.format_record(Record.of(status=status, price=price, year=year, large=large)))))
                fields = r.to_dict()
                for column, name in zip(out, ("status", "price", "year", "large")):
                    column.append(fields.get(name))
            yield pa.record_batch([b.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_())], names=["ordinal", "status", "price", "year", "large"])

    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("ordinal"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price"), F.year("o_orderdate").cast("long").alias("year"), (F.col("o_totalprice") > 100000).alias("large"))
    # Dealt by number: a file's row groups may hold millions of rows, and a record takes far longer than its shuffle.
    dealt = orders.repartition(max(1, -(-orders.count() // _DEALT)), "ordinal")
    return dealt.mapInArrow(run, "ordinal long, status string, price double, year long, large boolean")


_JSON = [(i, predicates.to_json(node)) for i, node in _STORED]


@query(_solved_sql(_STORED_SQL, "part", "p_partkey"))
def pred_json_round_trip(spark, sf_dir):
    """Predicates as JSON text, parsed again."""
    return predicates.solve(_table(spark, sf_dir, "part"), [(i, predicates.parse_json(json.loads(text))) for i, text in _JSON], "p_partkey")


@query(" union all ".join(f"select {i}::bigint query, p_partkey::bigint ordinal from part where {predicates.render_sql(node).replace('==', '=')}" for i, node in _STORED if i in (0, 2, 3, 4)))
def pred_render_sql_runs(spark, sf_dir):
    """Predicates against what their SQL rendering selects in another engine."""
    return predicates.solve(_table(spark, sf_dir, "part"), [(i, n) for i, n in _STORED if i in (0, 2, 3, 4)], "p_partkey")


# --- integrity and small parts -------------------------------------------------------------------------------------


@query("select 'base' facet, vec_id chunk from embeddings where vec_id % 97 = 0")
def merkle_file_diff(spark, sf_dir):
    """Chunks in which two vector files differ, one chunk for each record; every 97th record is changed."""
    home = storage.shared_folder(spark, "merkle")
    base = _base(spark, sf_dir)
    # Records of 60 components have 244 bytes; 3 more fill the chunk of a power of two: dimension, then 63 of 4 bytes.
    cut = base.select("ordinal", F.slice("vector", 1, 63).alias("vector"))
    changed = cut.select("ordinal", F.when(F.col("ordinal") % 97 == 0, F.transform("vector", lambda x: -x - 1)).otherwise(F.col("vector")).alias("vector"))
    hashes = []
    for name, facet in (("a", cut), ("b", changed)):
        xvec.write(facet, f"{home}/{name}", "fvec")
        n = xvec.assemble(f"{home}/{name}", f"{home}/{name}.fvec")
        hashes.append(integrity.file_chunks(spark, f"{home}/{name}.fvec", integrity.Shape.of(n, 256)))
    return integrity.mismatches(*hashes).select(F.lit("base").alias("facet"), "chunk")


@query("""select event_id, case when k is null then 'failed: filter k:[1-3].* on tag k=None' when regexp_full_match(k, '[1-3].*') then 'held: filter k:[1-3].* on tag k=''' || k || '''' else 'failed: filter k:[1-3].* on tag k=''' || k || '''' end said
    from (select event_id, json_extract_string(props, '$.k') k from events)""")
def tag_explanations(spark, sf_dir):
    """What a tag filter says of each event."""
    wanted = TagFilter.parse("all(k:[1-3].*)")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            said = [" ".join(wanted.explain({k: v for k, v in (json.loads(p) if p else {}).items() if k == "k"} if not p else {k: str(v) for k, v in json.loads(p).items()})) for p in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(said, pa.string())], names=["event_id", "said"])

    return _table(spark, sf_dir, "events").select("event_id", "props").mapInArrow(run, "event_id long, said string")


_COUNTS = [("1000", 1000), ("1_000", 1000), ("10m", 10 * 10**6), ("2^20", 2**20), ("1E6", 10**6), ("3k", 3000), ("2b", 2 * 10**9)]
_SIZES = [("1kb", 1000.0), ("1KiB", 1024.0), ("2MB", 2e6), ("1.5MiB", 1.5 * 2**20), ("7", 7.0)]


@query("select * from (values " + ", ".join([f"('count', '{t}', {n}::double)" for t, n in _COUNTS] + [f"('bytes', '{t}', {n}::double)" for t, n in _SIZES]) + ") t(kind, spec, x)")
def unit_grammar(spark, sf_dir):
    """Counts and sizes as they are written."""
    rows = [("count", t, float(units.count(t))) for t, _ in _COUNTS] + [("bytes", t, float(units.size_in_bytes(t))) for t, _ in _SIZES]
    return spark.createDataFrame(rows, "kind string, spec string, x double")


@query("select distinct 'dataset_' || regexp_replace(p_brand, '[^A-Za-z0-9_-]', '', 'g') || '_' || p_size::varchar || 'd' name from part")
def token_templates(spark, sf_dir):
    """File names from a template and the parts' attributes: one for each distinct pair."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([literals.templatize("dataset_[brand]_[size]d[none*]", {"brand": x, "size": n}) for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.string())], names=["name"])

    return _table(spark, sf_dir, "part").select("p_brand", "p_size").distinct().mapInArrow(run, "name string").distinct()


@query("""with c as (select l_returnflag f, l_quantity::double x from lineitem)
    select f, corr(p, q) > 0.999 alike, count(*) points from (
      select a.f, unnest(quantile_cont(a.x, [0.1, 0.25, 0.5, 0.75, 0.9])) p, unnest((select quantile_cont(x, [0.1, 0.25, 0.5, 0.75, 0.9]) from c)) q from c a group by a.f) group by f""")
def quantiles_alike(spark, sf_dir):
    """Whether the quantities of each return flag are spread like all quantities."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("double").alias("x"))
    out = None
    for flag in ("A", "N", "R"):
        found = statistics.quantile_correlation(rows.where(F.col("f") == flag), rows).select(F.lit(flag).alias("f"), (F.col("corr") > 0.999).alias("alike"), F.lit(5).cast("long").alias("points"))
        out = found if out is None else out.unionByName(found)
    return out
