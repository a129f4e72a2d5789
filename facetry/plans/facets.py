"""Registered queries over facets, profiles, stores' indexes and small value types, beside their SQL."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from ..functions import literals, records, units
from ..functions.records import Record, Tag, Ulid
from ..operators import integrity, neighbors, statistics, windows
from ..operators.predicates import all_of, leaf, resolve, solve
from ..sources import datasets, slab, storage, xvec
from . import steps
from .registry import _base, _knn, _KNN_SQL, _solved_sql, _table, query
from .stores import _store

# --- access to facets ----------------------------------------------------------------------------------------------


@query("select vec_id ordinal, embedding[1]::double \"first\" from embeddings where vec_id = 17 or (vec_id >= 40 and vec_id < 45)")
def facet_get(spark, sf_dir):
    """One ordinal, and a half-open range of them."""
    base = _base(spark, sf_dir)
    return windows.get(base, 17).unionByName(windows.get_range(base, 40, 45)).select("ordinal", F.col("vector")[0].cast("double").alias("first"))


@query("select vec_id ordinal, round(embedding[3]::double * 2 + 1, 6) x from embeddings")
def facet_mapped(spark, sf_dir):
    double = windows.mapped(_base(spark, sf_dir), lambda v: F.transform(v, lambda x: x.cast("double") * 2))
    return windows.mapped(double, lambda v: F.transform(v, lambda x: x + 1)).select("ordinal", F.round(F.col("vector")[2], 6).alias("x"))


@query("select vec_id ordinal, label from embeddings union all select vec_id + n, label + 100 from embeddings, (select max(vec_id) + 1 n from embeddings)")
def facets_concatenated(spark, sf_dir):
    base = _base(spark, sf_dir)
    n = base.agg(F.max("ordinal")).first()[0] + 1
    again = base.withColumn("label", F.col("label") + 100)
    return windows.concatenated((base, n), (again, n)).select("ordinal", F.col("label").cast("int").alias("label"))


@query("""with v as (select vec_id, list_transform(embedding[1:2], lambda x: case when x > 0 then 1 else 0 end) e from embeddings), w as (select e from v where vec_id = 123)
    select (select min(vec_id) from v join w using (e))::bigint "first", (select max(vec_id) from v join w using (e))::bigint "last", -1::bigint absent""")
def facet_index_of(spark, sf_dir):
    """The first and the last ordinal of a vector that many rows share, and of one that none has."""
    signs = windows.mapped(_base(spark, sf_dir), lambda v: F.transform(F.slice(v, 1, 2), lambda x: F.when(x > 0, 1).otherwise(0)))
    wanted = windows.get(signs, 123).first()["vector"]
    find = lambda v, last, name: windows.index_of(signs, v, last).withColumnRenamed("ordinal", name)
    return find(wanted, False, "first").crossJoin(find(wanted, True, "last")).crossJoin(find([7, 7], False, "absent"))


@query("select vec_id ordinal, i component, embedding[i + 1]::double x from embeddings, range(4, 9) t(i) where vec_id between 10 and 30")
def facet_slice(spark, sf_dir):
    """A range of ordinals by a range of components."""
    rows = windows.get_range(_base(spark, sf_dir), 10, 31)
    return windows.flattened(rows.select("ordinal", F.slice("vector", 5, 5).alias("vector"))).select("ordinal", (F.col("position") + 4).cast("long").alias("component"), F.col("vector").cast("double").alias("x"))


@query("select vec_id ordinal, embedding[1]::double \"first\", label, vec_id * 7 % 500 query from embeddings")
def facets_paired(spark, sf_dir):
    """Facets that belong together by position: vectors, labels and a third facet by their ordinals."""
    base = _base(spark, sf_dir)
    third = base.select("ordinal", (F.col("ordinal") * 7 % 500).alias("query"))
    return base.select("ordinal", F.col("vector")[0].cast("double").alias("first")).join(base.select("ordinal", "label"), "ordinal").join(third, "ordinal")


@query(f"with f as ({_KNN_SQL}) select query, rank, ordinal, 10 max_k from f where rank <= 4")
def neighbors_truncated(spark, sf_dir):
    """A neighbour facet cut to a smaller k, with the k that it had."""
    # Read twice, found once.
    facet = storage.written(neighbors.facets(_knn(spark, sf_dir)), "neighbors")
    short = neighbors.ranked(neighbors.truncated(facet, 4)).withColumnRenamed("value", "ordinal")
    return short.select("query", F.col("rank").cast("int").alias("rank"), "ordinal").crossJoin(neighbors.max_k(facet))


# --- stores' indexes -----------------------------------------------------------------------------------------------


@query("select c_mktsegment namespace, count(*) records, min(c_custkey)::bigint \"first\" from customer group by 1")
def slab_namespaces(spark, sf_dir):
    """The namespaces of a folder of stores, from their page indexes alone."""
    out = None
    for uri in storage.files(_store(spark, sf_dir), (".slab",)):
        pages = slab.pages_table(spark, uri)
        out = pages if out is None else out.unionByName(pages)
    return out.groupBy("namespace").agg(F.sum("records").alias("records"), F.min("first").alias("first"))


@query("select 'header' damage, true found union all select 'footer', true union all select 'none', false")
def slab_check(spark, sf_dir):
    """Whether a store's faults are found: one with a wrong page size in a header, one without its last bytes, and a sound one."""
    home = storage.shared_folder(spark, "slab-check")
    slab.write_frame(_table(spark, sf_dir, "nation").select(F.lit("").alias("namespace"), F.col("n_nationkey").cast("long").alias("ordinal"), F.encode("n_name", "utf-8").alias("data")), f"{home}/none.slab")
    raw = storage.read_range(f"{home}/none.slab", 0, storage.size(f"{home}/none.slab"))
    rows = []
    for name, bad in (("header", raw[:4] + b"\x01" + raw[5:]), ("footer", raw[:-20]), ("none", raw)):
        with storage.open_write(f"{home}/{name}.slab") as f:
            f.write(bad)
        rows.append((name, bool(slab.check(f"{home}/{name}.slab"))))
    return spark.createDataFrame(rows, "damage string, found boolean")


@query("select format, n::bigint n, bytes::bigint bytes from (values ('csv', 26, 0), ('jsonl', 25, 0), ('txt', 25, 0), ('bin', 25, 0)) t(format, n, zero), lateral (select case format when 'csv' then (select sum(strlen(n_nationkey::varchar || ',\"' || n_name || chr(10) || '\"' || chr(10))) + 9 from nation) when 'jsonl' then (select sum(strlen('{\"name\":\"' || n_name || '\"}' || chr(10))) from nation) else (select sum(strlen(n_name) + 1) from nation) end bytes) l")
def slab_imports(spark, sf_dir):
    """Records of files in several formats: CSV whose quotes run over lines, JSON lines, lines and NUL-ended strings."""
    home = storage.shared_folder(spark, "imports")
    names = [(r["n_nationkey"], r["n_name"]) for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    files = {
        "csv": "key,name\n" + "".join(f'{k},"{n}\n"\n' for k, n in names), "jsonl": "".join(json.dumps({"name": n}, separators=(",", ":")) + "\n" for _, n in names),
        "txt": "".join(f"{n}\n" for _, n in names), "bin": "".join(f"{n}\0" for _, n in names),
    }
    rows = []
    for kind, text in files.items():
        with storage.open_write(f"{home}/a.{kind}") as f:
            f.write(text.encode())
        slab.import_file(f"{home}/a.{kind}", f"{home}/{kind}.slab")
        found = [len(r) for _, _, r in slab.scan(slab.Store.open(f"{home}/{kind}.slab"))]
        rows.append((kind, len(found), sum(found)))
    return spark.createDataFrame(rows, "format string, n long, bytes long")


# --- predicates by number, records, values -------------------------------------------------------------------------


@query(_solved_sql(["p_size >= 40 and p_brand = 'Brand#13'"], "part", "p_partkey"))
def pred_numbered_fields(spark, sf_dir):
    """Fields by number, resolved against the columns' names before they are compared."""
    part = _table(spark, sf_dir, "part")
    names = part.columns
    node = all_of(leaf(names.index("p_size"), "GE", 40), leaf(names.index("p_brand"), "EQ", "Brand#13"))
    return solve(part, [(0, resolve(node, names))], "p_partkey")


_FORMS = "case when o_orderstatus = 'F' then 'closed' when o_orderstatus = 'O' then 'open' else 'other' end"


@query(f"select {_FORMS} form, count(*) n, sum(o_custkey::bigint)::bigint keys from orders group by 1")
def record_forms(spark, sf_dir):
    """Records of three forms, told apart by their fingerprints; a field read as a wider type."""
    samples = {"closed": Record((("key", Tag.INT, 0), ("name", Tag.STRING, ""))), "open": Record((("key", Tag.SHORT, 0),)), "other": Record((("key", Tag.LONG, 0), ("at", Tag.DOUBLE, 0.0)))}
    prints = {r.fingerprint(): name for name, r in samples.items()}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found, keys = [], []
            for status, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if status == "F":
                    r = Record((("key", Tag.INT, key), ("name", Tag.STRING, status)))
                elif status == "O":
                    r = Record((("key", Tag.SHORT, key % 30_000),))
                else:
                    r = Record((("key", Tag.LONG, key), ("at", Tag.DOUBLE, 0.5)))
                r = records.decode(records.encode(r))
                found.append(prints[r.fingerprint()])
                keys.append(r.typed("key", Tag.LONG) + (key // 30_000 * 30_000 if status == "O" else 0))
            yield pa.record_batch([pa.array(found, pa.string()), pa.array(keys, pa.int64())], names=["form", "key"])

    rows = _table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_custkey").cast("long")).mapInArrow(run, "form string, key long")
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("select n_nationkey::bigint ordinal, r_name name from nation join region on r_regionkey = n_regionkey")
def record_enum_names(spark, sf_dir):
    """Enum fields that hold a number, by their names."""
    names = tuple(r["r_name"] for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [Record((("region", Tag.ENUM_ORD, k),), (("region", names),)).enum_name("region") for k in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, pa.string())], names=["ordinal", "name"])

    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ordinal"), F.col("n_regionkey").cast("long")).mapInArrow(run, "ordinal long, name string")


@query("select o_orderkey::bigint ordinal, epoch_ms(o_orderdate::timestamp)::bigint millis, true same, true ascends from orders")
def record_ulids(spark, sf_dir):
    """ULIDs of order dates and keys: printed, parsed, their time, and their order beside the next moment's."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            millis, same, ascends = [], [], []
            for key, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one = Ulid(at.to_bytes(6, "big") + key.to_bytes(10, "big"))
                back = Ulid.parse(str(one).lower())
                millis.append(back.millis)
                same.append(back == one)
                ascends.append(one < Ulid((at + 1).to_bytes(6, "big") + bytes(10)))
            yield pa.record_batch([b.column(0), pa.array(millis, pa.int64()), pa.array(same), pa.array(ascends)], names=["ordinal", "millis", "same", "ascends"])

    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("ordinal"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return orders.mapInArrow(run, "ordinal long, millis long, same boolean, ascends boolean")


@query("select * from (values ('(int) 5', 'INT', 5.0::double), ('7b', 'BYTE', 7), ('1234567890', 'LONG', 1234567890), ('2.5f', 'FLOAT', 2.5), ('(double)1', 'DOUBLE', 1)) t(spec, kind, x)")
def attribute_values(spark, sf_dir):
    """Typed attribute values as they are written."""
    specs = ["(int) 5", "7b", "1234567890", "2.5f", "(double)1"]
    return spark.createDataFrame([(s, literals.Attribute.parse(s).type, float(literals.Attribute.parse(s).value)) for s in specs], "spec string, kind string, x double")


@query("select * from (values ('/a/b:c', '/a/b', 'c'), ('.x', '/', 'x'), ('/g.y', '/g', 'y'), ('z', '/', 'z')) t(spec, path, name)")
def attribute_paths(spark, sf_dir):
    return spark.createDataFrame([(s, *literals.attribute_path(s)) for s in ("/a/b:c", ".x", "/g.y", "z")], "spec string, path string, name string")


@query("select * from (values ('5s', 5000::bigint), ('2m', 120000), ('1h', 3600000), ('250', 250), ('1500us', 1)) t(spec, millis)")
def durations(spark, sf_dir):
    return spark.createDataFrame([(s, units.duration(s)) for s in ("5s", "2m", "1h", "250", "1500us")], "spec string, millis long")


@query("select * from (values ('0..9', 0::bigint, 10::bigint), ('7', 0, 7), ('[7]', 7, 8), ('[3,9)', 3, 9)) t(spec, lo, hi)")
def ordinal_ranges(spark, sf_dir):
    """Ranges of record ordinals, whole numbers only."""
    specs = ["0..9", "7", "[7]", "[3,9)"]
    return spark.createDataFrame([(s, windows.strict_range(s).lo, windows.strict_range(s).hi) for s in specs], "spec string, lo long, hi long")


@query("select * from (values ('a/b.slab:ns:[0..5)', 'a/b.slab', 'ns', 0::bigint, 5::bigint, 'slab'), ('x.fvec[2..4]', 'x.fvec', '-', 2, 5, 'xvec'), ('p.db:predicates', 'p.db', 'predicates', -1, -1, 'sqlite')) t(spec, path, namespace, lo, hi, kind)")
def source_specs(spark, sf_dir):
    """Sources with a namespace and a window."""
    rows = []
    for spec in ("a/b.slab:ns:[0..5)", "x.fvec[2..4]", "p.db:predicates"):
        s = datasets.Source.of(spec)
        rows.append((spec, s.path, s.namespace or "-", s.window[0].lo if s.window else -1, s.window[0].hi if s.window else -1, s.kind))
    return spark.createDataFrame(rows, "spec string, path string, namespace string, lo long, hi long, kind string")


@query("select * from (values ('little', true, false, false), ('big', false, true, true)) t(name, little, big, mismatch)")
def byte_orders(spark, sf_dir):
    """What the headers of a little- and of a big-endian vector file say."""
    home = storage.shared_folder(spark, "endian")
    vectors = np.arange(640, dtype="<f4").reshape(10, 64) / 640
    big = np.empty(len(vectors), np.dtype([("d", ">i4"), ("v", ">f4", (vectors.shape[1],))]))
    big["d"], big["v"] = vectors.shape[1], vectors
    rows = []
    for name, raw in (("little", xvec.encode(vectors, xvec.ELEMENTS["fvec"])), ("big", big.tobytes())):
        with storage.open_write(f"{home}/{name}.fvec") as f:
            f.write(raw)
        found = xvec.byte_order(f"{home}/{name}.fvec")
        rows.append((name, found["little"], found["big"], found["mismatch"]))
    return spark.createDataFrame(rows, "name string, little boolean, big boolean, mismatch boolean")


@query("select 'base_vectors' token, count(*)::varchar x from embeddings union all select 'dimensions', max(len(embedding))::varchar from embeddings union all select 'max_k', '3' union all select 'model', 'm1' union all select 'df', 'l2'")
def dataset_tokens(spark, sf_dir):
    """Facts of a dataset by their names: counted, read from a facet, or from its attributes."""
    home = storage.shared_folder(spark, "tokens")
    base = _base(spark, sf_dir)
    xvec.write(base, f"{home}/base.fvec", "fvec")
    xvec.write(base.select("ordinal", F.transform(F.slice("vector", 1, 3), lambda x: F.floor(x * 10).cast("int")).alias("vector")), f"{home}/idx.ivec", "ivec")
    with storage.open_write(f"{home}/dataset.yaml") as f:
        f.write(b"attributes: {distance_function: l2, model: m1}\nprofiles:\n  default: {base: base.fvec, indices: idx.ivec}\n")
    data = datasets.Dataset.load(home)
    return spark.createDataFrame([(t, data.token(spark, t)) for t in ("base_vectors", "dimensions", "max_k", "model", "df")], "token string, x string")


@query("select * from (values ('one', 2::bigint, 'l2'), ('two', 1, '-')) t(name, profiles, distance)")
def catalog_entries(spark, sf_dir):
    """The catalog of a folder of manifests, written and loaded."""
    home = storage.shared_folder(spark, "catalog")
    manifests = {"one": "attributes: {distance_function: l2}\nprofiles: {default: {base: b.fvec}, cut: {base: 'b.fvec[0..5)'}}\n", "two": "profiles: {default: {base: c.fvec}}\n"}
    for name, text in manifests.items():
        with storage.open_write(f"{home}/{name}/dataset.yaml") as f:
            f.write(text.encode())
    datasets.Catalog.emit(home.removeprefix("file://"))
    found = datasets.Catalog.load([home]).frame(spark)
    return found.select("name", F.size("profiles").cast("long").alias("profiles"), F.coalesce(F.col("attributes")["distance_function"], F.lit("-")).alias("distance"))


@query("select round(avg(d), 6) mean_gap, count(*) n from (select abs(embedding[1]::double - embedding[2]::double) d from embeddings)")
def sampled_by_size(spark, sf_dir):
    """A sample whose size is the rule's: all rows, when more are asked for than there are."""
    some = _base(spark, sf_dir)
    n = some.count()
    rows = statistics.sampled(some, statistics.sample_size(n, samples=10 * n))
    gap = F.abs(F.col("vector")[0].cast("double") - F.col("vector")[1].cast("double"))
    return rows.agg(F.round(F.avg(gap), 6).alias("mean_gap"), F.count("*").alias("n"))


@query(f"select dim, count(*) n, round(avg(x), 6) mean, true modelled from (select generate_subscripts(embedding, 1)::int - 1 dim, unnest(embedding)::double x from embeddings) group by dim")
def dimension_profiles(spark, sf_dir):
    """Moments of each dimension beside its model."""
    return statistics.profile(_base(spark, sf_dir)).select("dim", "n", F.round("mean", 6).alias("mean"), F.col("family").isNotNull().alias("modelled"))


@query("select c_custkey::bigint chunk, sha256(c_name) hash, c_custkey % 7 <> 3 valid from customer")
def merkle_file(spark, sf_dir):
    """A Merkle file over records' hashes, written, spoiled in every seventh chunk, and loaded."""
    leaves = xvec.dense(_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.sha2("c_name", 256).alias("hash")), "key")
    rows = leaves.orderBy("ordinal").collect()
    uri = f"{storage.shared_folder(spark, 'merkle-file')}/a.mrkl"
    shape = integrity.Shape.of(1024 * len(rows), 1024)
    integrity.save(uri, shape, integrity.tree([bytes.fromhex(r["hash"]) for r in rows]))
    integrity.spoil(uri, {r["ordinal"] for r in rows if r["key"] % 7 == 3})
    found, nodes, valid = integrity.load(uri)
    if integrity.summary(uri)["root"] != nodes[0].hex() or len(integrity.treeview(uri, 2)) != 3:
        raise ValueError(f"{uri} differs from its summary")
    first = found.leaves - 1
    return spark.createDataFrame([(r["key"], nodes[first + r["ordinal"]].hex(), r["ordinal"] in valid) for r in rows], "chunk long, hash string, valid boolean")


_STREAM = """
upstream:
  defaults: {n: "200"}
  steps:
    - {id: order, run: generate ivec-shuffle, interval: "${n}", seed: 7, output: order.ivec}
    - {id: base, run: generate vectors, count: "${n}", dimension: 4, output: base.fvec}
    - {id: query, run: generate fvec-extract, source: base.fvec, indices: order.ivec, range: "[0..20)", output: query.fvec}
    - {id: truth, run: compute knn, base: base.fvec, query: query.fvec, neighbors: 3, metric: L2, output: idx.ivec, distances: dst.fvec}
"""


@query("select step, state, turn from (values ('order'), ('base'), ('query'), ('truth')) s(step), (values ('done', 1), ('skipped', 2)) t(state, turn) union all select 'nearest is itself', count(*)::varchar, 3 from range(20)")
def command_stream(spark, sf_dir):
    """Steps in the order of their files, all of them skipped the second time; each extracted query's nearest row is itself."""
    home = storage.shared_folder(spark, "stream").removeprefix("file://")
    log = [(step, state, turn) for turn in (1, 2) for step, state in steps.run(spark, steps.parse(_STREAM, home=home))]
    near = xvec.read(spark, f"{home}/dst.fvec").where(F.col("vector")[0] == 0).count()
    return spark.createDataFrame([*log, ("nearest is itself", str(near), 3)], "step string, state string, turn int")


@query("select 'float32' element, max(len(embedding))::bigint dimension, count(*) \"rows\", (count(*) * (4 + 4 * max(len(embedding))))::bigint bytes from embeddings")
def file_info(spark, sf_dir):
    """What one vector file of all embeddings says of itself."""
    home = storage.shared_folder(spark, "info")
    xvec.write(_base(spark, sf_dir), f"{home}/parts", "fvec")
    xvec.assemble(f"{home}/parts", f"{home}/a.fvec")
    found = xvec.info(f"{home}/a.fvec")
    return spark.createDataFrame([(found["element"], found["dimension"], found["rows"], found["bytes"])], "element string, dimension long, rows long, bytes long")
