"""Vector files, stores, manifests, records and hashes."""

import datetime as dt
import functools
import hashlib
import http.server
import json
import os
import random
import re
import threading
import uuid
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import records as R
from facetry.functions.records import Array, Field, MetadataLayout, Record, Tag, Ulid
from facetry.operators import integrity as I
from facetry.operators import predicates as P
from facetry.sources import datasets, slab, sqlite, storage, xvec


@pytest.mark.parametrize("kind", list(xvec.ELEMENTS))
def test_vector_files(spark, tmp_path, kind):
    rows = np.random.default_rng(1).integers(0, 200, (100, 3))
    path = tmp_path / f"a.{kind}"
    path.write_bytes(xvec.encode(rows, xvec.ELEMENTS[kind]))
    df = xvec.read(spark, str(path))
    assert [r["vector"] for r in df.orderBy("ordinal").collect()] == rows.tolist()
    assert df.where("ordinal >= 95").count() == 5 and df.where("ordinal = 7").first()["vector"] == rows[7].tolist()
    assert xvec.byte_order(str(path)) == {"little": True, "big": False, "mismatch": False}
    xvec.write(df, str(tmp_path / "out"), kind, parts=3)
    assert xvec.assemble(str(tmp_path / "out"), str(tmp_path / f"b.{kind}")) == path.stat().st_size
    assert (tmp_path / f"b.{kind}").read_bytes() == path.read_bytes()
    again = xvec.read(spark, str(tmp_path / "out"))
    assert [r["vector"] for r in again.orderBy("ordinal").collect()] == rows.tolist()
    assert xvec.read(spark, str(path), window="[10..12)").orderBy("ordinal").first()["vector"] == rows[10].tolist()


def test_half_floats_round_to_even(spark, tmp_path):
    raw = xvec.encode(np.array([[1 + 2**-11, 1 + 3 * 2**-11, 65504.0]]), xvec.ELEMENTS["mvec"])
    (tmp_path / "h.mvec").write_bytes(raw)
    assert xvec.read(spark, str(tmp_path / "h.mvec")).first()["vector"] == [1.0, 1 + 2**-9, 65504.0]


def test_bad_vector_files(spark, tmp_path):
    e = xvec.ELEMENTS["fvec"]
    (tmp_path / "short.fvec").write_bytes(xvec.encode(np.zeros((2, 3)), e)[:-1])
    (tmp_path / "big.fvec").write_bytes(np.array([2], ">i4").tobytes() + np.zeros(2, "f4").tobytes())
    (tmp_path / "mixed.fvec").write_bytes(xvec.encode(np.zeros((1, 3)), e) + np.array([5, 0, 0, 0], "<i4").tobytes())
    (tmp_path / "empty.fvec").write_bytes(b"")
    assert xvec.byte_order(str(tmp_path / "big.fvec"))["mismatch"]
    for name in ("short", "big", "mixed"):
        with pytest.raises(Exception):
            xvec.read(spark, str(tmp_path / f"{name}.fvec")).collect()
    assert xvec.read(spark, str(tmp_path / "empty.fvec")).count() == 0
    with pytest.raises(Exception):
        xvec.write(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "ordinal long, vector array<float>"), str(tmp_path / "w"))


def test_json_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,vec\nx,"[1.0, 2.5]"\ny,"[3, 4]"\nz,broken\n')
    assert [r["vector"] for r in xvec.read_json_csv(spark, str(tmp_path / "a.csv")).orderBy("line").collect()] == [[1.0, 2.5], [3.0, 4.0]]
    (tmp_path / "b.csv").write_text("1.0,2.0\n3.0,4.0\n")
    (tmp_path / "c.csv").write_text('"[1]","[2]"\n')
    for name in ("b", "c"):
        with pytest.raises(ValueError):
            xvec.read_json_csv(spark, str(tmp_path / f"{name}.csv"))


def test_parquet_vectors(spark, tmp_path):
    for name, lo in (("p1", 0), ("p2", 10)):
        spark.range(lo, lo + 10).select(F.array(F.col("id").cast("float")).alias("emb")).coalesce(1).write.parquet(str(tmp_path / name))
    groups = xvec.ordered_groups([str(tmp_path / "p1"), str(tmp_path / "p2")])
    assert len(groups) == 2
    rows = xvec.dense(xvec.read_parquet(spark, [f for g in groups for f in g]), "file", "place")
    got = [r["vector"][0] for r in rows.orderBy("ordinal").collect()]
    assert sorted(got) == list(map(float, range(20))) and [r["ordinal"] for r in rows.orderBy("ordinal").collect()] == list(range(20))
    with pytest.raises(ValueError):
        xvec.ordered_groups([str(tmp_path / "p1"), groups[0][0]])
    assert xvec.bins(["a/x1.p", "a/y2.p"], r"(?P<bin>[xy])") == {"x": ["a/x1.p"], "y": ["a/y2.p"]}


def test_slab_store(spark, tmp_path):
    path, rng = str(tmp_path / "s.slab"), random.Random(2)
    rows = [("", i, rng.randbytes(rng.randint(0, 300))) for i in [*range(-5, 50), *range(100, 160)]]
    rows += [("other", i * 3, b"x" * i) for i in range(40)]
    slab.write(path, rows, 1024)
    assert slab.check(path) == []
    store = slab.Store.open(path)
    assert set(store.pages) == {"", "other"} and store.count() == 115 and store.count("other") == 40
    assert store.get(-5) == rows[0][2] and store.get(60) is None and store.get(6, "other") == b"xx" and store.get(7, "other") is None
    assert store.get_all([("other", 6), ("", 60), ("no", 1), ("", 100)]) == [b"xx", None, None, rows[55][2]]
    with pytest.raises(KeyError):
        store.get(1, "no")
    with pytest.raises(ValueError):
        store.namespace(None)
    df = slab.read(spark, path)
    assert sorted((r[0], r[1], bytes(r[2])) for r in df.collect()) == sorted(rows)
    assert slab.read(spark, path, 'other', 60, 70).count() == 4
    assert slab.pages_table(spark, path).agg(F.sum("records")).first()[0] == 155 and "namespace" in slab.explain(path)
    slab.rewrite(path, str(tmp_path / "t.slab"), ["other"])
    assert slab.append(str(tmp_path / "t.slab"), [b"new"], "other") == 118
    assert slab.Store.open(str(tmp_path / "t.slab")).get(118, "other") == b"new"
    slab.write_frame(df, str(tmp_path / "u.slab"))
    assert sorted(slab.scan(slab.Store.open(str(tmp_path / "u.slab")))) == sorted(rows)


def test_slab_rules(tmp_path):
    w = slab.Writer(str(tmp_path / "a.slab"))
    w.write(5, b"a")
    for bad in (5, 4, 1 << 39):
        with pytest.raises(ValueError):
            w.write(bad, b"")
    w.close()
    slab.write(str(tmp_path / "e.slab"), [])
    assert slab.Store.open(str(tmp_path / "e.slab")).count() == 0 and (tmp_path / "e.slab").stat().st_size == 512
    raw = bytearray((tmp_path / "a.slab").read_bytes())
    assert raw[:4] == b"SLAB" and len(raw) % 512 == 0
    raw[4] = 1
    (tmp_path / "b.slab").write_bytes(raw)
    assert slab.check(str(tmp_path / "b.slab"))


@pytest.mark.parametrize(
    "name, raw, expected",
    [
        ("a.txt", b"one\ntwo\nthree", [b"one\n", b"two\n", b"three"]),
        ("a.bin", b"a\0b\0", [b"a\0", b"b\0"]),
        ("a.csv", b'h,i\n"x\ny",2\n', [b"h,i\n", b'"x\ny",2\n']),
        ("a.jsonl", b'{"a":1}\n\n[2]\n', [b'{"a":1}\n', b"[2]\n"]),
        ("a.json", b'{"a":1} [2]\n', [b'{"a":1}', b"[2]"]),
        ("a.yaml", b"---\na: 1\n---\nb: 2\n", [b"---\na: 1\n", b"---\nb: 2\n"]),
    ],
)
def test_slab_imports(spark, tmp_path, name, raw, expected):
    (tmp_path / name).write_bytes(raw)
    target = str(tmp_path / "out.slab")
    assert slab.import_file(str(tmp_path / name), target) == len(expected)
    assert [r for _, _, r in slab.scan(slab.Store.open(target))] == expected
    slab.import_file(str(tmp_path / name), target, add=True)
    assert slab.Store.open(target).count() == 2 * len(expected)


def test_slab_exports(spark):
    df = spark.createDataFrame([("", 0, bytearray(b"a")), ("", 1, bytearray(b"b\n"))], "namespace string, ordinal long, data binary")
    get = lambda kind: [r["out"] for r in slab.export(df, kind).orderBy("ordinal").collect()]
    assert get("text") == [b"a\n", b"b\n"] and get("cstrings") == [b"a\0", b"b\n\0"] and get("hex") == ["61", "620a"] and get("base64") == ["YQ==", "Ygo="] and get("utf8") == ["a", "b\n"] and get("raw") == [b"a", b"b\n"]
    with pytest.raises(ValueError, match="byte"):
        slab.split_records(b'{"a":1}\n{bad}\n', "jsonl")


def test_sqlite_store(spark, tmp_path):
    path = str(tmp_path / "p.db")
    sqlite.write(path, "predicates", [(i, b"%d" % i) for i in range(10)])
    sqlite.write(path, "predicates", [(3, b"new")])
    rows = {r["ordinal"]: bytes(r["data"]) for r in sqlite.read(spark, path, "predicates").collect()}
    assert len(rows) == 10 and rows[3] == b"new"
    with pytest.raises(ValueError):
        sqlite.write(path, "x; drop", [])


def test_manifest(spark, tmp_path):
    home = tmp_path / "sets" / "one"
    home.mkdir(parents=True)
    vectors = np.arange(300).reshape(100, 3)
    (home / "base.fvec").write_bytes(xvec.encode(vectors, xvec.ELEMENTS["fvec"]))
    (home / "idx.ivec").write_bytes(xvec.encode(vectors[:10], xvec.ELEMENTS["ivec"]))
    slab.write(str(home / "meta.slab"), [("metadata_content", i, b"r%d" % i) for i in range(5)] + [("metadata_predicates", 0, b"p")])
    (home / "dataset.yaml").write_text("""
attributes: {distance_function: l2, model: m1}
variables: {a: 1, b: 2}
profiles:
  default: {base: base.fvec, indices: idx.ivec, maxk: 2, content: meta.slab}
  sized: {ranges: [10..40/10u], facets: {base: "base.fvec${range}"}}
  cut: {train: {source: "base.fvec", window: "[5..9]"}}
  own: {base: "base.fvec[90..95)", base_count: 3}
""")
    (home / "variables.yaml").write_text("b: 3\n")
    d = datasets.Dataset.load(str(home))
    assert d.variables == {"a": 1, "b": 3} and d.distance_function == "EUCLIDEAN"
    assert list(d.profiles) == ["default", "10", "20", "30", "40", "cut", "own"]
    assert d.facet(spark, "base").count() == 100 and d.facet(spark, "train", "20").count() == 20
    assert [r["vector"] for r in d.facet(spark, "base", "cut").orderBy("ordinal").collect()] == vectors[5:10].tolist()
    assert d.facet(spark, "base", "own").orderBy("ordinal").first()["vector"] == vectors[90].tolist() and d.facet(spark, "base", "own").count() == 3
    assert d.facet(spark, "gt", "cut").first()["vector"] == vectors[0][:2].tolist()
    assert d.facet(spark, "meta_content").count() == 5
    assert [d.token(spark, t) for t in ("model", "dimensions", "max_k", "base_vectors", "nothing")] == ["m1", "3", "2", "100", None]
    assert spark.table(d.register(spark)[0]).count() == 100
    datasets.Catalog.emit(str(tmp_path / "sets"))
    c = datasets.Catalog.load([str(tmp_path / "sets")], [str(tmp_path / "none")])
    assert c.select("ONE:cut")[1] == "cut" and c.select("one")[0].attributes["model"] == "m1" and c.frame(spark).count() == 1
    assert c.match_one("o*").name == "one" and c.match_one("o.e").name == "one" and c.match_one("zzz") is None
    with pytest.raises(KeyError, match="one"):
        c.select("on")
    with pytest.raises(OSError):
        datasets.Catalog.load([str(tmp_path / "none")])


def test_names():
    assert datasets.facet_name("train") == "base_vectors" and datasets.facet_name("gt") == "neighbor_indices" and datasets.view_name("distances") == "neighbors"
    s = datasets.Source.of("a/b.slab:ns:[0..5)")
    assert (s.path, s.namespace, list(s.window), s.kind) == ("a/b.slab", "ns", [(0, 5)], "slab") or (s.namespace, s.window[0].hi) == ("ns", 5)
    assert datasets.dataset_spec("a:b") == ("a", "b") and datasets.dataset_spec("a.b") == ("a", "b") and datasets.dataset_spec("a") == ("a", None) and datasets.dataset_spec("a:") == ("a", None)
    for bad in ("", "a:b:c", "a\\", ":b", "a\\.b:c"):
        with pytest.raises(ValueError):
            datasets.dataset_spec(bad)


EVERYTHING = Record((
    ("s", Tag.STRING, 'a "b"\n'), ("l", Tag.LONG, -5), ("d", Tag.DOUBLE, 1.5), ("b", Tag.BOOL, True), ("raw", Tag.BYTES, b"\x00\xff"), ("n", Tag.NULL, None), ("es", Tag.ENUM_STR, "x"), ("eo", Tag.ENUM_ORD, 2),
    ("li", Tag.LIST, [1, "a", 2.5]), ("no", Tag.NODE, Record.of(k=1)), ("t", Tag.TEXT, "ü"), ("as", Tag.ASCII, "a"), ("i", Tag.INT, 7), ("sh", Tag.SHORT, -7), ("de", Tag.DECIMAL, Decimal("-12.345")), ("vi", Tag.VARINT, 2**70),
    ("f", Tag.FLOAT, 0.5), ("h", Tag.HALF, 1.5), ("m", Tag.MILLIS, 1700000000123), ("na", Tag.NANOS, (1700000000, 5)), ("da", Tag.DATE, dt.date(2024, 2, 29)), ("ti", Tag.TIME, dt.time(1, 2, 3)), ("u1", Tag.UUID1, uuid.UUID(int=5)),
    ("u7", Tag.UUID7, uuid.UUID(int=2**127 + 9)), ("ul", Tag.ULID, Ulid.parse("01ARZ3NDEKTSV4RRFFQ69G5FAV")), ("ar", Tag.ARRAY, Array(Tag.FLOAT, (1.0, 2.5))), ("se", Tag.SET, {3, 1, 2}), ("ma", Tag.MAP, {"a": 1, "b": 2}),
    ("dt", Tag.DATETIME, dt.datetime(2024, 1, 1, 2, 3, 4, tzinfo=dt.timezone.utc)),
))


def test_records():
    raw = R.encode(EVERYTHING)
    assert raw[0] == 1 and R.decode(raw) == EVERYTHING and list(R.unframed(R.framed(EVERYTHING) * 2)) == [EVERYTHING] * 2
    assert R.parse_record(R.format_record(EVERYTHING)) == EVERYTHING
    assert EVERYTHING.congruent(EVERYTHING) and not EVERYTHING.congruent(Record.of(a=1))
    assert EVERYTHING.typed("sh", Tag.LONG) == -7 and EVERYTHING.find("l", Tag.SHORT) is None and EVERYTHING.get("zzz") is None and EVERYTHING.has("l")
    assert R.decode_any(raw) == EVERYTHING and R.decode_any(P.frame(P.leaf("a", "EQ", 1))) == P.leaf("a", "EQ", 1)
    with pytest.raises(ValueError):
        list(R.unframed(R.framed(EVERYTHING)[:-1]))


def test_ulids():
    u = Ulid.parse("01ARZ3NDEKTSV4RRFFQ69G5FAV")
    assert str(u) == "01ARZ3NDEKTSV4RRFFQ69G5FAV" and u.millis == 1469922850259 and u < Ulid(b"\xff" * 16)
    for bad in ("", "8" + "0" * 25, "U" * 26):
        with pytest.raises(ValueError):
            Ulid.parse(bad)


def test_layouts(spark):
    layout = MetadataLayout((Field("name", "TEXT"), Field("number", "INT"), Field("score", "FLOAT"), Field("ok", "BOOL"), Field("color", "ENUM", ("red", "blue"))))
    assert MetadataLayout.decode(layout.encode()) == layout
    rows = [{"name": "a", "number": 5, "score": 0.5, "ok": False, "color": "blue"}, {"name": None, "number": None, "score": 1.0, "ok": None, "color": None}]
    stored = spark.createDataFrame([(i, bytearray(layout.encode_record(r))) for i, r in enumerate(rows)], "ordinal long, data binary")
    got = R.decode_frame(stored, layout).orderBy("ordinal").drop("ordinal").collect()
    assert [r.asDict() for r in got] == rows
    for bad, error in (({"no": 1}, KeyError), ({"color": "green"}, ValueError)):
        with pytest.raises(error):
            layout.encode_record(bad)
    lists = spark.createDataFrame([(0, bytearray(R.encode_results([3, 1])))], "ordinal long, data binary")
    assert R.results_frame(lists).first()["ordinals"] == [3, 1]


def test_chunk_sizes():
    sizes = [(0, 1 << 20), (5, 64), (1023, 64), (1024, 1024), (1025, 2048), ((1 << 20) - 1, 1 << 20), (1 << 20, 1 << 20), (4096 << 20, 1 << 20), ((4096 << 20) + 1, 2 << 20), (1 << 50, 64 << 20)]
    assert [I.chunk_size(n) for n, _ in sizes] == [c for _, c in sizes]
    assert I.Shape.of(0).chunks == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_merkle(spark, tmp_path, n):
    data = random.Random(n).randbytes(1024 * n - 7)
    path = str(tmp_path / "f.bin")
    (tmp_path / "f.bin").write_bytes(data)
    shape = I.Shape.of(len(data), 1024)
    rows = I.file_chunks(spark, path, shape)
    leaves = [hashlib.sha256(data[i : i + 1024]).digest() for i in range(0, len(data), 1024)]
    assert [r["hash"] for r in rows.orderBy("chunk").collect()] == [x.hex() for x in leaves]
    nodes = I.tree(leaves)
    assert I.root(rows, n).first()[0] == nodes[0].hex()
    assert I.tree(leaves, padded=False)[0] == (nodes[0] if n & (n - 1) == 0 else bytes(32))
    I.save(str(tmp_path / "f.mrkl"), shape, nodes, {0})
    assert I.load(str(tmp_path / "f.mrkl")) == (shape, nodes, {0})
    assert [h for _, h in I.path_to_root(nodes, 0)][-1] == nodes[0]
    assert I.summary(str(tmp_path / "f.mrkl")) == {"bytes": len(data), "chunk": 1024, "chunks": n, "leaves": shape.leaves, "valid": 1, "root": nodes[0].hex()}
    assert len(I.treeview(str(tmp_path / "f.mrkl"), 2)) == min(3, shape.nodes) and f"chunks 0 to {n - 1}, 1 valid" in I.treeview(str(tmp_path / "f.mrkl"))[0]
    I.spoil(str(tmp_path / "f.mrkl"), {0})
    assert I.load(str(tmp_path / "f.mrkl")) == (shape, nodes, set())
    I.spoil(str(tmp_path / "f.mrkl"), {n - 1}, hashes=True)
    assert I.load(str(tmp_path / "f.mrkl"))[1] == I.tree([*leaves[:-1], bytes(32)])
    with pytest.raises(ValueError):
        I.spoil(str(tmp_path / "f.mrkl"), {n})
    (tmp_path / "f.bin").write_bytes(b"!" + data[1:])
    assert [r[0] for r in I.mismatches(rows, I.file_chunks(spark, path, shape)).collect()] in ([0], [])
    other = spark.createDataFrame([(0, "x"), (99, "y")], "chunk long, hash string")
    assert I.mismatches(rows, other).count() >= 2 and I.mismatches(rows, other, same_shape=False).count() == n + 1 and I.valid(rows, other).count() == 0


def test_catalog_settings(tmp_path):
    assert datasets.catalog_sources(str(tmp_path)) == ([], [])
    (tmp_path / "catalogs.yaml").write_text(json.dumps({"required": ["/a"], "optional": ["/no/such", str(tmp_path)]}))
    assert datasets.catalog_sources(str(tmp_path)) == (["/a"], [str(tmp_path)])


class _Ranges(http.server.SimpleHTTPRequestHandler):
    """A server of byte ranges; paths with `whole` in them are always sent whole."""

    def do_GET(self):
        path = self.translate_path(self.path)
        if not os.path.isfile(path):
            return self.send_error(404)
        data = open(path, "rb").read()
        m = re.fullmatch(r"bytes=(\d+)-(\d+)", self.headers.get("Range", ""))
        if not m or "whole" in self.path:
            self.send_response(200)
        elif int(m[1]) >= len(data):
            self.send_response(416)
            self.send_header("Content-Range", f"bytes */{len(data)}")
            data = b""
        else:
            last = min(int(m[2]), len(data) - 1)
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {m[1]}-{last}/{len(data)}")
            data = data[int(m[1]) : last + 1]
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


def test_files_over_http(spark, tmp_path):
    home = tmp_path / "sets" / "one"
    home.mkdir(parents=True)
    vectors = np.arange(300).reshape(100, 3)
    (home / "base.fvec").write_bytes(xvec.encode(vectors, xvec.ELEMENTS["fvec"]))
    (home / "whole.fvec").write_bytes((home / "base.fvec").read_bytes())
    (home / "empty").write_bytes(b"")
    slab.write(str(home / "m.slab"), [("", i, b"r%d" % i) for i in range(50)], 512)
    (home / "dataset.yaml").write_text("profiles: {default: {base: base.fvec, content: m.slab}, cut: {base: 'base.fvec[10..20)'}}\n")
    datasets.Catalog.emit(str(tmp_path / "sets"))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(_Ranges, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}/sets"
    try:
        raw = (home / "base.fvec").read_bytes()
        for name in ("base", "whole"):
            uri = f"{root}/one/{name}.fvec"
            assert storage.size(uri) == len(raw) and storage.read_range(uri, 7, 20) == raw[7:27] and storage.read_range(uri, len(raw) - 3, 10) == raw[-3:] and storage.read_range(uri, len(raw) + 5, 4) == b""
            assert [r["vector"] for r in xvec.read(spark, uri).orderBy("ordinal").collect()] == vectors.tolist()
        assert storage.size(f"{root}/one/empty") == 0
        with storage.open_read(f"{root}/one/base.fvec") as f:
            f.seek(-4, 2)
            assert f.read() == raw[-4:] and f.tell() == len(raw) and f.read(1) == b""
        with pytest.raises(OSError):
            storage.size(f"{root}/none")
        assert slab.Store.open(f"{root}/one/m.slab").get(33) == b"r33" and slab.read(spark, f"{root}/one/m.slab").count() == 50
        data, profile = datasets.Catalog.load([root], [f"{root}/no"]).select("one:cut")
        assert [r["vector"] for r in data.facet(spark, "base", profile).orderBy("ordinal").collect()] == vectors[10:20].tolist()
        shape = I.Shape.of(len(raw), 1024)
        assert [r["hash"] for r in I.file_chunks(spark, f"{root}/one/base.fvec", shape).orderBy("chunk").collect()] == [hashlib.sha256(raw[i : i + 1024]).hexdigest() for i in range(0, len(raw), 1024)]
    finally:
        server.shutdown()
