import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetry.operators import predicates as P
from facetry.operators.predicates import Junction, Leaf, all_of, any_of, leaf


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (0, 42, 5.9, "alice", True, bytearray(b"x")),
        (1, None, None, None, None, None),
        (2, -1, float("nan"), "alice\n", False, bytearray(b"")),
        (3, 43, 1e30, "bob", True, bytearray(b"y")),
        (4, 0, -0.0, "", False, bytearray(b"z")),
        (5, 5, float("-inf"), "Alice", True, bytearray(b"x")),
    ]
    return spark.createDataFrame(rows, "ordinal long, age long, score double, name string, active boolean, raw binary").cache()


CASES = [
    (leaf("age", "GT", 41), {0, 3}),
    (leaf("age", "GE", 43), {3}),
    (leaf("age", "LT", 0), {2}),
    (leaf("age", "LE", 0), {2, 4}),
    (leaf("age", "EQ", 42), {0}),
    (leaf("age", "NE", 42), {2, 3, 4, 5}),
    (leaf("age", "IN", 42, 43, 5.0), {0, 3}),
    (leaf("age", "GT", 41.5), {0, 3}),
    (leaf("age", "EQ", "42"), set()),
    (leaf("age", "NE", "42"), set()),
    (leaf("age", "NE", True), set()),
    (leaf("age", "MATCHES", 42), set()),
    (leaf("score", "EQ", 5), {0}),
    (leaf("score", "EQ", 0), {2, 4}),  # NaN is read as 0 where whole numbers are asked for
    (leaf("score", "GT", 5), {3}),
    (leaf("score", "EQ", 9223372036854775807), {3}),
    (leaf("score", "LE", -9223372036854775808), {5}),
    (leaf("score", "GT", 5.0), {0, 3}),
    (leaf("score", "NE", 5.9), {2, 3, 4, 5}),
    (leaf("score", "EQ", float("nan")), set()),
    (leaf("score", "NE", float("nan")), {0, 2, 3, 4, 5}),
    (leaf("score", "IN", 0.0, 5.9), {0, 4}),
    (leaf("name", "EQ", "alice"), {0}),
    (leaf("name", "NE", "alice"), {2, 3, 4, 5}),
    (leaf("name", "GT", "alice"), {2, 3}),
    (leaf("name", "IN", "bob", "", 5), {3, 4}),
    (leaf("name", "MATCHES", "ali.*"), {0}),  # a line feed is no `.` and not passed over at the end
    (leaf("name", "MATCHES", "a|bob"), {3}),
    (leaf("name", "EQ", 5), set()),
    (leaf("active", "EQ", True), {0, 3, 5}),
    (leaf("active", "NE", True), {2, 4}),
    (leaf("active", "GT", False), set()),
    (leaf("active", "EQ", 1), set()),
    (Leaf("active", "EQ", (1,), True), {0, 3, 5}),
    (Leaf("active", "GT", (0,), True), set()),
    (Leaf("age", "IN", (42, 0), True), {0, 4}),
    (Leaf("age", "GT", (), True), set()),
    (Leaf("name", "EQ", (1,), True), set()),
    (leaf("raw", "EQ", b"x"), set()),
    (leaf("raw", "NE", b"x"), set()),
    (leaf("age", "EQ", None), {1}),
    (leaf("age", "EQ", 42, None), {0, 1}),
    (leaf("age", "NE", None), set()),
    (leaf("missing", "EQ", None), {0, 1, 2, 3, 4, 5}),
    (leaf("missing", "NE", 5), set()),
    (leaf("age", "IN"), set()),
    (Junction("AND", ()), {0, 1, 2, 3, 4, 5}),
    (Junction("OR", ()), set()),
    (all_of(leaf("age", "GT", 0), leaf("active", "EQ", True), leaf("name", "NE", "bob")), {0, 5}),
    (any_of(leaf("age", "EQ", 0), all_of(leaf("age", "GT", 0), leaf("name", "EQ", "bob"))), {3, 4}),
]


def test_evaluation(records):
    got: dict[int, set] = {i: set() for i in range(len(CASES))}
    for r in P.solve(records, [(i, node) for i, (node, _) in enumerate(CASES)]).collect():
        got[r["query"]].add(r["ordinal"])
    wrong = [(CASES[i][0], got[i], CASES[i][1]) for i in got if got[i] != CASES[i][1]]
    assert not wrong


def test_columns_are_never_null(records):
    for node, _ in CASES:
        assert records.where(P.compile_predicate(node, records.schema).isNull()).count() == 0
        break
    everything = [P.compile_predicate(node, records.schema).isNull() for node, _ in CASES]
    total = everything[0]
    for c in everything[1:]:
        total = total | c
    assert records.where(total).count() == 0


def test_numbered_fields_need_a_layout(records):
    with pytest.raises(ValueError):
        P.compile_predicate(leaf(1, "EQ", 42), records.schema)
    named = P.resolve(any_of(leaf(0, "EQ", 42)), ["age"])
    assert P.where(records, named).count() == 1


def test_result_indices(records):
    found = P.result_indices(P.solve(records, [(7, leaf("age", "GE", 0)), (8, leaf("age", "GT", 1000))])).collect()
    assert [(r["query"], r["ordinals"]) for r in found] == [(7, [0, 3, 4, 5])]


def test_filters_reach_the_scan(spark, tmp_path, records):
    records.drop("raw").write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    plan = df.where(P.compile_predicate(leaf("age", "GT", 41), df.schema))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan


@pytest.mark.parametrize(
    "node, sql, cddl",
    [
        (leaf("age", "GT", 42), "age > 42", "age: int > 42"),
        (leaf("name", "EQ", "alice"), "name = 'alice'", 'name: tstr = "alice"'),
        (leaf("id", "IN", 1, 2, 3), "id IN (1, 2, 3)", "id: int IN [1, 2, 3]"),
        (leaf("name", "MATCHES", "ali%"), "name LIKE 'ali%'", 'name: tstr MATCHES "ali%"'),
        (leaf("active", "EQ", True), "active = TRUE", "active: bool = true"),
        (leaf("value", "EQ", None), "value = NULL", "value: null = null"),
        (leaf("score", "LE", 9.5), "score <= 9.5", "score: float <= 9.5"),
        (all_of(leaf("age", "GT", 20), leaf("age", "LT", 50)), "(age > 20 AND age < 50)", "AND { age: int > 20, age: int < 50 }"),
        (Leaf(3, "EQ", (100,), True), "F3 = 100", "F3: int = 100"),
        (leaf("name", "EQ", "O'Brien"), "name = 'O''Brien'", 'name: tstr = "O\'Brien"'),
    ],
)
def test_renderings(node, sql, cddl):
    assert P.render_sql(node) == sql
    assert P.render_cddl(node) == cddl


def test_cql_has_no_parentheses():
    assert P.render_cql(all_of(leaf("a", "EQ", 1), any_of(leaf("b", "NE", 2), leaf("n", "MATCHES", "p")))) == "a = 1 AND b != 2 OR n /* MATCHES */ 'p'"


def test_floats_show_as_in_records():
    assert [P._float_text(x) for x in (1.0, 0.5, 1e7, 1.5e-5, 123456789.0, -2.5e20, 0.001)] == ["1.0", "0.5", "1.0E7", "1.5E-5", "1.23456789E8", "-2.5E20", "0.001"]


values = st.one_of(st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False), st.text(max_size=20), st.booleans(), st.binary(max_size=20), st.none())
leaves = st.builds(lambda f, o, v: Leaf(f, o, tuple(v)), st.text(min_size=1, max_size=8), st.sampled_from(P.OPERATORS), st.lists(values, max_size=4))
trees = st.recursive(leaves, lambda n: st.builds(lambda k, v: Junction(k, tuple(v)), st.sampled_from(("AND", "OR")), st.lists(n, max_size=3)), max_leaves=8)


@given(trees)
@settings(max_examples=100, deadline=None)
def test_binary_round_trip(tree):
    assert P.unframe(P.frame(tree, typed=True)) == tree


def test_legacy_forms():
    tree = all_of(Leaf(0, "GT", (5,), True), Leaf(1, "IN", (1, 2), True))
    raw = P.encode(tree, named=False)
    assert raw[:2] == bytes([1, 2]) and P.decode(raw, named=False) == tree
    assert not P.detect_named(raw, 2)
    named = all_of(Leaf("aa", "GT", (5,), True), Leaf("bb", "EQ", (1,), True))
    assert P.detect_named(P.encode(named), 2)
    with pytest.raises(ValueError):
        P.decode(raw + b"x", named=False)


def test_json():
    node = P.parse_json('{"op": "and", "nodes": [{"field": "a", "op": ">=", "values": [1]}, {"field": "b", "op": "IN", "values": ["x", "y"]}]}')
    assert node == all_of(leaf("a", "GE", 1), leaf("b", "IN", "x", "y"))
    assert P.parse_json(P.to_json(node)) == node
    for bad in ('{"op": "AND", "nodes": []}', '{"field": "a", "op": "EQ", "values": [1, 2]}', '{"field": "a", "op": "NO", "values": [1]}'):
        with pytest.raises(ValueError):
            P.parse_json(bad)


def test_infinities_do_not_overflow(records):
    df = records.withColumn("score", records["score"] * 1e300)
    assert not math.isnan(df.where(P.compile_predicate(leaf("score", "GE", 0), df.schema)).count())
