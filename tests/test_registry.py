"""Every registered query against its SQL on the smallest tables."""

import glob
import hashlib
import os

import pytest

from facetry.plans import facets, registry, stores  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.SQL:
        assert len(got)
        return
    want = duck.sql(registry.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert order(got).equals(order(want))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["knn_exact", "knn_expression", "knn_filtered", "knn_predicated", "knn_verify_recall", "neighbor_dereference", "verify_profiles"])
def test_every_twentieth_row_is_answered(spark, name):
    got = registry.QUERIES[name](spark, SF).select("query").distinct().toPandas()
    assert sorted(got["query"]) == list(range(0, 500, 20))


def test_entry_answers_every_twentieth_row(spark):
    import __spark_entry__ as e

    assert sorted(r["query"] for r in e.entry(spark).select("query").distinct().collect()) == list(range(0, 500, 20))


def test_chunk_hashes_of_all_texts(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, c, c * 1024, min((c + 1) * 1024, len(b)), hashlib.sha256(b[c * 1024 : (c + 1) * 1024]).hexdigest()) for d, b in docs for c in range(-(-len(b) // 1024))}
    got = registry.QUERIES["chunk_hashes"](spark, SF).select("doc_id", "chunk", "start", "end", "hash").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(not b.isascii() for _, b in docs) and {r["doc_id"] for r in got} == {d for d, b in docs if b}


def test_a_profile_covers_the_whole_base(spark):
    got = registry.QUERIES["verify_profiles"](spark, SF).toPandas()
    assert set(got["profile"]) == {"quarter", "half", "whole"}
    assert got[got["profile"] == "whole"]["ordinal"].max() >= 400 and got[got["profile"] == "half"]["ordinal"].max() < 250


#: Queries whose neighbours come of many tasks once tables are large.
_DEALT = ["knn_expression", "knn_verify_recall", "knn_hubness", "neighbors_truncated", "neighbor_dereference", "verify_profiles", "knn_predicated", "knn_exact", "knn_filtered"]


@pytest.mark.parametrize("name", _DEALT)
def test_neighbours_of_many_tasks(spark, duck, monkeypatch, name):
    """The same answers where the base has several segments and the queries several parts."""
    monkeypatch.setattr("facetry.operators.neighbors._grid", lambda n, m, *_: (4, 3))
    test_query(spark, duck, name)


def test_neighbours_are_found_once_and_read_twice(spark):
    plan = registry.QUERIES["neighbors_truncated"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Relation [") == 2


def test_no_row_is_made_of_a_pair(spark):
    plan = registry.QUERIES["knn_predicated"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan


def test_typed_records_are_dealt_out(spark, duck, monkeypatch):
    monkeypatch.setattr(stores, "_DEALT", 500)
    assert registry.QUERIES["metadata_typed_records"](spark, SF).rdd.getNumPartitions() == 3
    test_query(spark, duck, "metadata_typed_records")
