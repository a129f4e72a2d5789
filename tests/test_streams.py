"""Structured Streaming over facets, and command streams."""

import os

import pytest

from facetry.operators.predicates import leaf
from facetry.plans import steps
from facetry.sources import xvec
from facetry.streaming import facets


def test_streamed_facets(spark, tmp_path):
    rows = spark.range(20).selectExpr("id as ordinal", "array(cast(id as double), 0D) as vector", "id % 3 as label", "map('k', cast(id as string)) as tags")
    rows.where("ordinal < 10").write.parquet(str(tmp_path / "in"))
    read = lambda: facets.read(spark, str(tmp_path / "in"), rows.schema)

    def go(stream, name):
        facets.append(stream, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    assert go(facets.where(read(), leaf("label", "EQ", 1)), "a").count() == 3
    rows.where("ordinal >= 10").write.mode("append").parquet(str(tmp_path / "in"))
    assert go(facets.where(read(), leaf("label", "EQ", 1)), "a").count() == 7
    assert go(facets.solved(read(), [(0, leaf("label", "EQ", 0)), (1, leaf("ordinal", "LT", 5))]), "b").count() == 12
    assert go(facets.tagged(read(), "k:1."), "c").count() == 10
    assert go(facets.measured(read(), [0.0, 0.0], "L2"), "d").where("distance = ordinal").count() == 20


STREAM = """
upstream:
  defaults: {n: 60, seed: 7}
  steps:
    - {run: generate ivec-shuffle, interval: 60, seed: "${seed}", output: shuffle.ivec}
    - {run: generate vectors, id: all, count: "${n}", dimension: 4, seed: "${seed}", output: all.fvec}
profiles:
  default:
    indices:
      source: indices.ivec
      upstream:
        - {run: compute knn, base: base.fvec, query: query.fvec, neighbors: 3, metric: L2, distances: distances.fvec}
    base:
      source: base.fvec
      upstream:
        - {run: generate fvec-extract, id: base, source: all.fvec, indices: shuffle.ivec, range: "[10..60)"}
    query:
      source: query.fvec
      upstream:
        - {run: generate fvec-extract, id: query, source: all.fvec, indices: shuffle.ivec, range: "[0..10)"}
"""


def test_command_stream(spark, tmp_path):
    stream = lambda **v: steps.parse(STREAM, v, str(tmp_path))
    assert [s for _, s in steps.run(spark, stream(), dry_run=True)] == ["planned"] * 5
    done = steps.run(spark, stream())
    assert [s for _, s in done] == ["done"] * 5 and done[-1][0] == "compute-knn"
    assert xvec.read(spark, str(tmp_path / "indices.ivec")).count() == 10 and xvec.read(spark, str(tmp_path / "base.fvec")).count() == 50
    assert [s for _, s in steps.run(spark, stream())] == ["skipped"] * 5
    whole = (tmp_path / "base.fvec").read_bytes()
    (tmp_path / "base.fvec").write_bytes(whole[:-3])
    assert steps.state(str(tmp_path / "base.fvec")) == steps.PARTIAL
    again = dict(steps.run(spark, stream()))
    assert again["base"] == "done" and again["compute-knn"] == "done" and again["query"] == "skipped"
    assert (tmp_path / "base.fvec").read_bytes() == whole
    assert steps.state(str(tmp_path / "none.fvec")) == steps.ABSENT and os.path.exists(tmp_path / "distances.fvec")


def test_bad_streams(spark):
    with pytest.raises(KeyError):
        steps.parse({"upstream": {"steps": [{"run": "x", "output": "${no}"}]}})
    with pytest.raises(KeyError):
        steps.ordered(steps.parse({"upstream": {"steps": [{"run": "x", "after": "y"}]}}).steps)
    with pytest.raises(ValueError):
        steps.ordered(steps.parse({"upstream": {"steps": [{"run": "a", "id": "a", "after": "b"}, {"run": "b", "id": "b", "after": "a"}]}}).steps)
    with pytest.raises(KeyError):
        steps.run(spark, steps.parse({"upstream": {"steps": [{"run": "no such"}]}}))
