"""The pipeline: every stage's decisions on planted documents, and the registered queries on the smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facetry.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in docs.where("lang = 'en' and length(text) > 1500").orderBy("doc_id").limit(3).collect()]
    passage = " ".join(random.Random(1).choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60))
    rows = [
        (100_000, texts[0], "en", "s", 1),  # an exact copy
        (100_001, " ".join(texts[1].split()[:-2]) + " end", "en", "s", 1),  # a near copy
        (100_002, "the of and that " + passage, "en", "s", 1),
        (100_003, passage + " with for this have from", "en", "s", 1),  # repeats the passage
        (100_004, "12345 !!! ###", "en", "s", 1),
        (100_005, None, None, None, None),
    ]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def test_stages(spark, planted):
    kept = corpus_pipeline.detect_language(spark, planted, SF)
    assert kept.columns == planted.columns
    gone = {r["doc_id"] for r in planted.join(kept, "doc_id", "left_anti").collect()}
    assert gone == {100_004, 100_005}
    unique = corpus_pipeline.drop_near_duplicates(spark, kept, SF)
    left = {r["doc_id"] for r in unique.select("doc_id").collect()}
    assert unique.columns == planted.columns and not {100_000, 100_001} & left and {100_002, 100_003} <= left
    cut = corpus_pipeline.cut_repeats(spark, unique, SF)
    assert cut.columns == planted.columns
    assert cut.where("doc_id = 100003").first()["text"] == "with for this have from"
    assert cut.where("doc_id = 100002").first()["text"].endswith("theta") or cut.where("doc_id = 100002").count() == 1
    whole = cut.join(unique.select("doc_id", F.col("text").alias("before")), "doc_id").where("text <> before").count()
    assert whole >= 1
    packed = corpus_pipeline.pack(spark, cut, SF)
    assert packed.select("doc_id").distinct().count() == cut.count()


def test_stages_on_nothing(spark, planted):
    docs = planted.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0 and docs.columns == planted.columns
    assert corpus_pipeline.pack(spark, docs, SF).count() == 0


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "repeated passages", "packing"]
    got = corpus_pipeline.run(spark, SF)
    assert got.where("offset < 0 or length < 1 or offset + length > 1024").count() == 0 and got.count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_queries(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        want = con.sql(ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        order = lambda df: df[columns].sort_values(columns).reset_index(drop=True).astype(str)
        assert order(got).equals(order(want))


def test_near_duplicates_from_80_percent(spark):
    """A copy with one word of 50 changed has 41 of 51 shingles in common, 80.4 %; with two words changed, fewer."""
    words = [f"w{i}" for i in range(50)]
    changed = lambda *at: " ".join("new" if i in at else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, changed()), (2, changed(20)), (3, changed(10, 30))], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == {1, 3}


def test_two_texts_of_one_id_are_cut_each_by_itself(spark):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    repeat, clean, part = words("r", 20), words("cé", 20), words("p", 15)
    docs = spark.createDataFrame([(1, repeat), (2, repeat), (2, clean), (3, part + " " + repeat), (3, None), (3, part)], "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = sorted((r["doc_id"], r["text"] or "", r["n_chars"] or 0) for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect())
    want = [(1, repeat), (2, clean), (3, ""), (3, part), (3, part)]
    assert got == [(i, t, len(t)) for i, t in want]


def test_language_is_judged_row_by_row(spark):
    """Rows of one id, rows without an id, repeated rows and columns of the stage's own names."""
    good = "the of and that with for this have from " * 5
    rows = [(1, good, "en"), (1, "12 34", "en"), (2, None, "en"), (None, good, "en"), (None, "!!!", None), (None, None, None), (3, good, "en"), (3, good, "en"), (4, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_x", F.lit(1)).withColumn("score", F.lit(0.0))
    got = corpus_pipeline.detect_language(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] == good) for r in got.collect()) == [("1", True), ("3", True), ("3", True), ("None", True)]
    left = corpus_pipeline.drop_near_duplicates(spark, got, SF)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "None"]
    cut = corpus_pipeline.cut_repeats(spark, left.withColumn("n_chars", F.length("text").cast("long")), SF)
    assert cut.count() == 2 and corpus_pipeline.pack(spark, cut, SF).count() == 2
