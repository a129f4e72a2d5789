"""The corpus pipeline: language ID, near-duplicates, repeated passages, packing.

Each stage takes all documents that the one before it kept; it is written as Parquet and read again between stages. An
empty table stays empty. Rows of one id are one document for near-duplicates (all of them stay or go, with the smallest
id of their group); language and passages are judged row by row. Rows without an id have no near-duplicates and are
nobody's copies. Ties never arise: the smallest id stays. Columns beyond those named are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.llm import language_id, near_duplicates, packing, repeated_passages
from facetry.llm._shared import release, written

#: Documents whose best language is less sure than this go; a text of any one language is far above it.
LEAST_SCORE = 0.3
#: Documents of this similarity or more are near-duplicates here; the query op3 has a bound of its own.
PERCENT = 80


def _columns(df):
    """The columns of documents, of whatever a stage has been given."""
    return [F.col(f"`{c}`") for c in df.columns]


def _without(docs, judged):
    """docs but for ids of which no row is kept; judged: (doc_id, kept). Rows with a null id stay.

    The ids that go are written first: Spark then knows their size, and sends them to the documents where they are small
    enough for that, instead of shuffling the texts.
    """
    gone = judged.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept")
    gone = written(gone.select(F.col("doc_id").alias("_gone")), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(_columns(docs))


def detect_language(spark, docs, sf_dir):
    """Keeps documents with letters whose language is recognised; `lang` stays as it was.

    Each row is judged by its own text, rows of one id and rows without an id too. The rows that go are written first,
    as the id and a hash of the text: small enough, as a rule, to be sent to the documents instead of shuffling those.
    """
    model = language_id.train(docs.where(~language_id.held_out()), "doc_id", "text", "lang")
    bad = (F.col("lang_pred") == language_id.UNDETERMINED) | (F.col("score") < LEAST_SCORE)
    judged = language_id.predicted(docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")), model, keep=("_hash",))
    gone = written(judged.where(bad).select(F.col("doc_id").alias("_gone"), F.col("_hash").alias("_text")), "gone")
    here = F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64("text") == F.col("_text"))
    return docs.join(gone, here, "left_anti").select(_columns(docs))


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps of each group of near-duplicates the document of the smallest id."""
    return _without(docs, near_duplicates.near_duplicates(docs, percent=PERCENT).select("doc_id", "kept"))


def cut_repeats(spark, docs, sf_dir):
    """Takes passages that repeat a document of a smaller id out of the texts; documents of which nothing is left go."""
    found = repeated_passages.without_repeats(docs).where("n_removed > 0").select(F.col("doc_id").alias("_cut"), F.col("text_key").alias("_key"), F.col("n_removed").alias("_removed"), F.col("kept").alias("_kept")).dropDuplicates(["_cut", "_key"])
    # Rows of one id may have different texts: each is cut as its own text is.
    joined = docs.join(found, (F.col("doc_id") == F.col("_cut")) & (repeated_passages.text_key(F.col("text")) == F.col("_key")), "left")
    changed = {"text": F.when(F.col("_removed").isNotNull(), F.col("_kept")).otherwise(F.col("text"))}
    changed["n_chars"] = F.when(F.col("_removed").isNotNull(), F.length("_kept").cast("long")).otherwise(F.col("n_chars"))
    return joined.where("_removed is null or _kept <> ''").select([changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def pack(spark, docs, sf_dir):
    """Where each piece of each document lies in the training sequences."""
    return packing.packed(docs)


STAGES = [("language", detect_language), ("near duplicates", drop_near_duplicates), ("repeated passages", cut_repeats), ("packing", pack)]

#: The stages use subword models and statistics that SQL doesn't have; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        after = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # What the stage before left has been read for the last time; the input itself isn't touched.
        release(docs)
        docs = after
    return docs
