"""Substring dedup (operator 4): repeated-phrase automata.

A window is 13 consecutive words. Each window names one phrase in it, the seven words of least hash, so equal windows name
equal phrases. Phrases that windows of two different texts name are confirmed as recurring, and their words are taken
from the document of the smallest id. Documents are dealt into shards; the words of the phrases that a shard's documents
name are compiled into one Aho-Corasick automaton, and the shard's texts are streamed through it: that, and nothing else,
says where a phrase stands. The windows that name a located phrase are compared on all 13 words, with the smallest
document that holds each. A document none of whose phrases recurs holds no window of another text and isn't streamed.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import kept, release, slices, small, sweep, written
from ._words import Words

#: Words of a window, and of the phrase that stands for it: long enough that unrelated texts hardly share one.
WINDOW, PHRASE = 13, 7
#: Characters of the documents of one shard, about.
SHARD = 1 << 21
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def text_key(text):
    """The digest of a text column that tells rows of one id apart: the first 16 bytes of the SHA-256; null as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _key(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:16]


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of `size` consecutive values, from each place on where so many are left."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    span, least = 1, values
    while 2 * span <= size:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:n], least[size - span : size - span + n])


def _windows(w: Words, i: int, window: int) -> slice:
    """The first words of the windows of text i."""
    return slice(w.firsts[i], max(w.firsts[i], w.firsts[i + 1] - window + 1))


def _scanned(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc_id, text_key, n_words, words_sha256, phrases array<long>) of (doc_id, text), phrases of all its windows."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_words", pa.int64()), ("words_sha256", pa.string()), ("phrases", pa.list_(pa.int64()))])

    def run(batches):
        kept("repeated_passages")
        for batch in small(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], 1 << 20):
                some = texts[lo:hi]
                w = Words(some, lower=False)
                least = sliding_least(w.windows(phrase), window - phrase + 1)
                phrases = [np.unique(least[_windows(w, i, window)]).view(np.int64) for i in range(len(some))]
                raw = [(t or "").encode() for t in some]
                yield pa.record_batch([
                    ids.slice(lo, hi - lo), pa.array([_key(r) for r in raw], pa.binary()), pa.array(np.diff(w.firsts), pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(r.split())).hexdigest() for r in raw]), pa.array(phrases, schema.field(4).type),
                ], schema=schema)

    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("words_sha256", T.StringType()), T.StructField("phrases", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, kinds)


def _spaced(text: str) -> bytes:
    """The words of a text, each between single spaces."""
    return b" " + b" ".join(text.encode().split()) + b" "


def _phrase_words(rows: DataFrame, phrase: int) -> DataFrame:
    """(phrase, words binary) of (text, phrases): the words of each wanted phrase that stands in the text."""
    schema = pa.schema([("phrase", pa.int64()), ("words", pa.binary())])

    def run(batches):
        kept("repeated_passages")
        for batch in small(batches):
            texts, marks = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in slices([len(t) for t in texts], 1 << 20):
                w = Words([_spaced(t) for t in texts[lo:hi]], lower=False)
                grams = w.windows(phrase)
                inside = np.zeros(len(grams), bool)
                for i in range(hi - lo):
                    inside[_windows(w, i, phrase)] = True
                places = np.flatnonzero(inside & np.isin(grams, marks.slice(lo, hi - lo).flatten().to_numpy().view(np.uint64)))
                found, first = np.unique(grams[places], return_index=True)
                words = [w.data[w.starts[p] : w.ends[p + phrase - 1]] for p in places[first]]
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(words, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "phrase long, words binary")


def automaton(phrases) -> ahocorasick.Automaton:
    """The automaton of phrases (words joined by single spaces, UTF-8), over bytes read as Latin-1; values are lengths."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p in phrases:
        out.add_word(f" {p.decode('latin-1')} ", len(p) + 2)
    if len(out):
        out.make_automaton()
    return out


def located(w: Words, shard: ahocorasick.Automaton) -> np.ndarray:
    """Whether one of the shard's phrases starts at each word; the words of `w` stand between single spaces."""
    here = np.zeros(len(w.hashes), bool)
    if len(shard):
        # Texts are parted by a line feed, which no phrase holds: none is found across a border.
        begins = [end - length + 2 for end, length in shard.iter(w.data.decode("latin-1"))]
        here[np.searchsorted(w.starts, np.array(begins, np.int64))] = True
    return here


def _occurrences(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc_id, text, starts array<int>, hashes array<long>) of (doc_id, text, phrases array<binary>): the windows that
    may recur."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("starts", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        kept("repeated_passages")
        for batch in small(batches):
            ids, texts, marks = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            for lo, hi in slices([len(t) for t in texts], SHARD):
                w = Words([_spaced(t) for t in texts[lo:hi]], lower=False)
                here = located(w, automaton(marks.slice(lo, hi - lo).flatten().unique().to_pylist()))
                grams = w.windows(phrase)
                reach = window - phrase + 1
                least = sliding_least(grams, reach)
                # A window counts if the phrase that it names was located.
                named = sliding_least(np.where(here[: len(grams)], grams, _NONE), reach) == least
                whole = w.windows(window)
                starts, hashes = [], []
                for i in range(hi - lo):
                    s = _windows(w, i, window)
                    at = np.flatnonzero(named[s])
                    starts.append(at.astype(np.int32))
                    hashes.append(whole[s][at].view(np.int64))
                yield pa.record_batch([ids.slice(lo, hi - lo), pa.array(texts[lo:hi], pa.string()), pa.array(starts, schema.field(2).type), pa.array(hashes, schema.field(3).type)], schema=schema)

    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("hashes", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, kinds)


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, n_removed, kept, kept_sha256) of (doc_id, text, starts, hashes, gone array<long>)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])

    def run(batches):
        kept("repeated_passages")
        for batch in small(batches):
            out = [[] for _ in range(4)]
            texts, starts, hashes, gone = (batch.column(i) for i in range(1, 5))
            for i, text in enumerate(texts.to_pylist()):
                raw = text.encode()
                words = raw.split()
                at, h = np.asarray(starts[i].values), np.asarray(hashes[i].values)
                step = np.zeros(len(words) + 1, np.int64)
                at = at[np.isin(h, np.asarray(gone[i].values))]
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                stays = np.cumsum(step[:-1]) == 0
                rest = b" ".join([x for x, s in zip(words, stays.tolist()) if s])
                for column, v in zip(out, (_key(raw), int((~stays).sum()), rest.decode(), hashlib.sha256(rest).hexdigest())):
                    column.append(v)
            yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[1:]))], schema=schema)

    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    return rows.mapInArrow(run, kinds)


def _sources(table: DataFrame) -> DataFrame:
    """(doc_id, phrase): the phrases that each text names, for its smallest id; combined in each task before they are dealt."""
    one = table.where("doc_id is not null and size(phrases) > 0").groupBy("text_key").agg(F.min(F.struct("doc_id", "phrases")).alias("s"))
    return one.select("s.doc_id", F.explode("s.phrases").alias("phrase"))


def _recurring(named: DataFrame) -> DataFrame:
    """(doc_id, phrases): the phrases that windows of two texts name, by the smallest id that names them.

    What is shuffled is unreferenced on return, so that a sweep frees its files.
    """
    recurring = named.groupBy("phrase").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("hi")).where("doc_id < hi")
    return written(recurring.groupBy("doc_id").agg(F.collect_list("phrase").alias("phrases")), "recurring")


def _held(named: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(doc_id, phrases array<binary>): the words of the confirmed phrases that each document names."""
    return written(named.join(confirmed, "phrase").groupBy("doc_id").agg(F.collect_set("words").alias("phrases")), "held")


def _repeats(places: DataFrame) -> DataFrame:
    """(doc_id, gone): the windows (hashes) of each document that a smaller id holds."""
    windows = places.select("doc_id", F.explode("hashes").alias("hash"))
    # Written by itself, so that the join's large partitions can be split.
    source = written(windows.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("hash", "lo"), "repeated")
    return written(windows.join(source, "hash").where("doc_id > lo").groupBy("doc_id").agg(F.collect_set("hash").alias("gone")), "repeats")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, text_key, n_words, n_removed, kept, kept_sha256): words that a window repeated from a smaller id covers go.

    Each row gives a row. Words are `[^\\x20\\x09-\\x0D]+` of the whole text (null: none); windows are judged on the
    input. `kept` is the kept words joined by one space, or null where all are kept; kept_sha256 is the SHA-256 of the
    kept words joined by one space in either case. text_key (that of text_key()) tells rows of one id apart; such rows
    never repeat each other. A row with a null id is left whole and is nobody's source. Other columns are not read.
    """
    if not 0 < phrase <= window:
        raise ValueError("a phrase must fit in a window")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    table = written(_scanned(rows, window, phrase), "scanned")
    spark = docs.sparkSession
    texts = rows.where("text is not null")

    def of(wanted: DataFrame) -> DataFrame:
        return texts.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "phrases")

    # Copies of a whole text repeat all of its windows: only the text of the smallest id is looked into.
    recurring = _recurring(_sources(table))
    sweep(spark)
    confirmed = written(_phrase_words(of(recurring).select("text", "phrases"), phrase).groupBy("phrase").agg(F.min("words").alias("words")), "confirmed")
    release(recurring)
    sweep(spark)
    held = _held(_sources(table), confirmed)
    release(confirmed)
    sweep(spark)
    places = written(_occurrences(of(held), window, phrase), "occurrences")
    release(held)
    sweep(spark)
    gone = _repeats(places)
    sweep(spark)
    cut = written(_cut(places.join(gone, "doc_id").select("doc_id", "text", "starts", "hashes", "gone"), window).dropDuplicates(["doc_id", "text_key"]), "kept")
    release(places, gone)
    sweep(spark)
    first = written(table.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("text_key", "first"), "copied")
    light = table.select("doc_id", "text_key", "n_words", "words_sha256").join(first, "text_key", "left").join(cut.withColumnRenamed("n_removed", "removed").withColumnRenamed("kept", "rest").withColumnRenamed("kept_sha256", "rest_sha256"), ["doc_id", "text_key"], "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window)
    return light.select(
        "doc_id", "text_key", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("rest")).alias("kept"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest_sha256", "words_sha256")).alias("kept_sha256"),
    )
