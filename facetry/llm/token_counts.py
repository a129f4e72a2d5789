"""Token counts (operator 8): pieces counted once for each distinct pretoken, joined to the documents' frequencies.

Pretokens are counted over the whole corpus; the library splits each distinct one once. The most frequent, whose number
and length are bounded, go to all tasks; the rest of a document's frequencies meets its counts in a join on the
pretoken. No ids are kept.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sentencepiece_bpe
from ._shared import kept, slices, small, sweep, tokenizer_path, written

#: Of the broadcast counts: at most so many pretokens of at most so many characters.
FREQUENT, LONGEST = 262_144, 48
#: Distinct pretokens that a task holds, and characters that it reads, before it hands its counts on.
HELD, READ = 300_000, 16 << 20


def _local(path: str):
    """How texts part into pretokens, and the library: both for all stages of this operator."""
    return kept(("token_counts", path), lambda: (sentencepiece_bpe.PrefixTable(path).pretokens, sentencepiece.SentencePieceProcessor(model_file=path)))


def _library(path: str) -> sentencepiece.SentencePieceProcessor:
    return _local(path)[1]


def piece_counts(parts: list[str], path: str) -> list[int]:
    """How many ids the library gives each pretoken where it stands in a text.

    The library puts one space before a text: it takes the place of a pretoken's own first space, or stands, with the
    line feed that ends it, for two ids of its own before a pretoken without one.
    """
    sp = _library(path)
    spaced = [p[:1] == " " for p in parts]
    got = sp.encode([p[1:] if s else "\n" + p for p, s in zip(parts, spaced)], num_threads=1)
    # A pretoken that is one space is the empty text with the library's space, which it leaves out.
    return [1 if p == " " else len(g) - 2 * (not s) for p, s, g in zip(parts, spaced, got)]


def _frequent(distinct: DataFrame, most: int):
    """A condition that at most `most` of the short pretokens meet: a count at or above a step of a sixteenth of an octave.

    The steps' sizes are a table of at most a thousand rows; only what meets the condition ever leaves the executors.
    """
    step, short = F.floor(F.log2("n") * 16), F.length("piece") <= LONGEST
    steps = distinct.where(short).groupBy(step.alias("step")).agg(F.count("*").alias("m")).collect()
    lowest, total = 1 << 20, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["m"]
        if total > most:
            break
        lowest = r["step"]
    return short & (step >= lowest)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text as the library splits it; a null text counts as empty: 0 and 0.

    Each row gives a row, repeated and null ids too; other columns are not read.
    """
    path = model_file or tokenizer_path("piece_bpe_32k.model")
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    pair = pa.schema([("piece", pa.string()), ("n", pa.int64())])

    def corpus(batches):
        split, held, read = _local(path)[0], Counter(), 0

        def counts():
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=pair)

        for b in small(batches):
            for t in b.column(0).to_pylist():
                held.update(split(t or ""))
                read += len(t or "")
                if len(held) > HELD or read > READ:
                    yield counts()
                    held.clear()
                    read = 0
        yield counts()

    def pieces(batches):
        schema = pa.schema([*pair, ("k", pa.int32())])
        for b in small(batches):
            parts = b.column(0).to_pylist()
            counts = [k for lo, hi in slices([len(p) for p in parts], 1 << 16) for k in piece_counts(parts[lo:hi], path)]
            yield pa.record_batch([*b.columns, pa.array(counts, pa.int32())], schema=schema)

    distinct = rows.select("text").mapInArrow(corpus, "piece string, n long").where("piece <> ''").groupBy("piece").agg(F.sum("n").alias("n"))
    distinct = written(distinct.mapInArrow(pieces, "piece string, n long, k int"), "pretokens")
    frequent = {r[0]: r[1] for r in distinct.where(_frequent(distinct, FREQUENT)).select("piece", "k").collect()}
    known = spark.sparkContext.broadcast(frequent)
    sweep(spark)
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("base", pa.int64()), ("rest", pa.map_(pa.string(), pa.int32()))])

    def frequencies(batches):
        split, get = _local(path)[0], known.value.get
        row = TaskContext.get().partitionId() << 33
        for b in small(batches):
            sizes, base, rest = [], [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                sizes.append(len(t.encode()))
                parts = split(t)
                got = list(map(get, parts))
                if None in got:
                    rest.append(list(Counter(p for p, k in zip(parts, got) if k is None and p).items()))
                    base.append(sum(k for k in got if k is not None))
                else:
                    rest.append([])
                    base.append(sum(got))
            numbers = pa.array(range(row, row + len(sizes)), pa.int64())
            row += len(sizes)
            yield pa.record_batch([numbers, b.column(0), pa.array(sizes, pa.int64()), pa.array(base, pa.int64()), pa.array(rest, out.field(4).type)], schema=out)

    per = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("base", T.LongType()), T.StructField("rest", T.MapType(T.StringType(), T.IntegerType()))])
    # Rows are numbered where they are written: what reads the table sees one number, whichever attempt wrote it.
    table = written(rows.mapInArrow(frequencies, per), "frequencies")
    rare = table.select("row", F.explode("rest").alias("piece", "f")).join(distinct.select("piece", "k"), "piece").groupBy("row").agg(F.sum(F.col("f") * F.col("k")).alias("more"))
    return table.drop("rest").join(rare, "row", "left").select("doc_id", "n_bytes", (F.col("base") + F.coalesce("more", F.lit(0))).cast("long").alias("n_tokens"))
