"""Language ID (operator 7): unigram piece models, a word's score summed over all its segmentations.

The vocabulary is fixed and public. For each language, piece probabilities are fitted by expectation-maximisation on a
bounded sample of labelled documents; a forward pass over the pieces that end at each place sums the probability of all
segmentations of a word. A text's score is the sum of its words' log scores.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import kept, slices, small, tokenizer_path

#: Training sample: at most so many documents of a language, each of at most so many characters, taken whole; rounds of fitting.
DOCUMENTS, CHARACTERS, ROUNDS = 300, 20_000, 3
#: Words of evidence that decide a score; more words leave it as sure.
EVIDENCE = 20
#: Log probability of a letter that is no piece by itself.
UNKNOWN = float(np.log(1e-7))
#: Letters of a group of words that are scored together, about.
GROUP = 1 << 16
UNDETERMINED = "und"
#: Letters are those of the Unicode category L: no digits, marks or letter-like numbers.
_LETTERS = regex.compile(r"\p{L}+")


def vocabulary(path: str) -> list[str]:
    """Lower-case letter pieces of the public vocabulary."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).replace("▁", "").lower() for i in range(sp.get_piece_size()) if not sp.is_byte(i)}
    return sorted(p for p in found if _LETTERS.fullmatch(p))


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return _LETTERS.findall((text or "").lower())


class Pieces:
    """The pieces as a trie in arrays, which many words of one length are walked through at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        nodes: dict[tuple[int, int], int] = {}
        number = [-1]
        for k, piece in enumerate(pieces):
            at = 0
            for c in piece:
                key = at, ord(c)
                if key not in nodes:
                    nodes[key] = len(number)
                    number.append(-1)
                at = nodes[key]
            number[at] = k
        keys = np.array([a << 21 | c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.number = np.array(number, np.int64)

    def spans(self, group: list[str]):
        """(start, end, words, their pieces) for words of one length, ascending by start; and, where a letter is no
        piece by itself, (start, start + 1, words, None)."""
        n = len(group[0])
        codes = np.array(group, f"U{n}").view(np.uint32).reshape(len(group), n).astype(np.int64)
        for i in range(n):
            alive, node = np.arange(len(group)), np.zeros(len(group), np.int64)
            for j in range(i, n):
                if not len(alive) or not len(self.keys):
                    if j == i:
                        yield i, j + 1, np.arange(len(group)), None
                    break
                key = node << 21 | codes[alive, j]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                here = self.keys[at] == key
                if j == i:
                    first = np.where(here, self.number[self.child[at]], -1)
                    bare = np.flatnonzero(first < 0)
                    if len(bare):
                        yield i, j + 1, bare, None
                alive, node = alive[here], self.child[at[here]]
                got = self.number[node]
                ends = got >= 0
                if ends.any():
                    yield i, j + 1, alive[ends], got[ends]


def _forward(spans, logs: np.ndarray, count: int, n: int) -> np.ndarray:
    """Log probability of each prefix, (n + 1, words, languages), summed over all its segmentations."""
    a = np.full((n + 1, count, logs.shape[1]), -np.inf)
    a[0] = 0
    for i, j, at, k in spans:
        a[j][at] = np.logaddexp(a[j][at], a[i][at] + (UNKNOWN if k is None else logs[k]))
    return a


def _by_length(group: list[str]):
    by: dict[int, list[int]] = {}
    for at, w in enumerate(group):
        by.setdefault(len(w), []).append(at)
    for n, at in by.items():
        step = max(1, GROUP // n)
        for lo in range(0, len(at), step):
            yield n, at[lo : lo + step]


def fit(counts: dict[str, dict[str, float]], pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities, a column for each language in sorted order. counts: language -> word -> n."""
    index, languages = Pieces(pieces), sorted(counts)
    group = sorted({w for c in counts.values() for w in c})
    weight = np.array([[counts[x].get(w, 0.0) for x in languages] for w in group]).reshape(len(group), len(languages))
    p = np.full((len(pieces), len(languages)), 1 / max(1, len(pieces)))
    for _ in range(rounds):
        expected, logs = np.full(p.shape, 0.01), np.log(p)
        for n, at in _by_length(group):
            some = [group[i] for i in at]
            spans = list(index.spans(some))
            a = _forward(spans, logs, len(some), n)
            b = np.full_like(a, -np.inf)
            b[n] = 0
            for i, j, w, k in reversed(spans):
                use = b[j][w] + (UNKNOWN if k is None else logs[k])
                b[i][w] = np.logaddexp(b[i][w], use)
                if k is not None:
                    got = np.exp(a[i][w] + use - a[n][w]) * weight[at][w]
                    for x in range(len(languages)):
                        expected[:, x] += np.bincount(k, got[:, x], len(pieces))
        p = expected / expected.sum(0)
    return p


class Scorer:
    """Log probabilities of texts in each language; of chunks between white space, the latest are kept in a table."""

    #: Bytes of the kept chunks, about, and the most characters of one.
    MOST, LONGEST = 64 << 20, 64

    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray):
        self.languages, self.index, self.logs = languages, Pieces(pieces), np.log(p)
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        # Per chunk: its number of words, and its log probability in each language.
        self.table = np.zeros((4096, len(self.languages) + 1))
        self.used = self.bytes = 0

    def word_scores(self, group: list[str]) -> np.ndarray:
        out = np.zeros((len(group), len(self.languages)))
        for n, at in _by_length(group):
            some = [group[i] for i in at]
            out[at] = _forward(self.index.spans(some), self.logs, len(some), n)[n]
        return out

    def chunk_scores(self, chunks: list[str]) -> np.ndarray:
        """Per chunk its number of words and the sum of their log probabilities."""
        parts = [words(c) for c in chunks]
        flat = [w for x in parts for w in x]
        distinct = list(dict.fromkeys(flat))
        at = {w: i for i, w in enumerate(distinct)}
        each = self.word_scores(distinct)[np.fromiter((at[w] for w in flat), np.int64, len(flat))]
        return np.column_stack([list(map(len, parts)), _sums(each, [len(x) for x in parts])])

    def _rows(self, chunks: list[str]) -> np.ndarray:
        """The rows of the table for each chunk; what isn't known is scored, all together."""
        fresh = list({c for c in chunks if c not in self.rows})
        if fresh and self.bytes > self.MOST:
            self.forget()
            fresh = list(set(chunks))
        if fresh:
            first, self.used = self.used, self.used + len(fresh)
            if self.used > len(self.table):
                grown = np.zeros((max(self.used, 2 * len(self.table)), self.table.shape[1]))
                grown[:first] = self.table[:first]
                self.table = grown
            self.table[first : self.used] = self.chunk_scores(fresh)
            self.rows.update(zip(fresh, range(first, self.used)))
            self.bytes += sum(200 + 8 * self.table.shape[1] + 2 * len(c) for c in fresh)
        out = self.table[np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))]
        for c in fresh:
            if len(c) > self.LONGEST:
                del self.rows[c]
        return out

    def predict(self, texts: list[str | None]):
        """(language, score) of each text; a text's sums depend on nothing beside it."""
        chunks = [(t or "").split() for t in texts]
        for row in _sums(self._rows([c for x in chunks for c in x]), [len(x) for x in chunks]):
            n, logs = round(row[0]), row[1:]
            if not n or not self.languages:
                yield UNDETERMINED, 0.0
                continue
            tempered = logs * min(1.0, EVIDENCE / n)
            best = int(logs.argmax())
            yield self.languages[best], float(1 / np.exp(tempered - tempered[best]).sum())


def _sums(rows: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Sums of consecutive groups of rows, each group by itself in the order of its rows."""
    sizes = np.asarray(sizes, np.int64)
    out = np.zeros((len(sizes), rows.shape[1]))
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[some])
    return out


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, model_file: str | None = None, documents: int = DOCUMENTS, characters: int = CHARACTERS) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, probabilities) from a bounded sample of labelled rows: `documents` of each language, taken by
    a hash of the id among those of at most `characters`, which are read whole. The sample's bound is the same for every size of the table."""
    pieces = vocabulary(model_file or tokenizer_path("piece_bpe_32k.model"))
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & (F.length("text") <= characters))
    sizes = {r["lang"]: r["n"] for r in rows.select("lang").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # Twice the wanted share, then the smallest hashes of a language: what is sorted is bounded too.
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * documents / n + 50 / n))).otherwise(share)
    some = rows.withColumn("draw", draw).where(F.col("draw") <= share).select("lang", "draw", "id", "text")
    counts: dict[str, dict[str, float]] = {lang: {} for lang in sizes}
    taken = dict.fromkeys(sizes, 0)
    # One scan for all languages; what passes it is bounded, so that one task may order it.
    for r in some.repartition(1).sortWithinPartitions("lang", "draw", "id").toLocalIterator():
        if taken[r["lang"]] < documents:
            taken[r["lang"]] += 1
            c = counts[r["lang"]]
            for w in words(r["text"]):
                c[w] = c.get(w, 0.0) + 1
    return sorted(counts), pieces, fit(counts, pieces)


def predicted(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text by a model of train(), and the columns named in `keep`.

    `und` and 0 where the text is null or has no letter, or where nothing was learned. Each row gives a row, repeated
    and null ids too; equal scores go to the first language in sorted order. Other columns are not read.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    names = ["doc_id", "lang_pred", "score", *keep]

    def run(batches):
        scorer = kept(("language", key), lambda: Scorer(*shared.value))
        for b in small(batches):
            texts = b.column(1).to_pylist()
            got = [x for lo, hi in slices([len(t or "") for t in texts], 1 << 20) for x in scorer.predict(texts[lo:hi])]
            yield pa.record_batch([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), *b.columns[2:]], names=names)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *[docs[c] for c in keep])
    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[docs.schema[c] for c in keep]])
    return rows.mapInArrow(run, kinds)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: CRC-32 of its id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model_file: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that aren't held out, predicted for all."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col, model_file)
    return predicted(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
