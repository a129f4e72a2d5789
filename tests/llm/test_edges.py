"""What the operators promise beyond ordinary rows: bounds of memory, very long texts, letters, and independence of rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from facetry.llm import _shared, _words, byte_bpe, html_text, language_id, near_duplicates, packing, repeated_passages, sentencepiece_bpe, token_counts, token_store
from facetry.llm._shared import Memo, kept, tokenizer_path


def test_memo_is_bounded_and_right():
    asked = []

    def compute(keys):
        asked.extend(keys)
        return [k.encode() for k in keys]

    memo, r = Memo(compute, 50_000), random.Random(1)
    for _ in range(300):
        lists = [[str(int(r.expovariate(0.001))) for _ in range(50)], ["x" * 100, ""]]
        got = memo.lookup(lists)
        assert all(got[k] == k.encode() for x in lists for k in x)
        # A generation ends with the part of the input that takes it past its bound.
        assert memo.bytes < 50_000 + 52 * 1_000 and len(memo.new) + len(memo.old) < 1_200
    assert asked.count("x" * 100) == 300 and len(asked) < 300 * 52


def test_a_worker_keeps_one_operator():
    one = kept("one", lambda: object())
    assert kept("one", lambda: object()) is one
    kept("two")
    assert list(_shared._kept) == ["two"] and kept("one", lambda: object()) is not one


def test_shared_folder_must_be_set_on_a_cluster():
    class Context:
        master = "spark://far:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})

        @staticmethod
        def getConf():
            return {}

    with pytest.raises(ValueError, match="checkpoint"):
        _shared.shared_root(type("Session", (), {"sparkContext": Context}))


def test_byte_bpe_is_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    model, r = byte_bpe.ByteBPE(tokenizer_path("byte_bpe_50k.json"), most=20_000), random.Random(2)
    texts = ["".join(r.choice("aAbé thin  \n\r\t.,;'s(){}0½²x3\x1c ́漢😀<|endoftext|>'ll") for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["a<|endoftext|>b <|endoftext|>", "don't 'sx ab²3,c d''s", None, "q" * 3000, "a  b   c\n\n\nd e\nf"]
    for t, ids in zip(texts, model.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_byte_bpe_encodes_a_word_once():
    """Marks behind a word make no further string of it, wherever the text breaks."""
    model = byte_bpe.ByteBPE(tokenizer_path("byte_bpe_50k.json"))
    asked, compute = [], model.memo.compute
    model.memo.compute = lambda keys: asked.extend(keys) or compute(keys)
    r = random.Random(5)
    words = sorted({"".join(r.choice("abcdeéñß\u0436\u03b1") for _ in range(6)) for _ in range(300)})
    texts = [f"go {w}{m} and\n{w}{m}" for w in words for m in ["", ".", ",", "&&&", "'s!", "7"]]
    for t, ids in zip(texts, model.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == model.library.encode(t, add_special_tokens=False).ids, repr(t)
    assert len(asked) == len(set(asked)) and len(asked) <= 2 * len(words) + 10


def test_byte_bpe_of_arrow_arrays(monkeypatch):
    """Slices, nulls, empty and large arrays, white space beyond ASCII, and blocks that end anywhere between texts."""
    import pyarrow as pa

    model, r = byte_bpe.ByteBPE(tokenizer_path("byte_bpe_50k.json")), random.Random(7)
    letters = "ab \n.'sé漢”0\x85\xa0\u1680\u2003\u2028\u202f\u3000÷ж<|endoftext|>"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 12))) if r.random() < 0.9 else None for _ in range(3000)]
    want = [np.array(model.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for size in (1 << 23, 50, 1):
        monkeypatch.setattr(byte_bpe, "BLOCK", size)
        for kind in (pa.string(), pa.large_string()):
            column = pa.array(["before", *texts], kind)
            assert list(model.ids(column[1:])) == want and list(model.ids(column[11:500])) == want[10:499]
    assert list(model.ids(pa.array(["", None, ""]))) == [b""] * 3 and list(model.ids(pa.array([], pa.string()))) == []


def _task(monkeypatch, operator):
    """The function that an operator hands to mapInArrow, and the lists of strings that the encoder is then asked for."""
    from pyspark.sql.classic.dataframe import DataFrame

    runs, asked = [], []
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "mapInArrow", lambda df, run, schema: runs.append(run) or 1 / 0)
        with pytest.raises(ZeroDivisionError):
            operator()
    model = byte_bpe.ByteBPE(tokenizer_path("byte_bpe_50k.json"))
    compute = model.memo.compute
    model.memo.compute = lambda keys: asked.append(keys) or compute(keys)
    monkeypatch.setattr(byte_bpe, "load", lambda path: model)
    return runs[0], asked, model.library


def _rows():
    """5,000 short texts of 400 words with marks behind them, as one batch."""
    import pyarrow as pa

    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(400)]
    texts = [" ".join(r.choice(words) + r.choice(["", ".", ",", "!", "?", "7"]) for _ in range(12)) for _ in range(5000)]
    return texts, pa.record_batch([pa.array(range(5000), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_packing_encodes_by_the_block(spark, monkeypatch):
    run, asked, library = _task(monkeypatch, lambda: packing.pieces(spark.createDataFrame([(1, "x")], "doc_id long, text string")))
    texts, batch = _rows()
    got = [x for b in run(iter([batch])) for x in b.to_pylist()]
    assert [x["ids_crc32"] for x in got] == [zlib.crc32(np.array([*e.ids, 0], "<u4").tobytes()) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    # One question for the whole batch: words after a space without their marks, texts' first words with them.
    assert len(asked) == 1 and len(asked[0]) < 400 + 400 * 6 + 10


def test_token_store_encodes_by_the_block(spark, monkeypatch, tmp_path):
    texts, batch = _rows()
    run, asked, library = _task(monkeypatch, lambda: token_store.write(spark.createDataFrame([(1, "x")], "doc_id long, text string"), str(tmp_path)))
    monkeypatch.setattr(token_store, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    files = [x for b in run(iter([batch])) for x in b.to_pylist()]
    stored = [(d, ids.tolist()) for f in files for d, _, ids in token_store.Reader(f["file"]).documents()]
    assert stored == [(i, [*e.ids, 2]) for i, e in enumerate(library.encode_batch_fast(texts, add_special_tokens=False))]
    assert len(asked) == 1 and len(asked[0]) < 400 + 400 * 6 + 10


def test_memo_values_are_those_of_lookup():
    asked = []
    memo, r = Memo(lambda keys: asked.extend(keys) or [k.encode() for k in keys], 50_000), random.Random(1)
    for _ in range(300):
        keys = list({str(int(r.expovariate(0.001))) for _ in range(50)} | {"x" * 100, ""})
        assert memo.values(keys) == [k.encode() for k in keys]
        assert memo.bytes < 50_000 + 52 * 1_000 and len(memo.new) + len(memo.old) < 1_200
    assert asked.count("x" * 100) == 300 and len(asked) < 300 * 52
    assert memo.values([]) == []
    memo.PART, keys = 100, [str(i) for i in range(5_000)]
    assert memo.values(keys) == [k.encode() for k in keys] and memo.bytes < 50_000 + 100 * 210 and len(memo.new) + len(memo.old) < 800


def test_words_in_blocks(monkeypatch):
    texts = ["a bb  ccc", "x" * 500 + " y " * 30 + "z" * 20, None, "", "hello world " * 100, "q" * 7000, b"by tes"]
    whole = _words.Words(texts, lower=True)
    monkeypatch.setattr(_words, "BLOCK", 64)
    parts = _words.Words(texts, lower=True)
    assert (whole.hashes == parts.hashes).all() and (whole.firsts == parts.firsts).all()
    assert (whole.windows(3) == parts.windows(3)).all()


def test_very_long_texts(spark):
    """A text of three million characters, and one word of two million, through all operators of texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(5000)]
    long = " ".join(r.choice(vocabulary) for _ in range(500_000))
    texts = {1: long, 2: "ab" * 1_000_000, 3: long[1_000_000:2_000_000], 4: long + " end", 5: "short one"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(1)
    near = {x["doc_id"]: x for x in near_duplicates.near_duplicates(df).collect()}
    assert {i: x["component_id"] for i, x in near.items()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5}
    w = long.split()
    assert near[1]["n_shingles"] == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    cut = {x["doc_id"]: x for x in repeated_passages.without_repeats(df).collect()}
    assert cut[4]["n_removed"] == cut[1]["n_words"] == 500_000 and cut[4]["kept"] == "end" and cut[1]["n_removed"] == cut[2]["n_removed"] == 0
    middle = texts[3].split()
    # Only the words at its two ends may be cut pieces of words.
    assert cut[3]["n_removed"] >= len(middle) - 2
    sp, bpe = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    counts = {x["doc_id"]: x["n_tokens"] for x in token_counts.counted(df).collect()}
    pieces = {x["doc_id"]: x["n_tokens"] for x in sentencepiece_bpe.digests(df).collect()}
    assert counts == pieces == {i: len(sp.encode(t)) for i, t in texts.items()}
    stored = {x["doc_id"]: x["ids_crc32"] for x in token_store.round_trip(df).collect()}
    assert stored == {i: zlib.crc32(np.array([*bpe.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in texts.items()}


# --- language ------------------------------------------------------------------------------------------------------


def test_letters_are_of_category_l():
    assert language_id.words("² ½ ① Ⅷ 12 _ Æther-über'n 漢字") == ["æther", "über", "n", "漢字"]
    scorer = language_id.Scorer(["x", "y"], ["a", "b"], np.array([[0.9, 0.1], [0.1, 0.9]]))
    assert [p for p, _ in scorer.predict(["² ½ ①", None, "", "aaa", "bb b"])] == ["und", "und", "und", "x", "y"]


def test_long_pieces_and_words_are_whole():
    rng = np.random.default_rng(6)
    pieces = ["a", "b", "ab", "ba", "abababababab", "bbbbbbbbbbbbbbbbbbbb"]
    p = rng.random((len(pieces), 2)) / 3
    scorer = language_id.Scorer(["x", "y"], pieces, p)
    for word in ("ab" * 30, "b" * 300, "abc" + "ab" * 100 + "ca", "c" * 900):
        log = np.full((len(word) + 1, 2), -np.inf)
        log[0] = 0
        for j in range(1, len(word) + 1):
            for k, piece in enumerate(pieces):
                if word[:j].endswith(piece):
                    log[j] = np.logaddexp(log[j], log[j - len(piece)] + np.log(p[k]))
            if word[j - 1] == "c":
                log[j] = np.logaddexp(log[j], log[j - 1] + language_id.UNKNOWN)
        assert np.allclose(scorer.word_scores([word])[0], log[-1])
    assert any(len(x) > 8 for x in language_id.vocabulary(tokenizer_path("piece_bpe_32k.model")))


def test_scores_depend_on_the_text_alone(monkeypatch):
    r, pieces = random.Random(7), ["a", "b", "ab", "bc", "c"]
    p = np.random.default_rng(7).random((5, 3))
    texts = ["".join(r.choice("abc  ") for _ in range(r.randint(0, 60))) for _ in range(300)]
    whole = list(language_id.Scorer(["x", "y", "z"], pieces, p).predict(texts))
    alone = language_id.Scorer(["x", "y", "z"], pieces, p)
    monkeypatch.setattr(alone, "MOST", 2_000)
    assert [next(iter(alone.predict([t]))) for t in texts] == whole


def test_equal_scores_go_to_the_first_language():
    scorer = language_id.Scorer(["x", "y"], ["a"], np.array([[0.5, 0.5]]))
    assert list(scorer.predict(["a a"])) == [("x", 0.5)]


# --- pages ---------------------------------------------------------------------------------------------------------


def test_unmarked_pages_give_the_same_texts(spark):
    """With the elements that mark the main content renamed, the scan alone finds the same texts."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").select("html").collect() if r["html"]]
    marked = [p for p in pages if html_text._MARK.search(p)]
    half = len(marked) // 2
    weights = html_text.fit(sum((html_text.observed(p) for p in marked[:half]), html_text.Counter()))
    same = total = 0
    for page in marked[half:]:
        bare = html_text.re.sub(r"(?i)(</?)(?:article|main)(?=[\s>])", r"\1div", page)
        assert not html_text._MARK.search(bare)
        total += 1
        same += html_text.extract(bare, weights) == html_text.extract(page, weights)
    assert total > 50 and same >= 0.98 * total


def test_pages_are_independent_rows(spark):
    html = "<html><body><nav>menu</nav><article><p>one two</p></article></body></html>"
    df = spark.createDataFrame([(1, "u", html, "t"), (1, "u", html, "t"), (None, None, html, "t"), (2, "v", None, "t")], "page_id long, url string, html string, draw string").withColumnRenamed("t", "text")
    got = [tuple(r) for r in html_text.main_text(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "one two", 7), (1, "u", "one two", 7), (None, None, "one two", 7), (2, "v", "", 0)], key=str)


def test_the_sample_of_pages_is_that_of_the_least_hashes(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    whole = html_text.learned(df)
    monkeypatch.setattr(html_text, "LABELLED", 5)
    few = html_text.learned(df)
    assert few and whole and set(few) <= set(whole) | set(few)


# --- rows without an id --------------------------------------------------------------------------------------------


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "one two three"), (None, "four"), (4, "one two three"), (None, None)], "doc_id long, text string")
    got = packing.packed(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_tokens"]) for r in got) == sorted((d is None, len(list(byte_bpe.load(tokenizer_path("byte_bpe_50k.json")).ids([t]))[0]) // 4 + 1) for d, t in [(None, "one two three"), (None, "four"), (4, "one two three"), (None, None)])
    assert {r["sequence_id"] for r in got} == {0} and sum(r["length"] for r in got) == max(r["offset"] + r["length"] for r in got)
    near = near_duplicates.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near) == [("4", "4", True)] + [("None", "None", True)] * 3


def test_digests_of_the_kept_words(spark):
    words = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(["a", *words[3:18], "b"]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeated_passages.without_repeats(df).collect()}
    assert got[2]["n_removed"] == 15 and got[2]["kept_sha256"] == hashlib.sha256(b"a b").hexdigest()
