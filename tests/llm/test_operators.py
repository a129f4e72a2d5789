"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import html
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.llm import html_text, language_id, near_duplicates, packing, projection_search, repeated_passages, sentencepiece_bpe, token_counts, token_store, topk_search
from facetry.llm._shared import tokenizer_path
from facetry.llm.components import components

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SPECIAL = [None, "", " ", "a", "\n", "  two  spaces ", "tab\there\r\n", "<|endoftext|> and <s>", "▁mark▁", "漢字😀é\x00\x01", "x" * 5000, "the " * 3000, "12345 67", "a  b   c    d", "don't we'll I'm", "a \n b\n\nc", "\x1c \x85   x"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, length long, kept string, node long"


def table(spark, texts, langs=None):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, langs[i] if langs else "en", None, None, 7, 7, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def some_texts(n, seed=1, words=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgéßñ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    return [" ".join(r.choice(vocabulary) + r.choice(["", "", "", ",", ".\n"]) for _ in range(r.randint(0, words))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return SPECIAL + some_texts(60) + SPECIAL[:4]


# --- subword models ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_prefix_table_is_the_library(sp):
    t = sentencepiece_bpe.load(tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(3)
    alphabet = "aAbe thin  \n\r\t.,;(){}éüß漢😀\x00▁<>0x"
    for text in ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(3000)] + [x or "" for x in SPECIAL] + [" " * n for n in range(60)]:
        ids = sp.encode(text)
        assert t.encode(text) == ids, repr(text)
        assert t.decode(ids) == sp.decode(ids), repr(text)


def test_compatible_pairs_are_encodings(sp):
    """Two pieces are compatible exactly if the library splits their text into them."""
    t = sentencepiece_bpe.load(tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(4)
    ids = [i for i in t.left if t.names[i].isascii() and " " not in t.names[i]]
    for _ in range(2000):
        a, b = r.choice(ids), r.choice(ids)
        alone = sp.encode("\n" + t.names[a] + t.names[b])[2:]
        assert t.compatible(a, b) == (alone == [a, b])


def test_op5(spark, texts, sp):
    got = sentencepiece_bpe.digests(table(spark, texts)).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    whole = {r["id"]: r for r in sentencepiece_bpe.encoded(table(spark, texts)).collect()}
    assert all(whole[i]["ids"] == sp.encode(t or "") and whole[i]["decoded"] == sp.decode(sp.encode(t or "")) for i, t in enumerate(texts))
    assert sentencepiece_bpe.digests(table(spark, [])).count() == 0


def test_op8(spark, texts, sp):
    got = {r["doc_id"]: r for r in token_counts.counted(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(sp.encode(t or ""))), repr(t)
    assert token_counts.counted(table(spark, [])).count() == 0


def test_op8_keeps_repeated_rows(spark, monkeypatch):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "three"), (2, "zebra " * 100)], "doc_id long, text string")
    monkeypatch.setattr(token_counts, "FREQUENT", 1)
    got = token_counts.counted(df).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in got)) == [(False, 1), (False, 1), (False, 2), (True, 0)]
    assert len({r["n_tokens"] for r in got if r["doc_id"] == 1}) == 1


# --- token files and packing ---------------------------------------------------------------------------------------


def test_op9(spark, texts, bpe, tmp_path):
    manifest = token_store.write(table(spark, texts), f"file://{tmp_path}")
    got = token_store.digests(spark, manifest).orderBy("doc_id").collect()
    before = 0
    for r, t in zip(got, texts):
        ids = np.array([*bpe.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (before, len(ids), zlib.crc32(ids.tobytes())), repr(t)
        before += len(ids)
    assert len(got) == len(texts)
    some = token_store.read(spark, manifest, [3, 10, 10_000]).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in some] == [3, 10] and some[0]["ids"][:-1] == bpe.encode(texts[3], add_special_tokens=False).ids
    assert token_store.round_trip(table(spark, [])).count() == 0


def test_files_are_read_by_frame(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_IDS", 100)
    rng = np.random.default_rng(1)
    docs = [(None, rng.integers(0, 60000, 5)), *[(i // 2 * 2, rng.integers(0, 60000, int(rng.integers(0, 250)))) for i in range(50)]]
    w = token_store.Writer(str(tmp_path / "a.zst"), 2)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    r = token_store.Reader(str(tmp_path / "a.zst"))
    got, start = list(r.documents()), 0
    assert len(got) == len(docs)
    for (d, ids), (key, at, read) in zip(docs, got):
        assert (key == token_store.NO_ID) == (d is None) and at == start and read.tolist() == ids.tolist()
        start += len(ids)
    r = token_store.Reader(str(tmp_path / "a.zst"))
    assert [k for k, _, _ in r.documents([20])] == [20, 20] and r.frames_read < len(r.table) / 2
    raw = bytearray((tmp_path / "a.zst").read_bytes())
    import io

    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(raw)), read_across_frames=True).read()
    assert len(plain) == sum(t[1] for t in r.table)
    frame = r.places[3]
    raw[frame + r.table[3][0] - 3] ^= 0xFF
    (tmp_path / "a.zst").write_bytes(raw)
    with pytest.raises(Exception):
        list(token_store.Reader(str(tmp_path / "a.zst")).documents())


def test_files_of_repeated_ids(spark):
    df = spark.createDataFrame([(5, "b"), (5, "a"), (None, "n"), (5, "a")], "doc_id long, text string")
    got = token_store.round_trip(df).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 5, 5, 5] and got[1]["ids_crc32"] == got[2]["ids_crc32"] != got[3]["ids_crc32"]


def check_packing(rows, ids, capacity=1024):
    cover: dict = {}
    for r in rows:
        x = np.array(ids[r["doc_id"]], "<u4")
        assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
        cover.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for d, x in ids.items():
        at = 0
        for s, n in sorted(cover[d]):
            assert s == at and n > 0
            at += n
        assert at == len(x)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return sum(r["length"] for r in rows) / (len(sequences) * capacity)


def test_op6(spark, texts, bpe, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 10)
    many = texts + some_texts(300, 5, 400)
    ids = {i: [*bpe.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(many)}
    assert check_packing(packing.packed(table(spark, many)).collect(), ids) > 0.97
    assert packing.packed(table(spark, [])).count() == 0


def test_packing_of_equal_lengths(spark):
    got = packing.packed(table(spark, ["same"] * 500)).collect()
    assert len(got) == 500 and len({(r["sequence_id"], r["offset"]) for r in got}) == 500


@pytest.mark.parametrize("seed", range(6))
def test_cutting_stock(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.integers(5, 80))
    need = Counter(r.integers(1, capacity + 1, int(r.integers(1, 500))).tolist())
    out = packing.cutting_stock(need, capacity)
    made: Counter = Counter()
    for pattern, n in out.items():
        assert sum(pattern) <= capacity
        for k in pattern:
            made[k] += n
    assert made == need
    least = -(-sum(k * n for k, n in need.items()) // capacity)
    assert sum(out.values()) <= sum(packing.first_fit(dict(need), capacity).values()) + 2 and sum(out.values()) >= least


def test_column_generation_beats_first_fit():
    # First-fit puts 51 with 27; 51 with 26 and 23, or 27 twice with 23 twice, leave nothing.
    need = {51: 600, 27: 600, 26: 600, 23: 1200}
    best = sum(packing.cutting_stock(need, 100, gap=1e-6).values())
    assert best == 900 < sum(packing.first_fit(dict(need), 100).values())


def test_knapsack():
    value = np.zeros(10)
    value[[2, 3]] = 3.0, 4.5
    best, counts = packing.knapsack(value, 10)
    assert best == pytest.approx(10.5) and counts[2] == 2 and counts[3] == 1


# --- duplicates ----------------------------------------------------------------------------------------------------


def words_of(t, lower):
    raw = (t or "").encode()
    return (raw.lower() if lower else raw).split()


def brute_components(texts):
    sets = []
    for t in texts:
        w = words_of(t, True)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies(n, seed=2):
    r = random.Random(seed)
    base = [some_texts(1, s, 400)[0].split() * 2 for s in range(4)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
            if w:
                w[r.randrange(len(w))] = r.choice(["zz", "yy", "Q"])
        if r.random() < 0.3:
            w = w[r.randint(0, 10) :] + ["tail"] * r.randint(0, 10)
        out.append(" ".join(w))
    return out


def test_op3(spark, texts, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    many = [*texts, *near_copies(150), "One TWO three four five six", "one two three four five six", "one two", "ONE\x0btwo", "one two three"]
    random.Random(7).shuffle(many)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(table(spark, many)).collect()}
    assert got == brute_components(many)
    assert near_duplicates.near_duplicates(table(spark, [])).count() == 0
    empty = near_duplicates.near_duplicates(table(spark, [None, ""])).collect()
    assert [(r["n_shingles"], r["component_id"] == r["doc_id"], r["kept"]) for r in empty] == [(0, True, True)] * 2


def test_op3_odd_ids(spark):
    df = spark.createDataFrame([(9, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (5, None)], "doc_id long, text string")
    got = near_duplicates.near_duplicates(df).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter([(9, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (5, 5, True)])


def test_bands_follow_the_similarity():
    assert [near_duplicates.banding(p) for p in (85, 80, 50)] == [(16, 4), (22, 4), (41, 2)]
    for p in (10, 30, 50, 70, 80, 90, 99, 100):
        bands, rows = near_duplicates.banding(p)
        assert (1 - (p / 100) ** rows) ** bands <= 1e-5 and bands * rows <= 128


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = np.sort(pool[:200]), np.sort(pool[100:])
    values, owner = np.r_[a, b], np.r_[np.zeros(200, int), np.ones(200, int)]
    s = near_duplicates.superminhash(values, owner, 2, 64)
    assert np.isfinite(s).all() and abs((s[0] == s[1]).mean() - 1 / 3) < 0.2
    # Every place is reached even by one element, each by another visit.
    one = near_duplicates.superminhash(values[:1], owner[:1], 1, 64)[0]
    assert sorted(one.astype(int)) == list(range(64))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 50), (100, 70), (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 31), 0), 0: 0, 100: 50, 70: 50, 50: 50} or got == {**dict.fromkeys(range(1, 31), 0), 100: 50, 70: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts):
    first, out = {}, {}
    for i, t in enumerate(texts):
        w = words_of(t, False)
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for i, t in enumerate(texts):
        w = words_of(t, False)
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def passages(n, seed=3):
    r = random.Random(seed)
    shared = [" ".join(some_texts(1, 100 + s, 120)[0].split()[:k]) for s, k in enumerate([12, 13, 14, 30, 60, 60])]
    out = []
    for i in range(n):
        parts = [some_texts(1, 1000 + i, 60)[0]]
        for _ in range(r.randint(0, 3)):
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        out.append(r.choice(["\n", " ", "\t"]).join(parts))
    return out + out[:5] + ["the " * 40, "the " * 30, "The " * 30]


def test_op4(spark, texts, monkeypatch):
    monkeypatch.setattr(repeated_passages, "SHARD", 2000)
    many = [*texts, *passages(80)]
    got = {r["doc_id"]: r for r in repeated_passages.without_repeats(table(spark, many)).collect()}
    want = brute_repeats(many)
    assert len(got) == len(many)
    for i, (n, removed, sha, kept) in want.items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, removed, sha), i
        assert got[i]["kept"] == (kept if removed else None)
    assert repeated_passages.without_repeats(table(spark, [])).count() == 0


def test_op4_odd_ids(spark):
    long = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(3, long), (3, long), (3, long + " x"), (None, long), (2, None), (7, "y " + long)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_removed"]) for r in repeated_passages.without_repeats(df).collect())
    assert got == Counter([(3, 0), (3, 0), (3, 0), (None, 0), (2, 0), (7, 20)])


def test_automaton_locates_phrases():
    from facetry.llm._words import Words

    texts = ["a b c\td e f", "x a b  c y", "b c d", "aa b c d b c", "d"]
    w = Words([repeated_passages._spaced(t) for t in texts], lower=False)
    here = repeated_passages.located(w, repeated_passages.automaton([b"a b c", b"b c d"]))
    assert np.flatnonzero(here).tolist() == [0, 1, 7, 11, 15]
    assert not repeated_passages.located(w, repeated_passages.automaton([])).any()


def test_op4_rests_on_the_automata(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, "a " + long), (2, long + " b"), (3, long + "\n" + long)], "doc_id long, text string")
    count = lambda: {r["doc_id"]: r["n_removed"] for r in repeated_passages.without_repeats(df).collect()}
    assert count() == {1: 0, 2: 20, 3: 40}
    # Without the words of the confirmed phrases the automata are empty, and nothing is located.
    monkeypatch.setattr(repeated_passages, "_phrase_words", lambda rows, phrase: rows.selectExpr("cast(null as long) phrase", "cast(null as binary) words").limit(0))
    assert count() == {1: 0, 2: 0, 3: 0}


def test_sliding_least():
    v = np.random.default_rng(1).integers(0, 1000, 50).astype(np.uint64)
    for k in (1, 2, 3, 8, 9, 50, 51):
        assert repeated_passages.sliding_least(v, k).tolist() == [v[i : i + k].min() for i in range(len(v) - k + 1)]


# --- language ------------------------------------------------------------------------------------------------------


def test_op7(spark):
    from itertools import product

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, "en", None, None), (10_001, "12 34 !", "fr", None, None), (10_002, "", None, None, None), (10_002, "the of and", None, None, None), (None, "the of", "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    every = docs.unionByName(extra)
    got = language_id.identified(every).collect()
    assert len(got) == every.count()
    by = {(r["doc_id"], r["lang_pred"]): r for r in got}
    for d in (10_000, 10_001, 10_002):
        assert by[d, "und"]["score"] == 0
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    kept_out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert kept_out and sum(r["lang_pred"] == truth[r["doc_id"]] for r in kept_out) / len(kept_out) >= 0.97
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    none = language_id.identified(every.limit(0))
    assert none.count() == 0
    assert [r["lang_pred"] for r in language_id.identified(extra.where("text is null")).collect()] == ["und"]
    assert list(product("a", "b")) == [("a", "b")]


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "bc", "c"]
    p = np.random.default_rng(1).random((5, 2))
    s = language_id.Scorer(["x", "y"], pieces, p)
    want = {"abc": [["a", "b", "c"], ["ab", "c"], ["a", "bc"]], "ab": [["a", "b"], ["ab"]], "cc": [["c", "c"]]}
    got = s.word_scores(list(want))
    for row, splits in zip(got, want.values()):
        total = sum(np.prod([p[pieces.index(x)] for x in split], axis=0) for split in splits)
        assert np.allclose(np.exp(row), total)


# --- pages ---------------------------------------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("plain words only", "plain words only"),
    ("<html><body><nav><a href='/'>home</a> <a>more</a></nav><article><h1>Big &amp; bold</h1><p>One <b>two</b>three.<p>Four\n  five</article><div class='comments'><p>I like it</p></div><footer>&copy; us</footer></body></html>", "Big & bold One twothree. Four five"),
    ("<body><div class=ad>Buy now</div><main><header><h2>Title</h2></header><p>Text a &lt; b &#233; &eacute;</p><form><input name=q> Search <button>Go</button></form><p>End.</p></main><aside>Side</aside>", "Title Text a < b é é End."),
    ("<article><p>kept</p><script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>too</p>", "kept too"),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>cut off</p><div cla", "cut off"),
    ("<div class='ad'>unclosed<article><p>the text of it</p></article><section class='comments'><article><p>a reader's words are long enough</p></article></section>", "the text of it"),
    ("<article class='comment'><p>only this</p></article><div><p>and the body of the page goes on for a while</p></div>", "and the body of the page goes on for a while"),
    ("<main><p>a b c</p><aside class='related'><a>x</a><a>y</a></aside><p>d</p></main><div>not this one, though it is rather long</div>", "a b c d"),
    ("<body class='has-sidebar'><article><p>a <a href='x'>link</a> inside</p></article></body>", "a link inside"),
    ("<div id=cookie-notice><p>We use cookies</p></div><div><p>The story is this one, and it goes on.</p></div>", "The story is this one, and it goes on."),
]


def test_op2(spark):
    df = spark.createDataFrame([(i, None if i == 1 else f"http://x/{i}", h, "x", "y") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string, n_chars string")
    for weights in (None, html_text.DEFAULT):
        got = {r["page_id"]: r for r in html_text.main_text(df, weights=weights).collect()}
        for i, (_, want) in enumerate(PAGES):
            assert got[i]["text"] == want, PAGES[i]
            assert got[i]["n_chars"] == len(want)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_op2_on_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        h = r["html"]
        body = h[h.find("<article>") + 9 : h.find("</article>") if "</article>" in h else len(h)]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", body) if False else re.sub(r"<[a-zA-Z/][^>]*(?:>|\Z)", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)).split())
        assert r["text"] == want


def test_html_scan_is_linear():
    import time

    for evil in ("<" * 50_000, "<a " * 30_000, '<a b="' * 20_000, "&" * 100_000, "<div class='ad'>" * 20_000, "<!--" * 30_000):
        t = time.time()
        html_text.extract(evil)
        assert time.time() - t < 20


# --- vectors -------------------------------------------------------------------------------------------------------


def vectors(spark, n=400, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((8, dim))
    x = (centers[rng.integers(0, 8, n)] + 0.5 * rng.standard_normal((n, dim))).astype(np.float32)
    x[50] = x[60]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    bad = [(1000, None, 1), (1050, [0.0] * dim, 1), (1100, [float("nan")] + [1.0] * (dim - 1), 1), (1150, [None] + [1.0] * (dim - 1), 1), (1200, [float("inf")] + [1.0] * (dim - 1), 1), (None, [1.0] * dim, 1), (1250, [], 1)]
    return x.astype(float), spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")


def test_op10(spark):
    x, df = vectors(spark)
    whole = np.vstack([np.floor(1024 * x).astype(int), np.zeros((1, 16), int)])
    ids = np.r_[np.arange(400), 1050]  # a zero vector takes part
    got: dict = {}
    for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0, 10, block=8, segment=100).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {*range(0, 400, 50), 1050}
    for q in range(0, 400, 50):
        s = whole @ whole[q]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:10]
        assert [got[q][k + 1] for k in range(10)] == [(ids[i], s[i]) for i in best]
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk_search.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, 10).count() == 2


def clustered(n, dim=32, kinds=200, noise=0.05, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((kinds, dim))[rng.integers(0, kinds, n)] + noise * rng.standard_normal((n, dim))
    return rng.permutation(n).astype(np.int64), x


def test_pruned_search_skips_blocks():
    """On 20,000 rows of 200 kinds few blocks are scored, and the answers are those of all rows."""
    ids, x = clustered(20_000)
    rows = np.floor(1024 * x)
    blocks = topk_search.Blocks(ids, rows, 10)
    at = np.arange(0, 20_000, 400)
    q, found, score = blocks.search(ids[at], rows[at], np.full(len(at), -np.inf))
    for i in at:
        s = rows @ rows[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:10]
        assert found[q == ids[i]].tolist() == ids[best].tolist() and score[q == ids[i]].tolist() == s[best].tolist()
    assert blocks.scored < 0.1 * blocks.passed
    # A floor that the k-th score reaches changes nothing but the work.
    floors = np.array([score[q == ids[i]].min() for i in at], float)
    before, blocks.scored = blocks.scored, 0
    again = blocks.search(ids[at], rows[at], floors)
    assert all((a == b).all() for a, b in zip(again, (q, found, score))) and blocks.scored <= before


def test_top_k_sums_are_exact():
    big = np.array([[2.0**40, 1], [1, 2.0**20]])
    none = np.array([-np.inf])
    assert topk_search.Blocks(np.array([1, 2]), big, 1).search(np.array([9]), np.array([[2.0**20, 1]]), none)[2].tolist() == [2**60 + 1]
    with pytest.raises(OverflowError):
        topk_search.Blocks(np.array([1, 2]), big, 1).search(np.array([9]), np.array([[2.0**40, 1]]), none)


def test_searches_take_odd_tables(spark):
    """Ties, repeated rows and ids, vectors of unequal length, and columns with the names that the operators use."""
    rows = [(i, [1.0, float(i % 3)], 1, "a") for i in range(12)] + [(3, [1.0, 0.0], 2, "b"), (3, [0.5], 2, "b"), (20, [2.0], 3, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, segment string").withColumn("vector", F.lit(1)).withColumn("floor", F.lit(2)).withColumn("score", F.lit(3)).withColumn("rank", F.lit(9))
    full = [(i, np.r_[v, np.zeros(2 - len(v))]) for i, v, _, _ in rows]
    of = {0: np.array([1.0, 0.0]), 3: np.array([0.5, 0.0]), 6: np.array([1.0, 0.0]), 9: np.array([1.0, 0.0])}  # the least vector of an id asks
    for k, search, score in ((10, topk_search.top_k, lambda a, b: int(np.floor(1024 * a) @ np.floor(1024 * b))), (20, projection_search.nearest, lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))))):
        got = search(df, F.col("vec_id") % 3 == 0, k, segment=4).where("query_id < 12").collect()
        for q, v in of.items():
            want = sorted(((-score(x, v), i) for i, x in full if i != q))[:k]
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
            assert [(i, pytest.approx(s)) for _, i, s in mine] == [(i, -s) for s, i in want]


def test_op1(spark):
    x, df = vectors(spark)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = projection_search.nearest(df, F.col("vec_id") % 50 == 0, 5, segment=150).collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r["query_id"], {})[r["rank"]] = r
    assert set(got) == set(range(0, 400, 50))
    hits = 0
    for q, ranks in got.items():
        s = unit @ unit[q]
        s[q] = -2
        hits += len({r["vec_id"] for r in ranks.values()} & set(np.argsort(-s, kind="stable")[:5].tolist()))
        for r in ranks.values():
            assert r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-12)
        assert [ranks[k]["score"] for k in range(1, 6)] == sorted((r["score"] for r in ranks.values()), reverse=True)
    assert hits / (5 * len(got)) >= 0.9
    assert projection_search.nearest(df.limit(0), F.lit(True)).count() == 0
    assert projection_search.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0, 5).count() == 2


def test_op1_many_copies():
    """Groups of some hundred equal vectors: the copies of the smallest ids, from whatever leaf."""
    rng = np.random.default_rng(11)
    kinds = rng.standard_normal((4, 64)).astype(np.float32).astype(float)
    rows = np.concatenate([np.repeat(kinds, [300, 40, 500, 1], axis=0), rng.standard_normal((200, 64))])
    ids = rng.permutation(len(rows)).astype(np.int64)
    at = np.r_[0:300:30, 300:340:10, 340:840:50]
    q, found, score = projection_search.Index(ids, rows, 5).search(ids[at], rows[at], np.full(len(at), -np.inf))
    for i in at:
        same = ids[(rows == rows[i]).all(1)]
        assert found[q == ids[i]].tolist() == np.sort(same[same != ids[i]])[:5].tolist()
        assert np.ptp(score[q == ids[i]]) == 0


def test_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas()
    x = np.stack(pdf["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = projection_search.nearest(df, F.col("vec_id") % 50 == 0, 5).toPandas()
    hits = total = 0
    for i, q in enumerate(pdf["vec_id"]):
        if q % 50 == 0:
            s = x @ x[i]
            s[i] = -2
            hits += len(set(pdf["vec_id"].to_numpy()[np.argsort(-s)[:5]]) & set(found[found["query_id"] == q]["vec_id"]))
            total += 5
    assert hits / total >= 0.9


def test_chi_square_and_tree():
    assert projection_search.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    pts = np.random.default_rng(1).standard_normal((500, 4))
    tree = projection_search.KdTree(pts, 16)
    assert sorted(tree.rows.tolist()) == list(range(500))
    q = np.array([0.1, 0.2, -0.3, 2.0])
    walk, got, taken = tree.nearing(q, 8), [], 0
    batch = next(walk)
    while batch is not None:
        got += [(x, r) for x, r in zip(*batch) if x <= 2.0]
        taken += len(batch[0])
        try:
            batch = walk.send(2.0)
        except StopIteration:
            batch = None
    d = ((pts - q) ** 2).sum(1)
    want = np.sort(d[d <= 2.0])
    assert taken < len(pts) and np.allclose([x for x, _ in got], want) and np.allclose(d[tree.rows[[r for _, r in got]]], want)


def test_stopping_test_fires():
    """On 20,000 rows the test ends most searches early, with a recall of 0.9 or more."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((50, 64))[rng.integers(0, 50, 20_000)] + 1.5 * rng.standard_normal((20_000, 64))
    ids = rng.permutation(len(x)).astype(np.int64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = projection_search.Index(ids, x, 5)
    at = np.arange(0, len(x), 500)
    q, found, _ = index.search(ids[at], x[at], np.full(len(at), -np.inf))
    hits = 0
    for i in at:
        s = unit @ unit[i]
        s[i] = -2
        hits += len(set(ids[np.argsort(-s)[:5]].tolist()) & set(found[q == ids[i]].tolist()))
    assert hits >= 0.9 * 5 * len(at)
    assert index.verified < 0.5 * index.passed


def test_trees_of_equal_points():
    projection_search.KdTree(np.zeros((100, 2)), 8)
