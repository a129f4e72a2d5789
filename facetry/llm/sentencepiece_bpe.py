"""SentencePiece encoding and decoding (operator 5) by a table of the last token of every prefix.

In byte-pair encoding each prefix of a text has exactly one possible last token: among the pieces that an Aho-Corasick
automaton finds ending there, the one that is compatible with the last token of what lies before it. Two tokens are
compatible when no merge across their border would have come before the merges that formed them. The table is filled
from left to right and the ids are read from it backwards.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from ._shared import Memo, kept, slices, small, tokenizer_path

SPACE = "▁"
UNKNOWN = -1


class PrefixTable:
    """Encoder and decoder for a SentencePiece BPE model with byte fallback and an identity normalizer."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i).replace(SPACE, " ") for i in plain}
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no full set of byte pieces")
        ids = {t: i for i, t in self.text.items()}
        # Characters that only occur inside longer pieces can merge too; alone they are written as bytes.
        for c in sorted({c for t in ids for c in t} - ids.keys()):
            ids[c] = n + len(ids)
        self.ids = ids
        # Runs of spaces may share one score, below all others: their merges come last, from left to right.
        runs = {len(t): i for t, i in ids.items() if len(t) > 1 and not t.strip(" ")}
        order = sorted((i for i in plain if len(self.text[i]) > 1 and i not in runs.values()), key=lambda i: -sp.get_score(i))
        scores = [sp.get_score(i) for i in order]
        if len(set(scores)) != len(scores) or any(sp.get_score(i) >= scores[-1] for i in runs.values()):
            raise ValueError("merges of equal score are only supported for runs of spaces, after all others")
        if any(" " in t[1:] and t.strip(" ") for t in ids):
            raise ValueError("pieces with a space inside aren't supported")
        self.runs = runs | {1: ids[" "]}
        self.rank = dict.fromkeys(ids.values(), -1)
        self.rank |= {i: r for r, i in enumerate(order)}
        self.rank |= dict.fromkeys(runs.values(), len(order))
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for t, i in ids.items():
            if i in runs.values():
                continue
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    self.merged[a, b] = self.rank[i]
        reachable = [i for i in ids.values() if self.rank[i] < 0]
        for i in order:
            t, r = self.text[i], self.rank[i]
            for k in range(1, len(t)):
                a, b = ids.get(t[:k], UNKNOWN), ids.get(t[k:], UNKNOWN)
                if min(a, b) != UNKNOWN and max(self.rank[a], self.rank[b]) < r and self._formed(a) and self._formed(b) and self._holds(a, b, r):
                    self.left[i], self.right[i] = a, b
                    reachable.append(i)
                    break
        names = {i: t for t, i in ids.items()}
        self.automaton = ahocorasick.Automaton()
        for i in reachable:
            self.automaton.add_word(names[i], (i, len(names[i])))
        self.automaton.make_automaton()
        self.size, self.names = n, names
        self.lines = not any("\n" in t and len(t) > 1 for t in ids)
        self.pairs: dict[int, bool] = {}
        self.memo: Memo | None = None
        self.piece_bytes = {i: t.encode() for i, t in self.text.items()} | {i: bytes([b]) for b, i in self.byte.items()}

    def _formed(self, i: int) -> bool:
        return self.rank[i] < 0 or i in self.left

    def _holds(self, a: int, b: int, limit: float) -> bool:
        """Whether the border between two formed tokens outlives all merges of a rank below `limit`.

        Walks the merges that formed them backwards. The pair at the border at each time must not merge before the
        earlier of the two merges that end it; of equal merges the left one comes first.
        """
        over_a = over_b = limit
        while True:
            r = self.merged.get((a, b))
            if r is not None and r < over_a and (r <= over_b if over_b != limit else r < limit):
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                over_a, a = ra, self.right[a]
            else:
                over_b, b = rb, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[key] = self._holds(a, b, float("inf"))
        return known

    def run_ids(self, k: int) -> list[int]:
        """Ids of a run of k spaces that no other piece takes: the leftmost possible merge is always made first."""
        stack: list[int] = []
        for _ in range(k):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [self.runs[x] for x in stack]

    def piece_ids(self, s: str) -> list[int]:
        """Ids of one pretoken, in which spaces stand for the space mark; no prefix is added."""
        if s[:2] == "  ":
            k = len(s) - len(s.lstrip(" "))
            rest = self.piece_ids(s[k - 1 :])
            alone = rest[0] == self.runs[1]
            return self.run_ids(k - (not alone)) + rest[alone:]
        n = len(s)
        last = [UNKNOWN] * (n + 1)
        pairs = self.pairs
        for end, (i, length) in self.automaton.iter(s):
            end += 1
            if last[end] == UNKNOWN:
                before = last[end - length]
                if end == length or before == UNKNOWN:
                    # At the start, or after a character that no piece holds.
                    last[end] = i
                else:
                    ok = pairs.get(before << 20 | i)
                    if ok or ok is None and self.compatible(before, i):
                        last[end] = i
        out: list[int] = []
        while n:
            i = last[n]
            if i == UNKNOWN or i >= self.size:
                out += [self.byte[b] for b in reversed(s[n - 1].encode())]
                n -= 1
            else:
                out.append(i)
                n -= len(self.names[i])
        out.reverse()
        return out

    def pretokens(self, text: str) -> list[str]:
        """Parts of a text that are encoded independently, since no piece reaches over their borders."""
        if not text:
            return []
        s = " " + text.replace(SPACE, " ")
        if not self.lines:
            return re.findall(r" +[^ ]*|[^ ]+", s)
        if "  " in s or "\x01" in s:
            return re.findall(r" +[^ \n]*|[^ \n]+|\n", s)
        return s.replace("\n", "\x01\n\x01").replace(" ", "\x01 ").split("\x01")

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pretokens(text) for i in self.piece_ids(p)]

    def decode_bytes(self, ids) -> bytes:
        """Text of ids without its first-space rule; ids of control and unknown pieces give nothing here."""
        return b"".join(map(self.piece_bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        raw = self.decode_bytes(ids)
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


def load(model_file: str) -> PrefixTable:
    """The table of a model, built once in each process."""
    return kept(("sentencepiece", model_file), lambda: PrefixTable(model_file))


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """(id, ids array<int>, decoded string) of every text; a null text counts as empty.

    Rows are independent: repeated ids and null ids stay as they are, other columns are not read. An empty text has no
    ids. Pieces that the driver's model lacks become bytes, as in the library.
    """
    model_file = model_file or tokenizer_path("piece_bpe_32k.model")
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        table = load(model_file)
        for b in small(batches):
            ids = [table.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, schema.field(1).type), pa.array([table.decode(x) for x in ids], pa.string())], schema=schema)

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id long, ids array<int>, decoded string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, memo: int = 64 << 20) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids as text and of the decoded text; null text: empty.

    The same encoder as encoded(), a pretoken's ids and decoded bytes kept in a bounded memo of each process, so that
    the ids of a whole document are never held as integers.
    """
    model_file = model_file or tokenizer_path("piece_bpe_32k.model")

    def run(batches):
        table = load(model_file)

        def parts_of(fresh):
            for p in fresh:
                ids = table.piece_ids(p)
                yield "".join([f"{i}," for i in ids]), len(ids), table.decode_bytes(ids)

        if table.memo is None:
            table.memo = Memo(parts_of, memo, 330)
        for b in small(batches):
            texts = b.column(1).to_pylist()
            count, sha, back = [], [], []
            for lo, hi in slices([len(t or "") for t in texts], 1 << 20):
                split = [table.pretokens(t or "") for t in texts[lo:hi]]
                store = table.memo.lookup(split)
                for parts in split:
                    h, g, n, rest, skip = hashlib.sha256(), hashlib.sha256(), 0, "", True
                    for at in range(0, len(parts), 1 << 16):
                        text, lens, raw = zip(*map(store.__getitem__, parts[at : at + (1 << 16)]))
                        joined = rest + "".join(text)
                        if joined:
                            h.update(joined[:-1].encode())
                            rest = ","
                        n += sum(lens)
                        raw = b"".join(raw)
                        g.update(raw[1:] if skip and raw[:1] == b" " else raw)
                        skip = skip and not raw
                    count.append(n)
                    sha.append(h.hexdigest())
                    back.append(g.hexdigest())
            yield pa.record_batch([b.column(0), pa.array(count, pa.int64()), pa.array(sha), pa.array(back)], schema=OUT)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
