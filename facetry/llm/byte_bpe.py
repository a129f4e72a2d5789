"""Ids of the public byte-level BPE vocabulary, the distinct stretches of a block of texts through a bounded memo."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import regex

from ._shared import Memo, kept, slices

#: Bytes of text that are split at a time, about.
BLOCK = 1 << 23
#: By byte: 1 white space, 2 the first byte of white space among other characters. And that white space, as numbers.
_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(128) if chr(b).isspace()]] = 1
_WIDE = [c.encode() for c in map(chr, range(0x80, 0x10000)) if c.isspace()]
_KIND[[c[0] for c in _WIDE]] = 2
_WIDE = np.array([int.from_bytes(c.ljust(3, b"\0"), "big") for c in _WIDE])
_LETTERS = regex.compile(r" ?\p{L}+")
#: ASCII characters that aren't letters, and the letters of two bytes by the eleven bits of their code points.
_OTHER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_LETTER = np.array([bool(_LETTERS.fullmatch(chr(c))) for c in range(1 << 11)])


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from
    U+0100 on, in the order of the bytes."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """The tokenizers library's ids, as little-endian unsigned 32-bit integers.

    The vocabulary's pattern ends a pretoken before every single space and around every single line feed, so the
    stretches between them are encoded independently. A run of white space stays within a stretch. A pretoken of letters
    ends with them, so a first word is a stretch without the marks behind it. A stretch of letters is a pretoken, which
    the library's model takes without a search for others.
    """

    def __init__(self, path: str, most: int = 96 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo = Memo(self._encode, most)
        if self.library.get_vocab_size() > 1 << 32:
            raise ValueError("ids don't fit 32 bits")
        if array("I", [1]).tobytes() != b"\1\0\0\0":
            raise ValueError("a little-endian machine is needed")
        form = json.loads(self.library.to_str())
        pre = form["pre_tokenizer"] or {}
        if form["normalizer"] or form["truncation"] or form["padding"] or (pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError("a byte-level vocabulary with its own pattern and without a normalizer is needed")
        if any(not t["content"][:1].isascii() or t["content"][:1].isalpha() or any(map(str.isspace, t["content"])) for t in form["added_tokens"]):
            raise ValueError("added tokens that start with a letter or beyond ASCII, or with white space, aren't supported")
        self.tokenize, self.letters = self.library.model.tokenize, _byte_letters()

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of stretches that the memo lacks."""
        out: list = [None] * len(parts)
        rest, space = [], self.letters[32]
        for i, p in enumerate(parts):
            if _LETTERS.fullmatch(p):
                letters = p.replace(" ", space) if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
                out[i] = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
            else:
                rest.append(i)
        for lo, hi in slices([len(parts[i]) for i in rest], 1 << 14):
            for i, e in zip(rest[lo:hi], self.library.encode_batch_fast([parts[i] for i in rest[lo:hi]], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out

    def ids(self, texts: pa.Array | list[str | None]):
        """The ids of each whole text, of an Arrow array or a list; a null text has none.

        Only the distinct stretches of a block become Python strings: they are found, and their ids put in the places of
        all stretches, on Arrow's buffers.
        """
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        if not n:
            return
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        for lo, hi in slices(np.diff(at).tolist(), BLOCK):
            places = at[lo : hi + 1] - at[lo]
            block = data[at[lo] : at[hi]]
            borders = _borders(block, places)
            parts = pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), pa.py_buffer(block)).dictionary_encode()
            distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
            found = pa.array(self.memo.values(distinct), pa.large_binary()).take(parts.indices)
            ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset + np.searchsorted(borders, places)].tolist()
            joined = memoryview(found.buffers()[2] or b"")
            for start, end in zip(ends, ends[1:]):
                yield bytes(joined[start:end])


def _borders(block: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where the stretches of a block of UTF-8 begin, and its end: at `places`, where texts begin and end, at single
    spaces and line feeds between characters other than white space, and behind a stretch's first word."""
    cut = np.zeros(len(block) + 1, bool)
    if len(block) > 2:
        kind = _KIND[block]
        white = kind == 1
        wide = np.flatnonzero(kind == 2)
        if len(wide):
            code = [block.take(wide + k, mode="clip").astype(np.int64) for k in range(3)]
            three = code[0] >= 0xE0
            wide, three = wide[hit := np.isin(code[0] << 16 | code[1] << 8 | np.where(three, code[2], 0), _WIDE)], three[hit]
            white[wide] = white[wide + 1] = True
            white[wide[three] + 2] = True
        line = block[1:-1] == 10
        single = ((block[1:-1] == 32) | line) & ~white[:-2] & ~white[2:]
        cut[1:-2] = single
        cut[2:-1] |= single & line
        other = np.flatnonzero(_OTHER[block])
        before, other = other[:-1], other[1:]
        # A first word: from a stretch's start, or its space, to the first other character of ASCII.
        first = ((cut[before] & (block[before] == 32)) | cut[before + 1]) & (other > before + 1)
        other = other[first]
        last, lead = block[other - 1], block[other - 2].astype(np.int64)
        two = (lead >= 0xC0) & (lead < 0xE0) & (last >= 0x80)
        cut[other[(last < 0x80) | (two & _LETTER[(lead & 31) << 6 | last & 63])]] = True
    cut[places] = True
    return np.flatnonzero(cut).astype(np.int32)


def load(path: str) -> ByteBPE:
    """The encoder of a vocabulary file, made once in each process."""
    return kept(("byte_bpe", path), lambda: ByteBPE(path))
