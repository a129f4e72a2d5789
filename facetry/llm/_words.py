"""Word and window hashes of many texts at once, with NumPy.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 text. A word's hash is a polynomial of random values of its bytes, modulo
2^64, taken as a difference of running sums; windows of words are hashed likewise from the mixed hashes of the words.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(0x5EED)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are hashed at a time, about; and how many powers of a base stay between calls.
BLOCK, HELD = 1 << 20, 1 << 21
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64; up to HELD of them are kept between calls."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(12, (n - 1).bit_length())
        known = np.empty(size, np.uint64)
        known[0] = 1
        done = 1
        while done < size:
            known[done : 2 * done] = known[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        if size <= HELD:
            _powers[base] = known
    return known[:n]


def mix(z: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads all bits."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    inverse = pow(base, -1, 1 << 64)
    return (sums[ends] - sums[starts]) * powers(inverse, int(starts.max(initial=0)) + 1)[starts]


class Words:
    """The words of a list of texts (or their UTF-8): hash, first and last byte in `data`, and firsts[i]..firsts[i + 1] of text i."""

    def __init__(self, texts: list[str | bytes | None], lower: bool):
        encoded = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
        self.data = b"\n".join(encoded) + b"\n"
        self.raw = np.frombuffer(self.data, np.uint8)
        self.values = _VALUES[_LOWER] if lower else _VALUES
        space = _SPACE[self.raw]
        before = np.r_[True, space[:-1]]
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(space & ~before)
        del space, before
        offsets = np.r_[0, np.cumsum([len(e) + 1 for e in encoded])]
        self.firsts = np.searchsorted(self.starts, offsets)
        self.hashes = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            # Words of a block of bytes at a time; a word beyond the size of a block is one by itself.
            stop = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + BLOCK, "right")))
            self.hashes[at:stop] = self._block(at, stop)
            at = stop
        self.hashes = mix(self.hashes)

    def _block(self, at: int, stop: int) -> np.ndarray:
        """Sums of value * base^place over the bytes of each word, before they are mixed."""
        lo, hi = int(self.starts[at]), int(self.ends[stop - 1])
        if stop - at == 1:
            total = 0
            for s in range(lo, hi, BLOCK):
                part = self.values[self.raw[s : min(hi, s + BLOCK)]]
                total += int(np.sum(part * powers(_BYTE, len(part)))) * pow(_BYTE, s - lo, 1 << 64)
            return np.array([total & 0xFFFFFFFFFFFFFFFF], np.uint64)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(self.values[self.raw[lo:hi]] * powers(_BYTE, hi - lo), out=sums[1:])
        return _spans(sums, self.starts[at:stop] - lo, self.ends[at:stop] - lo, _BYTE)

    def windows(self, size: int) -> np.ndarray:
        """Hash of the `size` words from each word on, over borders of texts too; fewer at the end."""
        n = len(self.hashes)
        if n < size:
            return np.empty(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * powers(_WORD, n), out=sums[1:])
        starts = np.arange(n - size + 1)
        return mix(_spans(sums, starts, starts + size, _WORD) + np.uint64(size))

    def short(self, i: int) -> np.uint64:
        """Hash of all words of text i in one."""
        h = self.hashes[self.firsts[i] : self.firsts[i + 1]]
        return mix(np.array([np.sum(h * powers(_WORD, len(h))) + np.uint64(len(h))], np.uint64))[0]
