"""Vectorised 64-bit hashes of words, lines and windows over batches of UTF-8 texts.

All sums are modulo 2**64. A run of symbols has the hash sum(symbol_hash[j] * base**j), taken from prefix sums and
multiplied by the inverse of base**start, so every run of a batch is hashed without a loop; a finaliser mixes the bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of two multiply-xorshift steps."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0.. and the inverses, n of each at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16) if have is None else max(n, 2 * len(have[0]))
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = _powers[base] = (out[0], out[1])
    return have


def runs(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of symbols[start:end]."""
    up, down = powers(base, len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * U(0x9E3779B97F4A7C15))


BASES = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F)

_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a list of UTF-8 texts: hash and text number of each, in order.

    ``first[d]`` is the number of the first word of text d; ``first[-1]`` is the number of words."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            raw = _lower[raw]
        gap = _space[raw]
        before = np.empty_like(gap)
        before[0], before[1:] = True, gap[:-1]
        start = np.flatnonzero(~gap & before)
        end = np.flatnonzero(gap & ~before)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(start, begin)
        self.counts = np.diff(self.first)
        self.hash = runs(_byte_values()[raw], start, end, BASES[0])
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def windows(self, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of the first word) of all windows of ``size`` words inside one text."""
        n = len(self.hash)
        at = np.arange(max(0, n - size + 1))
        at = at[self.first[self.text[at] + 1] - at >= size] if len(at) else at
        return runs(self.hash, at, at + size, base), at

    def whole(self, base: int) -> np.ndarray:
        """A hash of each text's word sequence."""
        return runs(self.hash, self.first[:-1], self.first[1:], base)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every i that has so many."""
    m, have = x, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return m if have == width else np.minimum(m[: len(x) - width + 1], m[width - have :])


def distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each owner 0..n-1, sorted, and how many each has."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return v[keep], np.bincount(o[keep], minlength=n)
