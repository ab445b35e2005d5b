"""64-bit hashes of many substrings at once, in numpy, by prefix sums of a polynomial over the bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Powers of the base and of its inverse, kept for the longest input so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.full(size, x, np.uint64) for x in (_BASE, _INVERSE))
            for x in (self.up, self.down):
                x[0] = 1
                np.cumprod(x, out=x)

    def of(self, data: np.ndarray) -> np.ndarray:
        """sums[i]: of the first i bytes; see between()."""
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return sums

    def between(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from begin to end; equal strings hash alike wherever they are."""
        return (sums[end] - sums[begin]) * self.down[begin]


class WordHasher:
    """The hash of each word, a run of bytes other than white space, of many texts at once."""

    def __init__(self) -> None:
        self.prefixes = Prefixes()
        self.space = np.zeros(256, bool)
        self.space[list(_SPACES)] = True

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each word begins, and its hash."""
        a = np.frombuffer(data, np.uint8)
        gap = np.ones(len(a) + 2, np.int8)
        gap[1:-1] = self.space[a]
        turns = np.flatnonzero(np.diff(gap))
        begin, end = turns[0::2], turns[1::2]
        h = self.prefixes.between(self.prefixes.of(a), begin, end)
        return begin, mix(h + (end - begin).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size words that begin at each word; a shorter sequence of words is one shingle, none is none."""
    if len(words) == 0:
        return words
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(_BASE) + words[j : len(words) - n + 1 + j])  # not linear: the order of words counts
    return out
