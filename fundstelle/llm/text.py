"""Words, letters and 64-bit hashes in numpy, shared by the operators of this package."""

from __future__ import annotations

import functools
import re

import numpy as np
import xxhash

#: Longest runs of letters and digits.
WORD = re.compile(r"[^\W_]+")

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class WordHashes(dict):
    """word -> 64-bit hash, kept between batches and emptied when it grows past a bound."""

    BOUND = 2_000_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.BOUND:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix64(out ^ h[k : len(h) - n + 1 + k])
    return out
