"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from quirework.llm.common import only_cache

WORDS_KEPT = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word in order. Words are runs of anything but ASCII white space, A-Z in lower case."""
    only_cache("shingles", _HASHES.clear)
    words = text.encode("utf-8").lower().split()
    if len(_HASHES) > WORDS_KEPT:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingles(text: str, width: int) -> np.ndarray:
    """The distinct shingles of so many words; a text with fewer words has its whole sequence as the only one."""
    h = word_hashes(text)
    if not len(h):
        return h
    span = min(width, len(h))
    n = len(h) - span + 1
    out = np.full(n, span, np.uint64)
    for k in range(span):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)
