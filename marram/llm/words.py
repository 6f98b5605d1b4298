"""Words of a text and their hashes."""

from __future__ import annotations

import re

import numpy as np

#: Maximal runs of Unicode letters, digits and underscores.
WORD = re.compile(r"\w+")

_MASK = (1 << 64) - 1
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values (finaliser of a splitting generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_text(s: str) -> int:
    """A 64-bit hash of a string that is the same in every process."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s)


class Hasher:
    """Word hashes with a memory that is emptied when it grows beyond ``limit`` words."""

    def __init__(self, limit: int = 500_000) -> None:
        self._known: dict[str, int] = {}
        self._limit = limit

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self._known
        try:
            return np.fromiter([known[w] for w in words], np.uint64, len(words))
        except KeyError:
            if len(known) > self._limit:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = hash_text(w)
            return np.fromiter([known[w] for w in words], np.uint64, len(words))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes, in order."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = out * _P1 + (h[k : len(h) - n + 1 + k] ^ (_P2 * np.uint64(k + 1)))
        return mix(out)
