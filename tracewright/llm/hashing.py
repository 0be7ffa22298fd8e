"""Vectorised word hashes: numpy passes over whole texts, no loop per word."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers (fixed values of this module; any odd 64-bit numbers do).
P_BYTE, P_WORD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64 - 1, 256, dtype=U) | U(1)


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(p: int) -> int:
    return pow(int(p), -1, 1 << 64)


class _Powers:
    """Powers of a number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, p) -> None:
        self.p, self.q = int(p), _inverse(int(p))
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            m = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.p, m), _powers(self.q, m)
        return self.up, self.down


_BYTES, _WORDS = _Powers(P_BYTE), _Powers(P_WORD)
_EXACT = _table(11)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]  # A-Z hash as a-z
#: White space of the contract: \x20 and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offset of each white-space separated word."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.ones(len(b) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(_SPACE[b], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def hashed(b: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """One 64-bit hash for each span of bytes."""
    up, down = _BYTES.get(len(b) + 1)
    total = np.zeros(len(b) + 1, U)
    np.cumsum((_FOLDED if lower else _EXACT)[b] * up[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def words(data: bytes, lower: bool) -> np.ndarray:
    """One 64-bit hash for each word of a UTF-8 text."""
    start, end = spans(data)
    if not len(start):
        return np.zeros(0, U)
    return hashed(np.frombuffer(data, np.uint8), start, end, lower)


def windows(word: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words (none if there are fewer)."""
    n = len(word)
    if n < k:
        return np.zeros(0, U)
    up, down = _WORDS.get(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(word * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def shingles(data: bytes, k: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct k-word shingle hashes; a shorter text is one shingle."""
    w = words(data, lower)
    return np.unique(windows(w, min(k, len(w)))) if len(w) else np.zeros(0, U)
