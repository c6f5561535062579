"""Words of a text as numbers, and the windows of words that occur more than once in it."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: longest runs of characters that are not ASCII white space."""
    return text.encode("utf-8", "replace").split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number, by first occurrence."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def may_repeat(words: list[bytes], size: int) -> bool:
    """False only if no window of ``size`` words occurs twice: equal windows have equal hashes."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + len(out)]) * ODD
        out ^= out >> np.uint64(29)
    out.sort()
    return bool((out[1:] == out[:-1]).any())


def repeated_cover(words: list[bytes], size: int) -> np.ndarray:
    """Which words lie in a window of ``size`` words that occurs at least twice, the first occurrence included.

    Windows are named by ranks of pairs of shorter ones, so equal names mean equal windows, not equal hashes. As soon as
    no shorter window repeats, none of that size can.
    """
    n = len(words)
    cover = np.zeros(n, bool)
    if n <= size or not may_repeat(words, size):
        return cover
    names, have = numbered(words), 1
    while have < size:
        step = min(have, size - have)
        pairs = names[: n - have - step + 1] * (int(names.max()) + 1) + names[step : n - have + 1]
        distinct, names = np.unique(pairs, return_inverse=True)
        have += step
        if len(distinct) == len(pairs):
            return cover
    at = np.flatnonzero(np.bincount(names)[names] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[at] += 1
    edges[at + size] -= 1
    return np.cumsum(edges[:-1]) > 0
