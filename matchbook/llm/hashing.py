"""Vectorised hashes of words and word shingles, the same in every process."""

from __future__ import annotations

import numpy as np

from matchbook.llm.decontaminate import _FOLD

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _BASE)]), dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered) of UTF-8 texts, and the number of words of each text."""
    folded = [t.translate(_FOLD) for t in texts]
    raw = np.frombuffer(b" " + b" ".join(folded) + b" ", np.uint8)
    inside = raw != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    border = np.cumsum([1, *(len(t) + 1 for t in folded)])
    counts = np.diff(np.searchsorted(starts, border))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    letters = raw[inside].astype(np.uint64) + np.uint64(1)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(begin, sizes)
    return mix(np.add.reduceat(letters * _powers(int(sizes.max()))[place], begin)), counts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``size`` words; a shorter text is one run, one without words has none."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * _BASE + words[k:len(words) - size + 1 + k]
    return mix(out + np.uint64(size))
