"""Similarities of many pairs of rows at once, in NumPy.

A column of a batch is coded once a row (``Texts``, ``Tokens``, ``codes``); a pair is two row numbers. Every
function takes the numbers ``a`` and ``b`` of the two sides, equal ones of ``a`` one after another, and works bit-parallel
or by table lookups over slices of pairs, so that a pair costs a fraction of a microsecond. The values are those of the
column expressions in ``similarity``.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 8192  # pairs at once: their arrays stay in the cache
TABLE = 1 << 22  # entries of a table of one slice

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
COMMAS = np.zeros(256, bool)
COMMAS[44] = True
_ONE = np.uint64(1)


def round6(x: np.ndarray) -> np.ndarray:
    """Six places, halves away from zero by the decimal digits of the number, as Spark rounds."""
    scaled = x * 1e6
    out = np.floor(scaled + 0.5) / 1e6
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)
    if len(near):
        values, at = np.unique(x[near], return_inverse=True)
        six = Decimal("0.000001")
        out[near] = np.array([float(Decimal(repr(v)).quantize(six, ROUND_HALF_UP)) for v in values.tolist()])[at]
    return out


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; null is empty."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8), ends - ends[0]


class Sets:
    """Distinct numbers of each row: ``sizes[i]`` of them from ``starts[i]`` on in ``codes``."""

    def __init__(self, rows: np.ndarray, codes: np.ndarray, n: int):
        width = int(codes.max(initial=0)) + 1
        keys = np.unique(rows.astype(np.int64) * width + codes)
        self.codes, self.width = keys % width, width
        self.sizes = np.bincount(keys // width, minlength=n)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of_lists(cls, lists: pa.Array) -> Sets:
        """Of lists of distinct numbers, in their order; a null list is empty."""
        sets = cls.__new__(cls)
        sets.codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1].astype(np.int64)
        sets.width = int(sets.codes.max(initial=0)) + 1
        sets.sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        sets.starts = np.cumsum(sets.sizes) - sets.sizes
        return sets


class Tokens:
    """Words of each row in order, as numbers: ``sizes[i]`` of them from ``starts[i]`` on in ``codes``."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = _SPACES):
        data, ends = _bytes(texts)
        kept = ~separators[data]
        first = kept.copy()
        first[1:] &= ~kept[:-1]
        begins = ends[:-1][np.diff(ends) > 0]
        first[begins] = kept[begins]
        at = np.flatnonzero(first)
        self.rows = np.searchsorted(ends, at, "right") - 1
        offsets = np.append(np.cumsum(kept)[at] - 1, kept.sum()).astype(np.int64) if len(at) else np.zeros(1, np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])
        self.codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        self.n = len(texts)
        self.sizes = np.bincount(self.rows, minlength=self.n)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @cached_property
    def sets(self) -> Sets:
        return Sets(self.rows, self.codes, self.n)


class Texts:
    """Characters of each row as small numbers: ``sizes[i]`` of them from ``starts[i]`` on in ``chars``, ``alphabet`` in all."""

    def __init__(self, texts: pa.Array):
        data, ends = _bytes(texts)
        points = data
        if len(data) and data.max() > 127:
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            ends = np.append(0, np.cumsum((data & 0xC0) != 0x80))[ends]  # the first byte of a character
        present = np.zeros(int(points.max(initial=0)) + 1, bool)
        present[points] = True
        self.alphabet = int(present.sum())
        self.chars = (np.cumsum(present) - 1)[points]
        self.sizes, self.starts = np.diff(ends), ends[:-1]

    @cached_property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @cached_property
    def grams(self) -> Sets:
        """Distinct 3-grams; a shorter text is one gram."""
        of = self.alphabet + 1
        padded = np.append(self.chars + 1, [0, 0])
        last = np.repeat(self.starts + self.sizes, self.sizes)
        at = np.arange(len(self.chars))
        second, third = (np.where(at + k < last, padded[k:len(at) + k], 0) for k in (1, 2))
        whole = (third > 0) | (at == np.repeat(self.starts, self.sizes))
        code = (padded[:len(at)] * of + second) * of + third
        code, rows = code[whole], self.rows[whole]
        if of ** 3 <= 1 << 22:
            present = np.zeros(of ** 3, bool)
            present[code] = True
            code = (np.cumsum(present) - 1)[code]
        else:
            code = np.unique(code, return_inverse=True)[1]
        return Sets(rows, code, len(self.sizes))


def codes(values: pa.Array) -> np.ndarray:
    """Equal values have equal numbers, null has -1."""
    return pc.fill_null(values.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(a: np.ndarray) -> list[slice]:
    return [slice(i, i + SLICE) for i in range(0, len(a), SLICE)]


def _local(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a slice of ``a`` and, for each pair, the place of its row among them."""
    new = np.append(True, a[1:] != a[:-1])
    return a[new], np.cumsum(new) - 1


def _within(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All elements of ``rows``: the place of their row in ``rows``, their place in it, their place in the column."""
    n = sizes[rows]
    of = np.repeat(np.arange(len(rows)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, place, starts[rows][of] + place


def _longest_first(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs by falling size, and how many are larger than 0, 1, 2, ..."""
    order = np.argsort(-sizes, kind="stable")
    return order, len(sizes) - np.cumsum(np.bincount(sizes, minlength=1))[:-1]


def dot(sets: Sets, a: np.ndarray, b: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """How many codes two rows share, or the sum of the products of their weights, which stand as the codes do."""
    out = np.zeros(len(a), np.int64 if weights is None else np.float64)
    most = int(np.max(sets.sizes[a], initial=0)) + 1
    at_once = max(1, TABLE // sets.width, isqrt(TABLE // most))  # rows: either bound keeps their table small
    for all_of in _slices(a):
        _, local = _local(a[all_of])
        bounds = np.append(np.searchsorted(local, np.arange(0, local[-1] + 1, at_once)), len(local)) + all_of.start
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            _dot(sets, a[low:high], b[low:high], weights, out[low:high])
    return out


def _dot(sets: Sets, a: np.ndarray, b: np.ndarray, weights: np.ndarray | None, out: np.ndarray) -> None:
    rows, local = _local(a)
    of, _, at = _within(rows, sets.starts, sets.sizes)
    known = np.zeros(sets.width, np.int64)
    known[sets.codes[at]] = 1
    number = np.cumsum(known) * known  # 0: no row of this side has it
    width = int(number.max(initial=0)) + 1
    table = np.zeros(len(rows) * width, bool if weights is None else np.float64)
    table[of * width + number[sets.codes[at]]] = True if weights is None else weights[at]
    sizes = sets.sizes[b]
    order, counts = _longest_first(sizes)
    start, base = sets.starts[b][order], local[order] * width
    total = np.zeros(len(a), out.dtype)
    for j, n in enumerate(counts.tolist()):
        element = start[:n] + j
        hit = table[number[sets.codes[element]] + base[:n]]
        total[:n] += hit if weights is None else hit * weights[element]
    out[order] = total


def jaccard(sets: Sets, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = dot(sets, a, b)
    either = sets.sizes[a] + sets.sizes[b] - both
    return round6(np.divide(both, either, out=np.zeros(len(a)), where=either > 0))


def _bits(texts: Texts, rows: np.ndarray, words: int) -> np.ndarray:
    """For each row, character and word of 64 places: the places of the character."""
    of, place, at = _within(rows, texts.starts, texts.sizes)
    table = np.zeros(len(rows) * texts.alphabet * words, np.uint64)
    np.bitwise_or.at(table, (of * texts.alphabet + texts.chars[at]) * words + (place >> 6), _ONE << (place & 63).astype(np.uint64))
    return table


def _by_words(texts: Texts, patterns: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Places of the pairs by the number of words that their patterns take; several parts where tables would be too large."""
    words = (texts.sizes[patterns] + 63) >> 6
    out = []
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        step = max(1, min(SLICE, TABLE // max(1, texts.alphabet * w)))
        out += [(w, at[i:i + step]) for i in range(0, len(at), step)]
    return out


def levenshtein(texts: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances by Myers' bit vectors: 64 cells of a column of the matrix at once, for all pairs of a slice."""
    out = np.empty(len(a), np.int64)
    for words, at in _by_words(texts, a):
        out[at] = texts.sizes[b[at]] if words == 0 else _levenshtein(texts, a[at], b[at], words)
    return out


def _levenshtein(texts: Texts, a: np.ndarray, b: np.ndarray, words: int) -> np.ndarray:
    rows, local = _local(a)
    bits = _bits(texts, rows, words)
    order, counts = _longest_first(texts.sizes[b])
    start, base = texts.starts[b][order], local[order] * (texts.alphabet * words)
    up = np.full((words, len(a)), ~np.uint64(0))  # where the cell below is one more
    down = np.zeros((words, len(a)), np.uint64)   # where it is one less
    x, y, z = (np.empty(len(a), np.uint64) for _ in range(3))
    for j, n in enumerate(counts.tolist()):
        char = texts.chars[start[:n] + j]
        char *= words
        char += base[:n]
        more = less = None  # from the word before; the first row grows by one
        for w in range(words):
            pv, mv, xh, ph, mh = up[w, :n], down[w, :n], x[:n], y[:n], z[:n]
            eq = bits[char + w if w else char]
            xv = eq | mv
            if less is not None:
                eq |= less
            np.bitwise_and(eq, pv, out=xh)
            xh += pv
            xh ^= pv
            xh |= eq
            np.bitwise_or(xh, pv, out=ph)
            np.invert(ph, out=ph)
            ph |= mv
            np.bitwise_and(pv, xh, out=mh)
            carry = (ph >> np.uint64(63), mh >> np.uint64(63)) if w + 1 < words else None
            ph <<= _ONE
            mh <<= _ONE
            if more is None:
                ph |= _ONE
            else:
                ph |= more
                mh |= less
            np.bitwise_or(xv, ph, out=pv)
            np.invert(pv, out=pv)
            pv |= mh
            np.bitwise_and(ph, xv, out=mv)
            if carry:
                more, less = carry
    last = (texts.sizes[a][order] - 64 * (words - 1)).astype(np.uint64)
    mask = ~np.uint64(0) >> (np.uint64(64) - last)
    distance = texts.sizes[b][order].astype(np.int64)
    for w in range(words):
        within = mask if w + 1 == words else ~np.uint64(0)
        distance += np.bitwise_count(up[w] & within)
        distance -= np.bitwise_count(down[w] & within)
    out = np.empty(len(a), np.int64)
    out[order] = distance
    return out


def lev_ratio(texts: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    longer = np.maximum(texts.sizes[a], texts.sizes[b])
    return round6(np.where(longer > 0, 1 - levenshtein(texts, a, b) / np.maximum(longer, 1), 0.0))


def common_prefix(tokens: Tokens | Texts, a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Length of the common beginning, ``most`` at most."""
    elements = tokens.chars if isinstance(tokens, Texts) else tokens.codes
    out = np.zeros(len(a), np.int64)
    shorter = np.minimum(tokens.sizes[a], tokens.sizes[b])
    if most is not None:
        shorter = np.minimum(shorter, most)
    alike, j = np.flatnonzero(shorter > 0), 0
    while len(alike):
        alike = alike[elements[tokens.starts[a[alike]] + j] == elements[tokens.starts[b[alike]] + j]]
        j += 1
        out[alike] = j
        alike = alike[shorter[alike] > j]
    return out


def jaro_winkler(texts: Texts, a: np.ndarray, b: np.ndarray, weight: float = 0.1, boost_above: float = 0.7) -> np.ndarray:
    """As ``similarity.jaro_winkler``: each character of ``a`` takes the first equal one of ``b`` that is near and free, found in bit sets."""
    out = np.zeros(len(a))
    for words, at in _by_words(texts, b):
        if words:
            out[at] = _jaro(texts, a[at], b[at], words)
    alike = common_prefix(texts, a, b, 4)
    return round6(np.where(out > boost_above, out + alike * weight * (1 - out), out))


def _low_bits(n: np.ndarray) -> np.ndarray:
    """The ``n`` lowest bits set, none below 0 and all from 64 on."""
    n = np.clip(n, 0, 64)
    return np.where(n > 0, ~np.uint64(0) >> (64 - np.maximum(n, 1)).astype(np.uint64), np.uint64(0))


def _jaro(texts: Texts, a: np.ndarray, b: np.ndarray, words: int) -> np.ndarray:
    rows, local = np.unique(b, return_inverse=True)
    bits = _bits(texts, rows, words)
    order, counts = _longest_first(texts.sizes[a])
    a, b, base = a[order], b[order], local[order] * (texts.alphabet * words)
    na, nb, sa, sb = texts.sizes[a], texts.sizes[b], texts.starts[a], texts.starts[b]
    near = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
    taken = np.zeros((words, len(a)), np.uint64)
    most = int(np.minimum(na, nb).max(initial=0))
    found, m = np.zeros((len(a), most + 1), texts.chars.dtype), np.zeros(len(a), np.int64)
    pairs = np.arange(len(a))
    for i, n in enumerate(counts.tolist()):
        char = texts.chars[sa[:n] + i]
        entry = char * words + base[:n]
        free = np.ones(n, bool)  # of those that have not found theirs
        for w in range(words):
            reach = _low_bits(i + near[:n] + 1 - 64 * w) & ~_low_bits(i - near[:n] - 64 * w)
            hit = bits[entry + w] & reach & ~taken[w, :n]
            if w:
                hit[~free] = 0
            hit &= ~hit + _ONE  # the first of them
            taken[w, :n] |= hit
            free &= hit == 0
        got = np.flatnonzero(~free)
        found[got, m[got]] = char[got]
        m[got] += 1
    swapped, k = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for j in range(int(nb.max(initial=0))):
        got = pairs[(taken[j >> 6] >> np.uint64(j & 63)) & _ONE > 0]
        swapped[got] += texts.chars[sb[got] + j] != found[got, k[got]]
        k[got] += 1
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(na, 1) + m / np.maximum(nb, 1) + (m - swapped // 2) / some) / 3, 0.0)
    out = np.empty(len(a))
    out[order] = jaro
    return out
