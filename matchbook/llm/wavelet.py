"""A wavelet matrix over token ids: bit planes with rank and select.

Works on NumPy arrays inside a task. The ids of a sequence are first replaced
by their rank among the distinct ids (the alphabet, kept in the file), so a
shard has only as many planes as its own alphabet needs. Plane by plane, from
the highest bit down, the sequence is split into the elements whose bit is 0,
followed by those whose bit is 1; a plane keeps the bits before the split.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512  # bits between two entries of a plane's rank directory


def _counts(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of a packed plane."""
    padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
    padded[:len(plane)] = plane
    ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])


class WaveletMatrix:
    """``WaveletMatrix.build(ids)``, or the constructor over stored parts."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[np.ndarray],
                 directory: list[np.ndarray]):
        self.n, self.alphabet, self.zeros, self.planes, self.directory = n, alphabet, zeros, planes, directory

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        seen[ids] = True
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        code = np.cumsum(seen).astype(np.uint32) - 1
        bits = max(1, int(len(alphabet) - 1).bit_length())
        seq = code[ids].astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, directory = [], [], []
        for b in range(bits - 1, -1, -1):
            ones = (seq & (1 << b)) != 0
            plane = np.packbits(ones)
            low = np.flatnonzero(~ones)  # places are read several times faster than by a mask of random bits
            seq = np.concatenate([seq[low], seq[np.flatnonzero(ones)]])
            zeros.append(len(low))
            planes.append(plane)
            directory.append(_counts(plane))
        return cls(len(ids), alphabet, zeros, planes, directory)

    # -- stored form -------------------------------------------------------

    def parts(self) -> dict:
        return {"n_ids": self.n, "alphabet": self.alphabet.astype("<u4").tobytes(), "zeros": self.zeros,
                "planes": [p.tobytes() for p in self.planes],
                "directory": [d.astype("<u4").tobytes() for d in self.directory]}

    @classmethod
    def from_parts(cls, row: dict) -> WaveletMatrix:
        return cls(row["n_ids"], np.frombuffer(row["alphabet"], "<u4"), list(row["zeros"]),
                   [np.frombuffer(p, np.uint8) for p in row["planes"]],
                   [np.frombuffer(d, "<u4") for d in row["directory"]])

    # -- queries -----------------------------------------------------------

    def ids(self) -> np.ndarray:
        """The whole sequence: undo the splits from the last plane up."""
        seq = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for b, (zeros, plane) in enumerate(zip(reversed(self.zeros), reversed(self.planes))):
            ones = np.unpackbits(plane, count=self.n).view(bool)
            out = np.empty_like(seq)
            out[np.flatnonzero(~ones)] = seq[:zeros]
            out[np.flatnonzero(ones)] = seq[zeros:] | seq.dtype.type(1 << b)
            seq = out
        return self.alphabet[seq] if self.n else np.zeros(0, np.uint32)

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position of ``at``."""
        at = np.asarray(at, np.int64)
        block = at // BLOCK
        out = self.directory[level][block].astype(np.int64)
        plane = np.append(self.planes[level], np.uint8(0))
        first = block * (BLOCK // 8)
        for k in range(BLOCK // 8):  # whole bytes within the block
            whole = first + k < at // 8
            if not whole.any():
                break
            out += np.where(whole, np.bitwise_count(plane[np.minimum(first + k, len(plane) - 1)]), 0)
        rest = at % 8
        return out + np.bitwise_count(plane[at // 8] & ~(0xFF >> rest)).astype(np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at positions."""
        at = np.asarray(at, np.int64)
        code = np.zeros(len(at), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (self.planes[level][at // 8] >> (7 - at % 8)) & 1
            ranks = self._rank1(level, at)
            at = np.where(one == 1, zeros + ranks, at - ranks)
            code = code * 2 + one
        return self.alphabet[code]

    def _range(self, token: int, start: int, end: int) -> tuple[int, int, int] | None:
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return None
        for level, zeros in enumerate(self.zeros):
            s, e = (int(x) for x in self._rank1(level, np.array([start, end])))
            one = code >> (len(self.zeros) - 1 - level) & 1
            start, end = (zeros + s, zeros + e) if one else (start - s, end - e)
        return code, start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in [start, end)."""
        found = self._range(token, start, self.n if end is None else end) if self.n else None
        return found[2] - found[1] if found else 0

    def occurrences(self, token: int) -> np.ndarray:
        """Positions of an id, ascending: select back up through the planes."""
        found = self._range(token, 0, self.n) if self.n else None
        if not found:
            return np.zeros(0, np.int64)
        code, start, end = found
        at = np.arange(start, end, dtype=np.int64)
        for level in range(len(self.zeros) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            one = code >> (len(self.zeros) - 1 - level) & 1
            at = np.flatnonzero(ones)[at - self.zeros[level]] if one else np.flatnonzero(~ones)[at]
        return at
