"""Hashes of all words and word windows of many texts at once, with numpy over their bytes.

A hash is only a way to find places; what is found is compared with the words themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_QI = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
#: Bytes hashed at once.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_CACHE: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    size = max(1 << 16, 1 << int(n).bit_length())
    key = int(base), size
    if key not in _CACHE:
        for old in [k for k in _CACHE if k[0] == int(base)]:
            del _CACHE[old]
        _CACHE[key] = _powers(base, size)
    return _CACHE[key][:n]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, one separator behind each
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # first word of each text, and one more at the end

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def window(self, i: int, size: int) -> bytes:
        return b" ".join(self.word(k) for k in range(i, i + size))

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def words_of(texts: list[bytes], separator: np.ndarray) -> Words:
    """separator: for each byte value, whether it separates words."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    first = np.searchsorted(starts, bounds)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers(_P, high - low), out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        hashes[at:to] = (sums[e] - sums[s]) * powers(_PI, high - low)[s]
        at = to
    return Words(data, starts, ends, mix(hashes), first)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Of each window of `size` words; windows may run from one text into the next."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_Q, n), out=sums[1:])
    return mix((sums[size:] - sums[: n - size + 1]) * powers(_QI, n)[: n - size + 1] + np.uint64(size))


def covered(n: int, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    """Which of n words lie in one of the windows."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.subtract.at(change, starts + sizes, 1)
    return np.cumsum(change[:-1]) > 0
