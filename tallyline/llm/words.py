"""Words of many texts at once, as positions and hashes in their UTF-8 bytes.

All word classes here are told apart by single bytes (bytes from 0x80 on belong to
words), so that a whole batch is cut with a few array operations. A word's hash is a
polynomial of its bytes modulo 2^64, taken from prefix sums, and then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_STEP = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32

#: Letters and digits: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case.
ALPHANUMERIC = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: All but white space: [^\x20\x09-\x0D].
UNSPACED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of each 64-bit number (the finaliser of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mixed(np.arange(256, dtype=np.uint64))[LOWERED]


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[0] = 1
    return np.cumprod(found, dtype=np.uint64)


@dataclass
class Words:
    """Words of a batch: byte ranges, hashes, and the number of the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, begin: int, end: int) -> list[str]:
        """Words begin to end (not included), in lower case."""
        return [
            LOWERED[self.data[s:e]].tobytes().decode("utf-8", "replace")
            for s, e in zip(self.starts[begin:end], self.ends[begin:end], strict=True)
        ]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _STEP, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        size = 1 << max(18, (high - low).bit_length())
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_OF_BYTE[data[low:high]] * _powers(size, _BASE)[: high - low], out=sums[1:])
        begin = starts[at:to] - low
        out[at:to] = (sums[ends[at:to] - low] - sums[begin]) * _powers(size, _INVERSE)[begin]
        at = to
    return mixed(out)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; ``kind`` says which bytes are of words."""
    low, high = int(offsets[0]), int(offsets[-1])
    data = data[low:high]
    bounds = offsets - low
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    start, end = inside & ~before, before & ~inside
    start[cut] |= inside[cut]
    end[cut] |= before[cut]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return Words(data, starts, ends, hashes(data, starts, ends), np.searchsorted(starts, bounds))


def shingles(found: Words, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the number of the first one of each text.

    With ``short``, a text of fewer words, but not none, has one shingle of all its words.
    """
    counts = found.counts()
    many = np.maximum(counts - size + 1, np.where((counts > 0) & short, 1, 0))
    first = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(found.first[:-1] - first[:-1], many) + np.arange(first[-1])
    ends = np.repeat(found.first[1:], many)
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([found.hashes, np.zeros(size, np.uint64)])
    factor = 1
    for j in range(size):
        part = padded[at + j] * np.uint64(factor)
        total += part if not short else np.where(at + j < ends, part, np.uint64(0))
        factor = factor * _BASE % (1 << 64)
    return mixed(total), first
