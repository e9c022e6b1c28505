"""Word boundaries and 64-bit hashes of words and word sequences, for whole Arrow batches at once.

Texts are looked at as UTF-8 bytes. A polynomial hash of a stretch is the difference of two prefix
sums times an inverse power, so that all words, and all n-grams, cost a few passes over an array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1
#: Lookup of the bytes that are white space: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept, and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(base, len(values)), out=sums[1:])
    inverse = pow(base, -1, 1 << 64)
    back = _power(inverse, len(values) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a batch: ``data`` are the joined bytes, ``first[i]:first[i + 1]`` the words of text i."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def of(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]]


def words(texts, lower: bool = False, gap: np.ndarray = SPACE, hashed: bool = True) -> Words:
    """All words of the texts (null counts as empty); ``lower`` changes A-Z only."""
    encoded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(encoded) + b" "
    if lower:
        data = data.lower()
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~gap[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.cumsum([0] + [len(e) + 1 for e in encoded])
    first = np.searchsorted(starts, offsets)
    hashes = _stretches(raw.astype(np.uint64) + np.uint64(1), starts, ends, _BASE) if hashed else None
    return Words(data, starts, ends, first, hashes)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words; empty when there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    starts = np.arange(count)
    return _stretches(hashes, starts, starts + n, _WORD_BASE)


def sequence(hashes: np.ndarray) -> np.uint64:
    """One hash of the whole sequence."""
    return _stretches(hashes, np.array([0]), np.array([len(hashes)]), _WORD_BASE)[0]


def pieces(texts, limit: int = 1 << 20):
    """Consecutive slices of a batch holding about ``limit`` characters, one text at least.

    The arrays of a slice take some 60 bytes a character, so a slice keeps a task small and in cache.
    """
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = 0 if t is None else len(t)
        if size and size + n > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def hash_stretches(w: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of any byte stretches of the joined texts, comparable with those of words."""
    raw = np.frombuffer(w.data, dtype=np.uint8)
    return _stretches(raw.astype(np.uint64) + np.uint64(1), starts, ends, _BASE)
