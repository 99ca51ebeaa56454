"""Word shingles as 64-bit hashes, over whole texts, in numpy.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER[_SPACE] = 0
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _weights(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _M3) | np.uint64(1)


_FIRST = _weights(256)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text's UTF-8 bytes, in order."""
    filled = np.flatnonzero(~_SPACE[data])
    if not len(filled):
        return np.empty(0, np.uint64)
    starts = np.flatnonzero(np.diff(filled, prepend=-2) != 1)
    lengths = np.diff(starts, append=len(filled))
    place = np.arange(len(filled)) - np.repeat(starts, lengths)
    longest = int(lengths.max())
    weights = _FIRST if longest <= len(_FIRST) else _weights(longest)
    sums = np.add.reduceat(_LOWER[data[filled]] * weights[place], starts)
    return mix64(sums + lengths.astype(np.uint64) * _M3)


def shingle_set(text: str | bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; with fewer words, one of the whole
    sequence; without words, none."""
    if text is None:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass"), np.uint8)
    words = word_hashes(data)
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out += words[i : len(words) - width + 1 + i] * (_FIRST[100 + i])
    return np.unique(mix64(out + np.uint64(width)))


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit digests of a set, as signed integers."""
    a, b = mix64(hashes + _M3).sum(dtype=np.uint64), mix64(hashes ^ _M1).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def minima(hashes: np.ndarray, k: int) -> np.ndarray:
    """The least value of each of ``k`` hash functions over a set, as signed integers."""
    seeds = _weights(3 * k)
    xor, mul = seeds[k : 2 * k], seeds[2 * k :]
    least = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[i : i + 1024, None] ^ xor) * mul).min(axis=0), out=least)
    return least.astype(np.int64)


def minhash(hashes: np.ndarray, k: int) -> np.ndarray:
    """``k`` minimum hashes cut to 16 bits each (a b-bit signature with b = 16)."""
    return (mix64(minima(hashes, k).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
