"""Word shingles of whole texts as 64-bit numbers, a batch of texts at a time in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEED = np.random.default_rng(20240501)
_TABLE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE_BYTES = _TABLE.copy()  # tells capitals apart
for _upper in range(65, 91):  # A-Z count as a-z
    _TABLE[_upper] = _TABLE[_upper + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FACTORS = _SEED.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: int, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2^64."""
    if len(_powers[which]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.full(size, _BASE if which == 0 else _INVERSE, np.uint64)
        out[0] = 1
        _powers[which] = np.multiply.accumulate(out)
    return _powers[which][:n]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = texts.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word of one text, A-Z in lower case."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64)
    solid = ~_SPACE[data]
    edge = np.diff(solid.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power(0, n), out=total[1:])
    return mixed((total[ends] - total[starts]) * _power(1, n)[starts] + (ends - starts).astype(np.uint64))


def shingle_set(data: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingles of one text: `size` words each; the whole text as one if it has fewer words; none without words."""
    words = word_hashes(data)
    if not len(words):
        return words
    k = min(size, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out += mixed(words[i : i + len(out)] + np.uint64(i)) * _FACTORS[i % 16]
    return np.unique(mixed(out + np.uint64(k)))
