"""Vectorised tokenising and hashing of Arrow text columns with numpy.

Texts are handled as the UTF-8 bytes that Arrow already holds, in chunks of whole
documents, so a task's memory is bounded by the chunk size or by its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are tokenised at once (a longer text is a chunk of its own).
CHUNK_BYTES = 400_000

#: The hashes' modulus, a Mersenne prime: sums and products fold by shifts, and no text is a collision by its structure alone.
PRIME = (1 << 61) - 1
#: Two bases, each that of a hash of its own.
BASES = (0x0B7E151628AED2A6 % PRIME, 0x1F3A5C8842D79E61 % PRIME)
#: Bytes that sums of 40 bits can't overflow.
BLOCK = 1 << 23
_P61, _M31, _M30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
_powers: dict[int, tuple[np.ndarray, ...]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, below 2**61 + 8 (PRIME itself may stand for 0)."""
    return (x & _P61) + (x >> _61)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, below PRIME."""
    x = fold(fold(x))
    return np.where(x == _P61, np.uint64(0), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below 2**61."""
    a1, a0, b1, b0 = a >> _31, a & _M31, b >> _31, b & _M31
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    return reduced((a1 * b1 << np.uint64(1)) + (middle >> _30) + ((middle & _M30) << _31) + fold(low))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, ...]:
    """The first n powers of a hash's base and of its inverse, modulo PRIME, and the high and low halves of the base's."""
    if which not in _powers or len(_powers[which][0]) < n:
        m, out = max(n, CHUNK_BYTES + 1024), []
        for base in (BASES[which], pow(BASES[which], -1, PRIME)):
            x, k = np.ones(1, np.uint64), 1
            while k < m:
                x = np.concatenate((x, times(x, np.uint64(pow(base, k, PRIME)))))
                k *= 2
            out.append(x[:m])
        _powers[which] = (out[0], out[1], out[0] >> _31, out[0] & _M31)
    return tuple(x[:n] for x in _powers[which])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of the high and low halves of (byte + 1) * base**i, for span_hash; data may be bytes or small whole numbers."""
    n = len(data)
    _, _, *halves = powers(n + 1, which)
    value = data.astype(np.uint64) + np.uint64(1)
    sums = []
    for part in halves:
        c = np.zeros(n + 1, np.uint64)
        for k in range(0, n, BLOCK):
            np.cumsum(part[k : min(k + BLOCK, n)] * value[k : k + BLOCK], out=c[k + 1 : min(k + BLOCK, n) + 1])
            if k:
                c[k + 1 : k + BLOCK + 1] += reduced(c[k])
        sums.append(c)
    return sums[0], sums[1], which


def span_hash(c: tuple[np.ndarray, np.ndarray, int], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hashes of the spans [start, end): polynomials modulo PRIME, mixed."""
    high, low, which = c
    inv = powers(len(high), which)[1]
    if len(high) <= BLOCK:
        h, lo = high[end] - high[start], low[end] - low[start]
    else:  # sums begin anew, reduced, at each block
        h, lo = (fold(fold(x[end])) + _P61 - reduced(x[start]) for x in (high, low))
    h = fold(fold(h))
    total = reduced((h >> _30) + ((h & _M30) << _31) + fold(lo))
    return mix(times(total, inv[start]) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the number of words) of the maximal runs of non-separators."""
    w = np.zeros(len(data) + 2, bool)
    w[1:-1] = ~separators[data]
    before, after = w[:-2].copy(), w[2:].copy()
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    before[inner] = False
    after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(w[1:-1] & ~before)
    ends = np.flatnonzero(w[1:-1] & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ngram_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences of each text, and where each text's begin.

    A text with fewer words, but not none, has its whole sequence as one.
    """
    counts = np.diff(first)
    own = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    where = np.concatenate(([0], np.cumsum(own)))
    at = np.repeat(first[:-1] - where[:-1], own) + np.arange(where[-1])
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate((h, np.zeros(n, np.uint64)))
    size = np.repeat(np.minimum(counts, n), own)
    for k in range(n):
        out = (out * np.uint64(0xD6E8FEB86659FD93) + np.where(size > k, padded[at + k], np.uint64(0))) ^ (out >> np.uint64(29))
    return mix(out + size.astype(np.uint64)), where


def distinct_by_text(g: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each text; g's are sorted where they lie."""
    for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True):
        g[a:b].sort()
    new = np.ones(len(g) + 1, bool)
    np.not_equal(g[1:], g[:-1], out=new[1:-1])
    new[where] = True  # a text's first value, whatever the last one's
    new[-1] = False
    at = np.concatenate(([0], np.cumsum(new[:-1])))[where].tolist()
    g = g[new[:-1]]
    return [g[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
