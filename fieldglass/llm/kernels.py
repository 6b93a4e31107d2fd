"""Numpy kernels over concatenated texts: byte buffers, prefix hashes, word and shingle hashes."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random odd 64-bit value for each byte, and the base of the prefix hash with its inverse modulo 2**64.
BYTE_VALUE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(_RNG.integers(2**62, 2**63, dtype=np.uint64)) | 1
INVERSE = pow(BASE, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that part words: blank and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Texts are taken together up to so many bytes; a longer text is taken alone, whole.
CHUNK = 1 << 20
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n, kept for the next call up to 4 CHUNK."""
    if len(_POWERS[0]) < n:
        made = []
        for b in (BASE, INVERSE):
            p = np.full(n, b, U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 4 * CHUNK:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_chunks(column):
    """(first row, bytes, row offsets) of runs of rows of an Arrow string column, about CHUNK bytes each; null: no bytes."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], kind, n + 1 + column.offset)[column.offset :].astype(np.int64) if bufs[1] is not None and n else np.zeros(n + 1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes h (one longer than data) and inverse powers; the hash of data[a:e] is (h[e] - h[a]) * inv[a]."""
    p, inv = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUE[data] * p[:-1], out=h[1:])
    return h, inv


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word, in order, and the word offsets of the rows."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(offs), np.int64)
    low = LOWER[data]
    solid = ~IS_SPACE[data]
    inner = offs[(offs > 0) & (offs < len(data))]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[inner] = False
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    h, inv = prefix(low)
    words = mix((h[end] - h[start]) * inv[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))
    return words, np.searchsorted(start, offs)


def shingles(words: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each row, repeats kept, and row offsets; a row of fewer words has its whole sequence."""
    n = np.diff(woffs)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    soffs = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(soffs[-1]), U)
    if len(words) >= k:
        every = np.zeros(len(words) - k + 1, U)
        for j in range(k):
            every = mix(every ^ words[j : len(words) - k + 1 + j]) + U(j + 1)
        row = np.repeat(np.arange(len(n)), count)
        at = np.flatnonzero((n >= k)[row])
        out[at] = every[at - soffs[row[at]] + woffs[row[at]]]
    for r in np.flatnonzero((n > 0) & (n < k)):
        v = np.array([n[r] + 1000], U)
        for w in words[woffs[r] : woffs[r + 1]]:
            v = mix(v ^ w) + U(7)
        out[soffs[r]] = v[0]
    return out, soffs


def runs(solid: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets) of the maximal runs of true values; offs are the rows' offsets, and no run crosses a row."""
    n = len(solid)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inner = offs[(offs > 0) & (offs < n)]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    before[inner] = False
    after[inner - 1] = False
    start = np.flatnonzero(solid & ~before)
    return start, np.flatnonzero(solid & ~after) + 1, np.searchsorted(start, offs)


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    h, inv = prefix(data)
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))
