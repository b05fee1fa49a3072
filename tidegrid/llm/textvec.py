"""Vectorised text kernels over Arrow string buffers.

Everything here works on the UTF-8 bytes of whole blocks of texts at once, so that words, hashes and
windows cost a handful of NumPy passes and no Python object per word.  The word classes in use are
ASCII sets, so byte work and code-point work agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20

_SEED = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_BASE2 = 0xAF251AF3B0F025B5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_SEED))

SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: words [^\x20\x09-\x0D]+
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[list(SPACE_BYTES)] = False
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, a-z and all beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n, modulo 2**64; kept for the next call while they are small."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, dtype=U64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=U64))
        have = (tables[0], tables[1])
        if size <= 1 << 22:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (one more than rows) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.zeros(0, np.uint8) if raw is None else np.frombuffer(raw, dtype=np.uint8)
    return data, offs


def blocks(column, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `most` bytes; a longer text stands alone."""
    data, offs = buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(b: np.ndarray, offs: np.ndarray, kind: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (with the total at the end). Words end at rows' ends."""
    n = len(offs) - 1
    if len(b) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    m = kind[b]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    cut = offs[(offs > 0) & (offs < len(b))]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs, side="left")


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    up, down = powers(len(b) + 1)
    total = np.empty(len(b) + 1, U64)
    total[0] = 0
    np.cumsum(BYTE_VALUES[b] * up[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(_SEED))


def window_hashes(values: np.ndarray, k: int, base: int = _BASE2) -> np.ndarray:
    """A hash of each k values in a row; windows across rows must be masked by the caller."""
    if len(values) < k:
        return np.zeros(0, U64)
    up, down = powers(len(values) + 1, base)
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(values) - k + 1])


def byte_window_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes in a row."""
    return window_hashes(BYTE_VALUES[b], k)


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n-k+1 windows of k items lie within one row; `first` as from words()."""
    ok = np.ones(max(0, n - k + 1), bool)
    for c in first[1:-1]:
        ok[max(0, c - k + 1) : c] = False
    return ok


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n items; `first` as from words()."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]


def spread(flags: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n items some flagged window of k items covers; windows start where flags are."""
    at = np.flatnonzero(flags)
    d = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + k, minlength=n + 1)[: n + 1]
    return np.cumsum(d[:n]) > 0
