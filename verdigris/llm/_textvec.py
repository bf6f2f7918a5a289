"""Whole-buffer text kernels: words, word hashes and shingle hashes of an Arrow string column without per-word Python.

Words are maximal runs of bytes other than space and 0x09-0x0D, after A-Z are lower-cased. UTF-8 continuation bytes
are never white space, so working on bytes and on characters gives the same words.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15 | 1)
_PINV = U64(pow(int(_P), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A pseudo-random 64-bit value for each byte.
BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []
_kept: dict[str, dict] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[U64(1)], np.full(size - 1, p, U64)]).cumprod(dtype=U64) for p in (_P, _PINV)]
    return _powers[0], _powers[1]


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    trim()


def trim() -> None:
    """Gives memory that is free in this process back to the system: workers are used again, and two share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def kept(operator: str) -> dict:
    """What this worker process keeps between tasks of ``operator``; what it kept for another goes, as workers serve all of them in turn."""
    if operator not in _kept:
        _kept.clear()
        trim()
    return _kept.setdefault(operator, {})


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, first word of each row with the total last)."""
    low = _LOWER[data]
    inside = ~_SPACE[low]
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    if len(low):
        end[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return low, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, moved to position 0, then mixed with its length."""
    up, down = powers(len(low) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(low) + 1, U64)
        np.cumsum(BYTE[low] * up[: len(low)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words of one sequence; a shorter non-empty sequence is one shingle of its own."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, U64)
    width = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, U64(width) * U64(0xA24BAED4963EE407), U64)
        for j in range(width):
            out = out * U64(0x9FB21C651E98DF25) + hashes[j : n - width + 1 + j]
        return mix(out)
