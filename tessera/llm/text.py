"""Vectorised text core shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  A *chunk* is the concatenated UTF-8 of
some consecutive rows; words are found and hashed over the whole chunk with a
handful of numpy passes, so no Python loop runs per word or per row.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U64 = np.uint64
#: Bytes that end a word: ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits and everything beyond ASCII are word bytes.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)

CHUNK_BYTES = 2 << 20
#: Words are hashed over so much text at a time (or one word).
_HASH_BYTES = 1 << 18


def tidy(go: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``go``, and after a task the memory that it freed goes back to the system: Python workers live on, and so do their free lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from go(batches)
        _give_back()

    return run


def tidy_groups(go: Callable[[object, pa.Table, pa.Table], pa.Table]) -> Callable[[object, pa.Table, pa.Table], pa.Table]:
    """As ``tidy``, for a function of cogroups: after each."""

    def run(key: object, left: pa.Table, right: pa.Table) -> pa.Table:
        out = go(key, left, right)
        _give_back()
        return out

    return run


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h.astype(_U64, copy=True)
    h ^= h >> _U64(30)
    h *= _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(27)
    h *= _U64(0x94D049BB133111EB)
    h ^= h >> _U64(31)
    return h


def _odd(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(seed, seed + n, dtype=_U64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)


_BASE = int(_odd(7, 1)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = _odd(1000, 256)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U64), np.ones(1, _U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    global _powers
    if len(_powers[0]) < n:
        size, out = max(n, _HASH_BYTES), []
        for base in (_BASE, _INVERSE):
            a, step = np.ones(1, _U64), base
            while len(a) < size:
                a = np.concatenate([a, a * _U64(step)])
                step = step * step % (1 << 64)
            out.append(a[:size])
        _powers = (out[0], out[1])
    return _powers


@dataclass
class Chunk:
    """Rows first..first+rows of a batch; offsets has rows + 1 entries into data."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of about ``limit`` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield Chunk(at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Words of a chunk in order; of row r: first[r] to first[r + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(chunk: Chunk, kind: np.ndarray = SPACED, fold: np.ndarray = SAME) -> Words:
    """Maximal runs of ``kind`` bytes within a row, hashed after folding each byte."""
    b, n = chunk.data, len(chunk.data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(chunk.offsets), np.int64), np.zeros(0, _U64))
    inside = kind[b]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = chunk.offsets[1:-1]
    cut = edge[(edge > 0) & (edge < n)]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    value, h, lo = _VALUE[fold], np.empty(len(starts), _U64), 0
    while lo < len(starts):
        at = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, at + _HASH_BYTES, "right")))
        part = b[at : ends[hi - 1]]
        power, inverse = powers(len(part))
        total = np.empty(len(part) + 1, _U64)
        total[0] = 0
        np.cumsum(value[part] * power[: len(part)], out=total[1:])
        i, j = starts[lo:hi] - at, ends[lo:hi] - at
        h[lo:hi] = mix((total[j] - total[i]) * inverse[i] + (j - i).astype(_U64) * _U64(0xD6E8FEB86659FD93))
        lo = hi
    return Words(starts, ends, np.searchsorted(starts, chunk.offsets), h)


_G1, _G2 = int(_odd(31, 1)[0]), int(_odd(57, 1)[0])


def grams(h: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of each n consecutive entries of h (across rows too; the caller masks)."""
    if len(h) < n:
        return np.zeros(0, _U64)
    base = _G2 if second else _G1
    m = len(h) - n + 1
    out = h[:m] * _U64(1)
    for i in range(1, n):
        out *= _U64(base)
        out += h[i : i + m]
    return mix(out)


def within(first: np.ndarray, n: int) -> np.ndarray:
    """Which of the grams of length n lie within one row."""
    total = int(first[-1])
    m = max(0, total - n + 1)
    if not m:
        return np.zeros(0, bool)
    last = np.repeat(first[1:], np.diff(first))[:m]
    return np.arange(m) + n <= last


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i], one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - before, lengths)
