"""Whole Arrow text columns as NumPy bytes, so that word work needs no Python object per word.

A null text counts as an empty one. Memory is bounded by SLICE_BYTES or by the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once.
SLICE_BYTES = 1 << 21

#: Longer words are hashed one by one by BLAKE2: sums of powers modulo 2^64 can be made to collide from some length on.
_SPAN = 1 << 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int) -> np.ndarray:
    out = np.full(_SPAN, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows, each of about limit bytes at most."""
    if len(column) == 0:
        return
    data, at = column_bytes(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes b with table[b], which never cross texts: (starts, ends, words before each text)."""
    if data.size == 0:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < data.size)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run [start, end); runs are sorted and don't overlap."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    lengths = ends - starts
    long = np.flatnonzero(lengths > _SPAN)
    own = np.minimum(lengths, _SPAN)
    first = np.cumsum(own) - own
    at = np.arange(int(own.sum()), dtype=np.int64)
    values = (data[at + np.repeat(starts - first, own)].astype(np.uint64) + np.uint64(1)) * _POW[at - np.repeat(first, own)]
    out = mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _STEP)
    for k in long.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def unique_rows(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row of a ragged array, and how many there are."""
    ends = np.cumsum(counts)
    parts = [np.unique(values[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), sizes


def table_of(members) -> np.ndarray:
    """A look-up table by byte of which bytes belong to words."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


def folding() -> np.ndarray:
    """A byte table that lower-cases A-Z and leaves all else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table
