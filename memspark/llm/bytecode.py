"""Whole texts as numpy arrays: the bytes of an Arrow column, and hashes of their words without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bytes that are hashed at once; a cut falls on white space.
STRETCH = 1 << 20
_rng = np.random.default_rng(20_240_501)
#: A random number for each byte, and an odd base for the powers.
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column; nulls are empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, width, len(column) + 1, column.offset * width().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return all_bytes[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray, add: int = 0) -> np.ndarray:
    """Every bit of the result depends on every bit of x (the finalizer of splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (add + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for k, b in (("up", BASE), ("down", UNBASE)):
            p = np.full(n, b)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def words(data: np.ndarray, hashed: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, hashes) of the words of ``data``, stretch by stretch; a word's hash depends on its bytes alone."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + STRETCH)
        while stop < len(data):
            gap = np.flatnonzero(IS_SPACE[data[stop : stop + 4096]])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(len(data), stop + 4096)
        part = data[at:stop]
        inside = ~IS_SPACE[part]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(starts) and not hashed:
            yield starts + at, ends + at, np.empty(0, np.uint64)
        elif len(starts):
            up, down = powers(len(part) + 1)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[part] * up[: len(part)], dtype=np.uint64)))
            yield starts + at, ends + at, mixed((total[ends] - total[starts]) * down[starts])
        at = stop


def column_words(column: pa.Array, fold: np.ndarray | None = None, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, hashes, first) of a column: first[i] to first[i+1] are the words of row i.

    ``fold`` maps bytes first; without ``hashed`` the hashes are left out.
    """
    data, offsets = buffers(column)
    data = data if fold is None else fold[data]
    # a space between rows: their words never join
    spaced = np.insert(data, offsets[1:-1], 0x20) if len(offsets) > 2 else data
    shift = offsets + np.minimum(np.arange(len(offsets)), max(0, len(offsets) - 2))
    found = list(words(spaced, hashed))
    starts = np.concatenate([x[0] for x in found]) if found else np.empty(0, np.int64)
    ends = np.concatenate([x[1] for x in found]) if found else np.empty(0, np.int64)
    hashes = np.concatenate([x[2] for x in found]) if found else np.empty(0, np.uint64)
    first = np.searchsorted(starts, shift[:-1], side="left")
    return spaced, starts, ends, hashes, np.concatenate((first, [len(starts)]))


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text; a longer text is a run of its own."""
    for a, n in spans(batch.column(column), limit):
        yield batch.slice(a, n)


def spans(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows of about ``limit`` bytes."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(), dtype=np.int64)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield a, b - a
        a = b
