"""Words and shingles of Arrow columns of UTF-8 bytes, hashed with numpy a slice of documents at a time.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
Functions here run in Python workers; they are pickled by value, so workers need no copy of the package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text hashed at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
FACTOR = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers modulo 2^64 of an odd number and of its inverse, made longer as texts need it."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            room = max(n, SLICE_BYTES + 1)
            ups, downs = np.full(room, MULTIPLIER, np.uint64), np.full(room, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
            ups[0] = downs[0] = 1
            self.up, self.down = np.cumprod(ups), np.cumprod(downs)
        return self.up[:n], self.down[:n]


def slices(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds within the bytes) of successive rows; ASCII letters in lower case if asked."""
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset: column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, table[data[offsets[first]: offsets[last]]], offsets[first: last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the row of each."""
    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    ink = ~blank[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    starts = np.flatnonzero(ink & (~before | cut[:-1]))
    ends = np.flatnonzero(ink & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial in its bytes, mixed with its length."""
    up, down = powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64) * FACTOR)


def shingles(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words within a row, and the row of each; a shorter row is one run."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    full = np.zeros(n, np.uint64)
    for k in range(size):
        inside = max(0, n - k)
        full[:inside] = full[:inside] * FACTOR + words[k:]
        full[inside:] *= FACTOR
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    counts = np.diff(np.r_[first, n])
    whole = np.zeros(n, bool)
    whole[: max(0, n - size + 1)] = rows[: max(0, n - size + 1)] == rows[size - 1:] if n >= size else False
    out, of = [mix(full[whole])], [rows[whole]]
    short = first[counts < size]
    if len(short):
        total = np.zeros(len(short), np.uint64)
        lengths = counts[counts < size]
        for k in range(size - 1):
            has = lengths > k
            total[has] = total[has] * FACTOR + words[short[has] + k]
        out.append(mix(total + lengths.astype(np.uint64)))
        of.append(rows[short])
    joined, of_row = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of_row, kind="stable") if len(short) else slice(None)
    return joined[order], of_row[order]
