"""Running sums and lookups within a row: Catalyst has none that is linear, so offsets of lists go through numpy."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sums_before(lists: pa.Array) -> pa.Array:
    """Per list of integers without nulls the sum of the elements before each one."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    values = np.asarray(lists.values)[offsets[0]:offsets[-1]].astype(np.int64)
    offsets = offsets - offsets[0]
    before = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=before[1:])
    own = before[:-1] - np.repeat(before[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(own.astype(np.int32)))


def running(values: Column) -> Column:
    """For an array of integers, per element the sum of those before it; an empty array for none."""
    def work(lists: pa.Array) -> pa.Array:
        return sums_before(lists)
    return F.arrow_udf(work, "array<int>")(F.coalesce(values, F.array().cast("array<int>")))


def units_at(points: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
    """Per list of places the index of the interval each lies in, or -1. Intervals are in order and do not overlap."""
    def parts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values).astype(np.int64)
    (of, at), (left_of, left), (right_of, right) = parts(points), parts(begins), parts(ends)
    out = np.full(of[-1] - of[0], -1, np.int32)
    for k in range(len(points)):
        own, lows = at[of[k]:of[k + 1]], left[left_of[k]:left_of[k + 1]]
        if len(lows):
            highs = right[right_of[k]:right_of[k + 1]]
            i = np.searchsorted(lows, own, "right") - 1
            out[of[k] - of[0]:of[k + 1] - of[0]] = np.where((i >= 0) & (own < highs[i]), i, -1)
    return pa.ListArray.from_arrays(pa.array((of - of[0]).astype(np.int32)), pa.array(out))


def unit_at(points: Column, begins: Column, ends: Column) -> Column:
    """For an array of places, per element the index of the interval from ``begins`` to ``ends`` it lies in, or -1."""
    def work(points: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
        return units_at(points, begins, ends)
    lists = [F.coalesce(c.cast("array<int>"), F.array().cast("array<int>")) for c in (points, begins, ends)]
    return F.arrow_udf(work, "array<int>")(*lists)
