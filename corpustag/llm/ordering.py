"""Numbering rows of a table in a total order, and cutting a key's range into even slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpustag.llm.storage import Scratch, partitions

#: Bits below the partition number in monotonically_increasing_id().
ROW_BITS = 33


def numbered(df: DataFrame, order: list[str], scratch: Scratch, name: str, descending: bool = False) -> DataFrame:
    """``df`` with ``row_no`` 0, 1, ... in the order of ``order``; rows equal in it are numbered arbitrarily.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus the rows of
    the partitions before. Equal rows are told apart by a written tie-breaker, so a hot key is split too.
    Nulls come last. Only one row per partition meets in one place.
    """
    spark = df.sparkSession
    tied = scratch.keep(df.withColumn("_tie", F.monotonically_increasing_id()), f"{name}_tied")
    keys = [(F.desc_nulls_last if descending else F.asc_nulls_last)(c) for c in order] + [F.asc("_tie")]
    placed = scratch.keep(
        tied.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()), f"{name}_placed")
    slice_of = F.shiftrightunsigned("_at", ROW_BITS)
    counts = placed.groupBy(slice_of.alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # one row per shuffle partition, so the broadcast has a fixed bound
    return (placed.withColumn("_slice", slice_of).join(F.broadcast(bases), "_slice")
            .withColumn("row_no", F.col("_base") + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1))
            .drop("_tie", "_at", "_slice", "_base"))


def slice_bounds(df: DataFrame, key: str, slices: int) -> list[int]:
    """At most ``slices - 1`` ascending values of the integer column ``key`` that cut its rows evenly."""
    cuts = df.approxQuantile(key, [i / slices for i in range(1, slices)], 1 / (4 * slices)) if slices > 1 else []
    return sorted({int(c) for c in cuts})


def slice_of(key: Column, bounds: list[int]) -> Column:
    """How many of ``bounds`` are below ``key``, by binary search over a constant."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: F.when(F.get(table, at + step - 1) < key, at + step).otherwise(at))


def running_sums(df: DataFrame, order: list[str], weight: str, scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``start``: the sum of the integer column ``weight`` over all rows before, in the order of ``order``.

    As ``numbered``, with sums in place of counts: a window per even slice of the order, and one row per slice in one place.
    """
    spark = df.sparkSession
    tied = scratch.keep(df.withColumn("_tie", F.monotonically_increasing_id()), f"{name}_tied")
    keys = [F.asc_nulls_last(c) for c in order] + [F.asc("_tie")]
    placed = scratch.keep(
        tied.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()), f"{name}_placed")
    placed = placed.withColumn("_slice", F.shiftrightunsigned("_at", ROW_BITS))
    totals = placed.groupBy("_slice").agg(F.sum(weight).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("_before", F.coalesce(F.sum(weight).over(within), F.lit(0)))
            .join(F.broadcast(bases), "_slice").withColumn("start", F.col("_base") + F.col("_before"))
            .drop("_tie", "_at", "_slice", "_base", "_before"))
