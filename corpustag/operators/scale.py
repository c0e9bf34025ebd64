"""Join and ordering helpers that hold up when keys are skewed or tables grow.

A side is broadcast only after counting that it is small; past the bound there is
a salted shuffle join. Row numbers and neighbours over a hot key are computed per
slice of the key's order, then carried across slices, so no task sees a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BROADCAST_ROWS = 200_000
INLINE_RULES = 1_000
SALTS = 16


def bounded_rows(df: DataFrame, limit: int) -> list[Row] | None:
    """The rows of a configuration-sized frame, or None if it has more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def local_frame(spark: SparkSession, rows: Sequence[Row], schema: T.StructType) -> DataFrame:
    """Rows as a local relation: selecting from it, or collecting it, starts no job."""
    records = [r.asDict(recursive=True) for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, to_arrow_schema(schema)), schema)


def settled(df: DataFrame, limit: int = INLINE_RULES) -> DataFrame:
    """A configuration-sized frame read once and held locally; a larger one as it is."""
    rows = bounded_rows(df, limit)
    return df if rows is None else local_frame(df.sparkSession, rows, df.schema)


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """``where`` for a condition on costly computed columns.

    A plain filter is pushed below the projection that computes its columns and so
    computes them again there. Rows that pass leave through a generator instead.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.explode_outer(F.when(condition, F.array(row))).alias("_row")).where(
        "_row is not null").select("_row.*")


def one_by_one(df: DataFrame, keep: Sequence[str | Column], values: Column, *names: str) -> DataFrame:
    """The elements of an array without null ones, a row each, as the column of one name or a struct's fields as several.

    For a plain ``explode`` Spark first asks, in filters of its own, whether the array is null or empty, and works it
    out anew each time: a text would be scanned three times. Elements that leave an outer generator are computed once.
    """
    rows = F.explode_outer(values).alias(names[0]) if len(names) == 1 else F.inline_outer(values).alias(*names)
    return df.select(*keep, rows).where(F.col(names[0]).isNotNull())


def held(df: DataFrame) -> DataFrame:
    """The frame computed once, where the session names a shared checkpoint folder."""
    spark = df.sparkSession
    return df.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) else df


def values_of(df: DataFrame, value: str | Column) -> list:
    """The distinct values of a column that has few of them, sorted, nulls left out."""
    column = df.select(value)
    rows = bounded_rows(column, INLINE_RULES)
    if rows is None:
        rows = column.distinct().collect()
    return sorted({r[0] for r in rows if r[0] is not None})


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that several rows share; only they are shuffled."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return settled(held(counts.where("_n > 1").select(key)), BROADCAST_ROWS)


def where_or_shared(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Rows that pass, and all rows of keys that several rows share, as those stand together."""
    shared = repeated_keys(df, key)
    if not shared.take(1):
        return df.where(condition)
    shared = shared.withColumn("_shared", F.lit(True))
    marked = df.join(F.broadcast(shared) if is_small(shared) else shared, key, "left")
    return marked.where(condition | F.coalesce("_shared", F.lit(False))).drop("_shared")


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    first = df.select(df.columns[0])
    few = min(limit, INLINE_RULES)
    return bounded_rows(first, few) is not None or (few < limit and first.limit(limit + 1).count() <= limit)


def lookup_join(
    stream: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a corpus-sized stream with a lookup table on equal keys.

    Up to ``limit`` rows the table is broadcast. A larger one is copied once per
    salt and joined by shuffle, so that a term holding a third of the stream is
    spread over many tasks. ``how`` is inner, left or left_semi (stream side kept).
    """
    if is_small(table, limit):
        return stream.join(F.broadcast(table), list(keys), how)
    # a hash of the row, not a random number: a retried task must deal its rows to the same salts
    plain = [f.name for f in stream.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    salted = stream.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def numbered_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_of: Column, name: str,
) -> DataFrame:
    """``row_number()`` over ``keys`` in ``order``, without a task per key.

    ``slice_of`` must not decrease along ``order``; each (key, slice) is numbered on
    its own and shifted by the row counts of the key's earlier slices.
    """
    sliced = df.withColumn("_slice", slice_of)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = counts.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_within", F.row_number().over(within))
        .join(shifts, [*keys, "_slice"])
        .withColumn(name, F.col("_within") + F.col("_shift"))
        .drop("_slice", "_within", "_shift")
    )


def running_sum_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], slice_of: Column, weight: str, name: str,
) -> DataFrame:
    """The sum of ``weight`` over the rows of ``keys`` up to this one in ``order``, without a task per key.

    As ``numbered_within``: each (key, slice) on its own, shifted by the sums of the key's earlier slices.
    """
    sliced = df.withColumn("_slice", slice_of)
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum(weight).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (sliced.withColumn("_within", F.sum(weight).over(within)).join(shifts, [*keys, "_slice"])
            .withColumn(name, F.col("_within") + F.col("_shift")).drop("_slice", "_within", "_shift"))


def with_neighbour(
    df: DataFrame, key: str, order: Sequence[str], slice_of: Column, value: Column,
    name: str, following: bool = False,
) -> DataFrame:
    """``lag(value)`` (or ``lead``) over ``key`` in ``order``, without a task per key.

    Inside a slice it is the plain window function. The row at the slice's edge takes
    the value from the edge of the nearest non-empty slice, out of a table with one
    row per (key, slice).
    """
    sliced = df.withColumn("_slice", slice_of).withColumn("_value", F.struct(value.alias("v")))
    toward = F.lead if following else F.lag
    within = Window.partitionBy(key, "_slice").orderBy(*order)
    place = F.struct(*order)
    edge_value = F.min_by("_value", place) if following else F.max_by("_value", place)
    edges = sliced.groupBy(key, "_slice").agg(edge_value.alias("_edge"))
    over_slices = Window.partitionBy(key).orderBy("_slice")
    edges = edges.select(key, "_slice", toward("_edge").over(over_slices).alias("_edge"))
    return (
        sliced.withColumn("_near", toward("_value").over(within))
        .join(edges, [key, "_slice"], "left")
        .withColumn(name, F.coalesce("_near", "_edge")["v"])
        .drop("_slice", "_value", "_near", "_edge")
    )
