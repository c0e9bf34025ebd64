"""Sharding by a Feistel permutation of global row numbers (DataFrame functions only)."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpustag.llm.ordering import numbered
from corpustag.llm.storage import Scratch

#: A prime below 2^31: squares of residues fit a signed 64-bit integer.
PRIME = 2_147_483_647
ROUNDS = 6
#: Cycle walks written into the plan; see ``permuted``.
WALKS = 64


def sides(total: int) -> tuple[int, int]:
    """Least near-square grid of at least ``total`` cells; fewer cells than ``left`` are in excess."""
    left = max(1, math.isqrt(max(0, total - 1)) + 1)
    return left, max(1, -(-total // left))


def round_keys(seed: int) -> list[list[int]]:
    """Three constants for each half round."""
    rng = random.Random(seed)
    return [[rng.randrange(1, PRIME) for _ in range(3)] for _ in range(ROUNDS)]


def quotient(number: Column, by: int) -> Column:
    """Whole part of a division of integers below 2^53."""
    return ((number - number % by) / by).cast("bigint")


def scrambled(value: Column, keys: Column) -> Column:
    """Iterated quadratic map modulo a prime."""
    return F.aggregate(keys, value, lambda t, c: (t + c) % PRIME * ((t + c) % PRIME) + c)


def feistel(number: Column, total: int, seed: int) -> Column:
    """One pass of an unbalanced Feistel network over the grid of ``sides(total)``."""
    left, right = sides(total)
    keys = round_keys(seed)
    rounds = F.array(*[
        F.struct(F.lit(i % 2).alias("side"), F.array(*[F.lit(k).cast("bigint") for k in ks]).alias("keys"))
        for i, ks in enumerate(keys)])

    def half(s: Column, r: Column) -> Column:
        moved_l = (s["l"] + scrambled(s["r"], r["keys"])) % left
        moved_r = (s["r"] + scrambled(s["l"], r["keys"])) % right
        even = r["side"] == 0
        return F.struct(F.when(even, moved_l).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(moved_r).alias("r"))

    start = F.struct(quotient(number, right).alias("l"), (number % right).alias("r"))
    return F.aggregate(rounds, start, half, lambda s: s["l"] * right + s["r"])


def permuted(number: Column, total: int, seed: int) -> Column:
    """Image of 0..total-1 under a keyed permutation of 0..total-1, by cycle walking.

    A walk leaves the grid's excess cells (fewer than one row of the grid) after one step but for about
    one number in sqrt(total); a chain has at most as many steps as there are excess cells, plus one. Grids with
    fewer than ``WALKS`` excess cells are thus always done; beyond, a longer chain has a chance below
    64^-64 and is an error, never a wrong or missing row.
    """
    left, right = sides(total)
    walks = min(WALKS, left * right - total + 1)
    seen = F.aggregate(
        F.sequence(F.lit(1), F.lit(walks)), feistel(number, total, seed),
        lambda at, _: F.when(at < total, at).otherwise(feistel(at, total, seed)))
    done = F.transform(F.array(seen), lambda x: F.when(x < total, x).otherwise(
        F.raise_error(F.lit("cycle walk did not end")).cast("bigint")))
    return F.get(done, 0)


def shards(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n_shards: int = 8,
           seed: int = 11) -> DataFrame:
    """Shard and slot of every document: row counts of shards differ by at most one.

    Rows are numbered by (id, size, checksum); the permuted number gives shard (remainder) and slot
    (quotient), both computable from the number alone. Columns: the id, ``size`` (UTF-8 bytes of the text
    plus 1), ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` (null under this law).

    A null text counts as empty, a null id sorts last, repeated rows get places of their own, an empty
    table gives no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    small = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text) + F.lit(1).cast("bigint")).alias("size"),
                        F.crc32(text).alias("text_crc32"))
    rows = numbered(small, ["doc_id", "size", "text_crc32"], scratch, "rows")
    total = spark.read.parquet(f"{scratch.folder}/rows_placed").count()
    placed = rows.withColumn("_p", permuted(F.col("row_no"), total, seed))
    return placed.select(
        F.col("doc_id").alias(id_column), "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_p") % n_shards).cast("int").alias("shard"),
        quotient(F.col("_p"), n_shards).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
