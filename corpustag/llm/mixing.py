"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpustag.llm.ordering import numbered
from corpustag.llm.storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def offset_of(source: Column, seed: int) -> Column:
    """A number in [0, 1) that the seed and the source decide."""
    key = F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("s:"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Sources by code point, null last, take the weights in turn. A target is its weight times one water
    level, at most ``cap`` times the source; the level makes targets sum to ``share`` of all sizes.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn)).withColumn(
        "cap", F.lit(cap) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    level = (
        weighed
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.lit(share) * F.col("all_size") - F.col("capped")) / F.col("rest"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]))
    return level.select(
        "source", "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
          share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7,
          carry: list[str] | None = None) -> DataFrame:
    """How often the mix takes every document: ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    Within its source a document expects ``target / source_size`` copies. Expected copies are summed up in
    the order (size, hash of the id); with one offset per source added, a document is emitted once for each
    integer that its interval crosses. In order of size the words taken miss the target by at most about
    one of the source's largest documents. Numbers come from one range sort, so a hot source is split.

    A null or empty text has size 0 and takes nothing; a null source is a source; documents that share an
    id are told apart arbitrarily but each counted; an empty table gives no rows. Other columns are
    ignored, except those of ``carry``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    text = F.coalesce(F.col(text_column), F.lit(""))
    small = docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")).alias("_mix"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry or []])
    rows = numbered(small, ["source", "size", "_mix"], scratch, "rows")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("row_no").alias("_first"))
    per_source = scratch.keep(per_source, "per_source")
    goal = targets(per_source.select("source", "source_size"), share, cap, weights).alias("goal")
    table = per_source.alias("s").join(goal, F.col("s.source").eqNullSafe(F.col("goal.source"))).select(
        F.col("s.source").alias("_source"), F.col("s.source_size"), F.col("s._first"), F.col("goal.target"),
        offset_of(F.col("s.source"), seed).alias("_u"))
    table = scratch.keep(table, "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("row_no") - F.col("_first")
    copies = F.floor(rate * (rank + 1) + F.col("_u")) - F.floor(rate * rank + F.col("_u"))
    return (rows.join(table, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("copies", F.least(copies, F.lit(int(cap))).cast("bigint"))
            .select(F.col("doc_id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", "target",
                    "copies", (F.col("copies") * F.col("size")).alias("taken"),
                    *[F.col(f"_carry_{c}").alias(c) for c in carry or []]))
