"""Scans: markdown directories, several roots at once, tables, rule files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..schema import CONFIG_SCHEMA


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """``(path, text)`` of every ``.md`` file under a root, one row per file.

    Spark's file index skips names that begin with ``.`` or ``_`` and reads files whole.
    """
    files = spark.read.text(
        root, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_roots(spark: SparkSession, roots: Mapping[str, str], alias: str | None = None) -> DataFrame:
    """``(doc_id, alias, path, text)`` over all roots, or over the one named.

    A file under two roots counts once, for the alias listed first. Nested roots are
    told apart by path before any text is compared.
    """
    if alias is not None and alias not in roots:
        raise KeyError(f"unknown alias {alias!r}; known: {', '.join(sorted(roots)) or 'none'}")
    chosen = {alias: roots[alias]} if alias is not None else dict(roots)
    if not chosen:
        raise ValueError("no roots to read")
    parts = [
        read_notes(spark, root).select(F.lit(name).alias("alias"), F.lit(rank).alias("_rank"), "path", "text")
        for rank, (name, root) in enumerate(chosen.items())
    ]
    notes = parts[0]
    for part in parts[1:]:
        notes = notes.unionByName(part)
    if len(parts) > 1:
        first = notes.groupBy("path").agg(F.min("_rank").alias("_rank"))
        notes = notes.join(first, ["path", "_rank"], "left_semi")
    return notes.select(content_hash(F.col("path")).alias("doc_id"), "alias", "path", "text")


def spread(scan: DataFrame) -> DataFrame:
    """A plain file scan of fewer splits than cores, dealt out to all cores.

    Row-local text work follows the scan's splits, so a small single-file input would
    keep one core busy. Scans with enough splits are returned as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_table(
    spark: SparkSession, source: str, doc_id: str = "doc_id", text: str = "text", *keep: str,
) -> DataFrame:
    """A table or parquet path as documents; other columns only if named."""
    table = spark.read.parquet(source) if "/" in source else spark.read.table(source)
    return table.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A rule file as one ``CONFIG_SCHEMA`` row; a corrupt file is an error."""
    return spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=True, mode="FAILFAST")
