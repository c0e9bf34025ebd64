"""Sinks: modified documents, full refreshes, new notes."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug, trim_ws
from ..operators.scale import keep_where

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def modified_only(reconciled: DataFrame) -> DataFrame:
    """K1: the documents a sync changed."""
    return keep_where(reconciled, F.col("modified"))


def write_modified(reconciled: DataFrame, path: str, *partition_by: str) -> None:
    """K1: write changed documents as parquet. ``path`` must not be the input's."""
    sources = [f.rstrip("/") for f in reconciled.inputFiles()]
    target = path.rstrip("/")
    bare = target.removeprefix("file://").removeprefix("file:")
    if any(f.split("://")[-1].removeprefix("file:").startswith(bare + "/") for f in sources):
        raise ValueError("refusing to write over the documents being read")
    modified_only(reconciled).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_files(notes: DataFrame, root: str, name: str = "path", text: str = "text") -> int:
    """K1, in place: each row's text as the file ``name`` under ``root``; returns how many.

    A file is written beside its place and moved there, so that readers see the old text or the new one, whole. A task
    that is run again leaves the same files.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        system, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for i in range(batch.num_rows):
                place = f"{base.rstrip('/')}/{batch.column(0)[i].as_py()}"
                folder, _, file = place.rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                beside = f"{folder}/.{file}.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as out:
                    out.write(batch.column(1)[i].as_buffer())
                system.move(beside, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = notes.select(F.col(name).alias("name"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(work, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def refreshed(docs: DataFrame, modified: DataFrame) -> DataFrame:
    """K1, full refresh: every document, with the new text where there is one."""
    new = modified.select("doc_id", F.col("text").alias("_new"))
    return docs.join(new, "doc_id", "left").withColumn(
        "text", F.coalesce("_new", "text")).drop("_new").select(*docs.columns)


def note_frame(notes: DataFrame, order: str = "doc_id") -> DataFrame:
    """K3: ``(alias, slug, filename, text, collisions)``, one row per file a save would leave.

    Notes with equal slugs overwrite each other, so the last by ``order`` (unique) stays;
    ``collisions`` counts the ones lost. Winners are found from slugs and order keys
    alone and their texts are picked up after, so a slug held by a third of all notes
    is one counter per task.
    """
    named = notes.select("alias", order, slug(F.col("text")).alias("slug"))
    last = named.groupBy("alias", "slug").agg(
        F.max(order).alias(order), (F.count("*") - 1).alias("collisions"))
    kept = notes.select(order, "text").join(last, order)
    return kept.select(
        "alias", "slug", F.concat("slug", F.lit(".md")).alias("filename"),
        F.concat(trim_ws(F.col("text")), F.lit("\n")).alias("text"), "collisions", order)
