"""Corpus-wide tag edits: renaming tags and removing them in bulk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.text import regex_escape


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _holds_any(text: Column, tags: Sequence[str], compat: bool) -> Column:
    """Whether any of the tags occurs, fenced blocks and front matter included."""
    names = F.array_join(F.transform(_strings(tags), regex_escape), "|")
    if not compat:
        return F.rlike(text, F.concat(F.lit("#(?:"), names, F.lit(")" + md.NO_TAG_CHAR_AHEAD)))
    return F.length(md.delete_tags(text, _strings(tags), compat=True)) < F.length(text)


def migrate_tags(
    docs: DataFrame, old: Sequence[str], new: Sequence[str], compat: bool = False,
) -> DataFrame:
    """Documents that carry an old tag, with old tags cut and new ones inserted.

    Only changed documents are returned. The text is not cleaned up where a tag was cut.
    The test for old tags runs first, so an unaffected document costs one scan.
    """
    text = F.col("text")
    affected = docs.where(F.contains(text, F.lit("#")) & _holds_any(text, old, compat))
    cut = affected.withColumn("_cut", md.delete_tags(text, _strings(old), compat))
    missing = F.array_except(_strings(new), md.existing_tags(F.col("_cut")))
    return cut.withColumn("text", md.insert_tags(F.col("_cut"), missing)).drop("_cut")


def bulk_remove(docs: DataFrame, tags: Sequence[str], compat: bool = False) -> DataFrame:
    """Documents that carry any of the tags, without them and with blanks cleaned up."""
    text = F.col("text")
    affected = docs.where(F.contains(text, F.lit("#")) & _holds_any(text, tags, compat))
    return affected.withColumn("text", md.bulk_remove_tags(text, _strings(tags), compat))
