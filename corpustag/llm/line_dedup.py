"""Line deduplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpustag.llm.storage import Scratch

#: Templates are meant to go from a twentieth of a site's pages on. On 500 pages such a share varies by a hundredth; the limit lies
#: three times that below it, so that chance does not decide.
RATIO = 0.02
#: Fewer pages than this say nothing, nor do copies of one page. On a site of under 10 pages more than half of them, and at least
#: ``LEAST_PAGES``, do, if they are not all the same.
MIN_PAGES = 5
LEAST_PAGES = 3


def line_key(line: Column) -> Column:
    """128 bits of a line: two 64-bit hashes with different seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def boilerplate(pages: DataFrame, host_column: str, text_column: str, ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host that has boilerplate: ``_host`` and the keys ``_bad`` of its lines.

    A line is boilerplate where the pages of the host that contain it are at least ``min_pages`` and more
    than ``ratio`` of the host's pages. On a small host fewer pages are enough if they are more than half of its pages,
    ``LEAST_PAGES`` or more, and not all of the same text. A host has at most (mean distinct lines a page) / ratio such lines,
    so the lists are bounded. Counts are combined before the shuffle, which takes hashes, not lines.
    """
    lines = F.array_distinct(F.filter(F.split(F.col(text_column), "\n"), lambda l: F.trim(l) != ""))
    least = min(LEAST_PAGES, min_pages)
    seen = (pages.select(F.col(host_column).alias("_host"), F.xxhash64(text_column).alias("_text"), F.explode(F.transform(lines, line_key)).alias("_line"))
            .groupBy("_host", "_line").agg(
                F.count(F.lit(1)).alias("_pages"), (F.min("_text") < F.max("_text")).alias("_differ")).filter(F.col("_pages") >= least))
    totals = pages.groupBy(F.col(host_column).alias("_of")).agg(F.count(F.lit(1)).alias("_total"))
    most = (2 * F.col("_pages") > F.col("_total")) & F.col("_differ")
    return (seen.join(totals, F.col("_host").eqNullSafe(F.col("_of")))
            .filter((F.col("_pages") > F.lit(ratio) * F.col("_total")) & ((F.col("_pages") >= min_pages) | most))
            .groupBy("_host").agg(F.collect_list("_line").alias("_bad")))


def without_boilerplate(pages: DataFrame, host_column: str = "source", text_column: str = "text", ratio: float = RATIO,
                        min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with boilerplate lines taken out of the text; adds ``n_lines`` and ``n_dropped``.

    Lines end at ``\\n``; blank lines are never boilerplate. A line repeated within a page counts that page
    once, and all its occurrences go. A null host is a host of its own, a null text stays null (no lines),
    a page that holds nothing but boilerplate gets an empty text and stays, an empty table gives no rows.
    Columns of the input named ``n_lines`` or ``n_dropped`` are replaced; all others are carried along.
    The table of boilerplate is written first: its size is known when Spark chooses how to join it.
    """
    scratch = Scratch(pages.sparkSession, "lines")
    bad = scratch.keep(boilerplate(pages, host_column, text_column, ratio, min_pages), "boilerplate")
    page = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_page"))
    text = F.col("_page")[text_column]
    lines = F.split(text, "\n")
    kept = F.when(F.col("_bad").isNull(), lines).otherwise(
        F.filter(lines, lambda l: ~F.array_contains(F.col("_bad"), line_key(l))))
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("bigint")
    others = [c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    return (page.join(bad, F.col("_page")[host_column].eqNullSafe(F.col("_host")), "left")
            .withColumn("_kept", kept)
            .select(*[F.array_join("_kept", "\n").alias(c) if c == text_column else F.col("_page")[c].alias(c) for c in others],
                    n_lines.alias("n_lines"), (n_lines - F.coalesce(F.size("_kept"), F.lit(0))).alias("n_dropped")))
