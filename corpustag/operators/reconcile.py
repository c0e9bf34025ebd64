"""Tag reconciliation: expected against existing tags, and the text edits that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.text import no_strings
from ..sources.runs import RunTable
from .match import match_legacy_keywords
from .scale import INLINE_RULES, bounded_rows, lookup_join


def expected_tags(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """``(doc_id, matched_rules, expected)`` from distinct ``(doc_id, rule_no)``.

    Both lists follow rule order, tags first-seen; a document's list is bounded by the
    rule set.
    """
    known = lookup_join(hits, rules.select("rule_no", "id", "tags"), ["rule_no"])
    ordered = F.sort_array(F.collect_list(F.struct("rule_no", "id", "tags")))
    return known.groupBy("doc_id").agg(ordered.alias("_hits")).select(
        "doc_id", F.col("_hits.id").alias("matched_rules"),
        F.array_distinct(F.flatten(F.col("_hits.tags"))).alias("expected"))


def managed_tags(rules: DataFrame) -> DataFrame:
    """The distinct tags of the given (enabled) rules, one per row."""
    return rules.select(F.explode("tags").alias("tag")).distinct()


def tags_to_remove(existing: Column, managed: Column, expected: Column) -> Column:
    """G4, in existing order."""
    return F.array_except(F.array_intersect(existing, managed), expected)


def tags_to_add(expected: Column, existing: Column) -> Column:
    """G5, in expected order."""
    return F.array_except(expected, existing)


def managed_subset(tagged: DataFrame, managed: DataFrame) -> DataFrame:
    """``(doc_id, existing, managed_here)``: the existing tags that are managed.

    For rule sets whose tags do not fit a constant: existing tags are exploded and
    looked up, then gathered per document again in their order.
    """
    listed = tagged.select("doc_id", F.posexplode("existing").alias("_i", "tag"))
    kept = lookup_join(listed, managed, ["tag"], "left_semi").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("_i", "tag"))).alias("_kept"))
    return kept.select("doc_id", F.col("_kept.tag").alias("managed_here"))


def with_changes(diff: DataFrame) -> DataFrame:
    """G4, G5 and the ``modified`` flag over ``existing, managed, expected`` columns."""
    changed = diff.withColumn(
        "removed", tags_to_remove(F.col("existing"), F.col("managed"), F.col("expected"))
    ).withColumn("added", tags_to_add(F.col("expected"), F.col("existing")))
    return changed.withColumn("modified", (F.size("added") > 0) | (F.size("removed") > 0)).drop(
        "existing", "managed", "expected")


def reconciled_text(text: Column, removed: Column, added: Column, compat: bool = False) -> Column:
    """Stale tags out first, then missing tags in."""
    return md.insert_tags(md.remove_tags(text, removed, compat), added)


def sync_summary(diff: DataFrame, *by: str) -> DataFrame:
    """Documents processed and modified, tags added and removed; per ``by`` if given."""
    totals = [
        F.count("*").alias("processed"),
        F.count_if("modified").alias("modified"),
        F.coalesce(F.sum(F.size("added")), F.lit(0)).alias("tags_added"),
        F.coalesce(F.sum(F.size("removed")), F.lit(0)).alias("tags_removed"),
    ]
    return diff.groupBy(*by).agg(*totals) if by else diff.agg(*totals)


def rule_statistics(hits: DataFrame, rules: DataFrame, run_ts: Column) -> DataFrame:
    """Per rule, the documents it hit in this run and when; silent rules are absent."""
    counts = hits.select("doc_id", "rule_no").distinct().groupBy("rule_no").agg(
        F.count("*").alias("match_count"))
    return counts.join(rules.select("rule_no", F.col("id").alias("rule_id")), "rule_no").select(
        "rule_id", "match_count", run_ts.alias("last_triggered"))


def statistics_over_runs(spark: SparkSession, folder: str, fold_every: int = 100) -> RunTable:
    """G11 over time: a table to ``record`` each run's statistics in; a run that is repeated counts once."""
    return RunTable(spark, folder, "rule_id string, match_count bigint, last_triggered timestamp",
                    lambda rows: merged_statistics(rows).withColumn("run", F.lit(None).cast("bigint")), fold_every)


def merged_statistics(runs: DataFrame) -> DataFrame:
    """Documents a rule hit in all runs, and when last."""
    return runs.groupBy("rule_id").agg(
        F.sum("match_count").alias("match_count"), F.max("last_triggered").alias("last_triggered"))


def merge_statistics(stored: DataFrame, run: DataFrame) -> DataFrame:
    """G11 over time: add a run's counts to the stored ones, keep the later time."""
    return stored.unionByName(run).groupBy("rule_id").agg(
        F.sum("match_count").alias("match_count"), F.max("last_triggered").alias("last_triggered"))


def legacy_reconcile(docs: DataFrame, keywords: DataFrame, compat: bool = False) -> DataFrame:
    """M5 as the matcher, then the same reconciliation.

    Returns ``doc_id, modified, added, matched_keywords, text``; removed tags are acted
    on but not reported.
    """
    hits = match_legacy_keywords(docs, keywords)
    named = keywords.select(
        F.col("keyword_no").alias("rule_no"), F.col("keyword").alias("id"), "tags")
    expected = expected_tags(hits.select("doc_id", F.col("keyword_no").alias("rule_no")), named)
    tagged = docs.select("doc_id", "text", md.existing_tags(F.col("text")).alias("existing")).join(
        expected, "doc_id", "left").withColumn("expected", F.coalesce("expected", no_strings())).withColumn(
        "matched_rules", F.coalesce("matched_rules", no_strings()))
    diff = with_changes(with_managed(tagged, managed_tags(named)))
    return diff.select(
        "doc_id", "modified", "added", F.col("matched_rules").alias("matched_keywords"),
        reconciled_text(F.col("text"), F.col("removed"), F.col("added"), compat).alias("text"))


def with_managed(tagged: DataFrame, managed: DataFrame) -> DataFrame:
    """Add ``managed``: a constant when the tags are few, else looked up per document."""
    rows = bounded_rows(managed, INLINE_RULES)
    if rows is not None:
        tags = sorted(r["tag"] for r in rows)
        return tagged.withColumn("managed", F.lit(tags) if tags else no_strings())
    subset = managed_subset(tagged, managed).withColumnRenamed("managed_here", "managed")
    return tagged.join(subset, "doc_id", "left").withColumn("managed", F.coalesce("managed", no_strings()))
