"""Sync of what changed since the last run: new texts, and all of them once rules or annotator are others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.rules import active_rules
from ..sources.runs import RunTable, newest
from .sync import reconcile

#: Changes with what the built-in annotators find, so that a new release looks at everything again.
ANNOTATOR = "builtin-1"


def rules_version(rules: DataFrame) -> str:
    """A digest of the active rules and their order; the same rules give the same, however they are stored."""
    active = active_rules(rules)
    own = [c for c in sorted(active.columns) if c not in ("created", "modified", "description")]
    # as text, so that a null is told from an empty value
    hashed = F.xxhash64(F.to_json(F.struct(*own))).cast("decimal(38,0)")
    row = active.agg(F.count(F.lit(1)).alias("n"), F.sum(hashed).alias("s"), F.bit_xor(hashed.cast("bigint")).alias("x")).first()
    return f"{row['n']}-{row['s']}-{row['x']}"


class SyncState(RunTable):
    """Hashes of the texts a sync has left, by document: (``doc_id``, ``hash``, ``version``)."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint", fold_every: int = 100):
        super().__init__(spark, folder, f"doc_id {id_type}, hash string, version string", lambda rows: newest(rows, "doc_id"), fold_every)

    def seen(self, before: int | None = None) -> DataFrame:
        return newest(self.rows(before), "doc_id").select("doc_id", "hash", "version")


def pending(docs: DataFrame, seen: DataFrame, version: str) -> DataFrame:
    """Documents whose text is not the one that ``version`` left.

    Ids and hashes alone are compared; texts are then picked up by id, and stay where they are if few are pending. Of documents
    that share an id all are pending if one is.
    """
    hashes = docs.select(F.col("doc_id").alias("_id"), content_hash(F.coalesce("text", F.lit(""))).alias("_hash"))
    known = seen.where(F.col("version") == version).select("doc_id", "hash")
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("hash"))
    new = hashes.join(known, same, "left_anti").select("_id").distinct()
    return docs.join(new, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def sync_changed(
    docs: DataFrame, rules: DataFrame, state: SyncState, sink: Callable[[DataFrame, int], None],
    annotator: str = ANNOTATOR, run: int | None = None, **options,
) -> int:
    """One run: reconcile what is pending, hand the result to ``sink(reconciled, run)``, remember the texts as left; returns the run.

    ``run`` repeats a run that failed. The state is written last, from what the sink was given: a run that dies is done again whole,
    and one that is repeated reads the state before it. The first run sees everything, as does the first after a change of
    rules or annotator. ``options`` are those of ``reconcile``.
    """
    number = state.next_run() if run is None else run
    version = f"{annotator}/{rules_version(rules)}"
    # texts stay where they are if this version has left none
    unknown = state.rows(number).where(F.col("version") == version).isEmpty()
    done = reconcile(docs if unknown else pending(docs, state.seen(number), version), rules, **options).persist()
    try:
        sink(done, number)
        state.record(done.select("doc_id", content_hash(F.coalesce("text", F.lit(""))).alias("hash"), F.lit(version).alias("version")), number)
    finally:
        done.unpersist()
    return number
