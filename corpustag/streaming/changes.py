"""Change streams of notes: event filter, debounce, skip-unchanged, continuous re-tagging.

A stream has a row for every version of a note: ``path, version_ts, text`` and, for raw events, ``op``. It comes from
a folder of version files (``read_versions``), as Spark's file source tracks files by path and does not re-read one edited in
place, or from the notes' own folder, which ``sources.watch`` looks through for files edited since.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import content_hash
from ..operators.scale import with_neighbour
from ..plans.sync import reconcile
from ..sources.runs import RunTable, newest
from ..sources.sinks import modified_only

# Fixed value: the quiet time after which a change is acted on.
DEBOUNCE = "1 second"

VERSION_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("version_ts", T.TimestampType()),
    T.StructField("op", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("own", T.BooleanType()),
])


def read_versions(spark: SparkSession, directory: str, files_per_trigger: int = 1_000) -> DataFrame:
    """A stream over a directory of version files; the first batch is the full scan."""
    return spark.readStream.schema(VERSION_SCHEMA).option(
        "maxFilesPerTrigger", files_per_trigger).parquet(directory)


def note_events(versions: DataFrame, ticks: bool = False) -> DataFrame:
    """T4: creations and modifications of markdown files only; with ``ticks`` also rows of ``op`` tick, which tell the time."""
    kept = F.col("op").isin("create", "modify") & F.col("path").endswith(".md")
    return versions.where(kept | (F.col("op") == "tick")) if ticks else versions.where(kept)


def clock(spark: SparkSession, ticks_per_second: int = 1) -> DataFrame:
    """A stream of rows that say only what time it is, so that event time goes on where no note changes."""
    return spark.readStream.format("rate").option("rowsPerSecond", ticks_per_second).load().select(
        F.lit(None).cast("string").alias("path"), F.col("timestamp").alias("version_ts"), F.lit("tick").alias("op"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("own"))


def _microseconds(duration: str) -> int:
    return round(pd.Timedelta(duration).total_seconds() * 1_000_000)


_BURST_STATE = "newest bigint, us bigint, text string"


def debounced(versions: DataFrame, gap: str = DEBOUNCE, lateness: str = "10 minutes") -> DataFrame:
    """The last version of each burst; a burst ends after ``gap`` without events.

    Keyed state with a timer: a path holds its newest time and, while a burst is open, the burst's last version. A
    later event within the gap replaces it, one beyond the gap or the timer returns it. Timers run on event time, so a replay gives
    what the live run gave. Where notes fall silent, rows with a null path (``clock``, or ticks in the input) move the time on, and a
    burst comes out ``gap`` and ``lateness`` after its last event. Rows older than the watermark or than their path's newest are
    dropped. A path's versions of one micro-batch meet in one task.
    """
    width = _microseconds(gap)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, us, text = state.get if state.exists else (None, None, None)
        if state.hasTimedOut:
            state.update((newest, None, None))
            yield pd.DataFrame({"path": [key[0]], "us": [us], "text": [text]})
            return
        rows = pd.concat([b[["us", "text"]] for b in batches], ignore_index=True).sort_values("us", kind="stable")
        if key[0] is None:  # ticks
            return
        if newest is not None:
            rows = rows[rows["us"] >= newest]
        if not len(rows):
            # a state that is not renewed keeps its timer only if it is set again
            if us is not None:
                state.setTimeoutTimestamp(max((us + width) // 1000, state.getCurrentWatermarkMs() + 1))
            return
        if us is not None:
            rows = pd.concat([pd.DataFrame({"us": [us], "text": [text]}), rows], ignore_index=True)
        ended = (rows["us"].shift(-1) - rows["us"] >= width).to_numpy()
        last, last_text = int(rows["us"].iloc[-1]), rows["text"].iloc[-1]
        due = (last + width) // 1000
        if due <= state.getCurrentWatermarkMs():
            ended[-1] = True
            state.update((last, None, None))
        else:
            state.update((last, last, last_text))
            state.setTimeoutTimestamp(due)
        out = rows[ended]
        yield pd.DataFrame({"path": key[0], "us": out["us"].astype("int64"), "text": out["text"]})

    timed = versions.withWatermark("version_ts", lateness).select("path", "version_ts", "text", F.unix_micros("version_ts").alias("us"))
    bursts = timed.groupBy("path").applyInPandasWithState(
        step, "path string, us bigint, text string", _BURST_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return bursts.select("path", F.timestamp_micros("us").alias("version_ts"), "text")


def debounced_batch(
    versions: DataFrame, key: str, ts: str, order: str, gap_seconds: float, slice_of: Column,
) -> DataFrame:
    """T3 over a table: rows not followed within the gap by another of the same key."""
    ahead = with_neighbour(versions, key, [ts, order], slice_of, F.col(ts), "_next", following=True)
    gap = F.unix_micros("_next") - F.unix_micros(F.col(ts))
    return ahead.where(F.col("_next").isNull() | (gap >= int(gap_seconds * 1_000_000))).drop("_next")


def changed_batch(
    versions: DataFrame, key: str, order: list[str], content: Column, slice_of: Column,
) -> DataFrame:
    """T2 over a table: rows whose content differs from the key's previous row."""
    behind = with_neighbour(versions, key, order, slice_of, content, "_before")
    return behind.where(~content.eqNullSafe(F.col("_before"))).drop("_before")


#: Paths are dealt to so many states. A call of the worker per path would cost more than all its work.
BUCKETS = 8192

_CHANGE_STATE = "paths binary"


def changed_versions(versions: DataFrame) -> DataFrame:
    """T2, T6 on a stream of ``path, version_ts, text``: versions that differ from the last.

    A path is known by one hash and one time, and a state holds those of the paths dealt to it, 57 bytes each. A version older
    than the newest seen is dropped. Rows with a true ``own`` column are our rewrites coming round again: they
    renew the hash and are not acted on. A path's versions of one micro-batch meet in one
    task, which ``files_per_trigger`` keeps small.
    """
    own = F.coalesce("own", F.lit(False)) if "own" in versions.columns else F.lit(False)
    hashed = versions.select(
        F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).alias("bucket"), "path", F.unix_micros(F.col("version_ts").cast("timestamp")).alias("us"),
        "text", content_hash(F.col("text")).alias("hash"), own.alias("own"))
    record, no_time = "<16s?32sq", -(1 << 63)

    def digest(path: str | None) -> bytes:
        return bytes(16) if path is None else hashlib.md5(path.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # per path the last hash, and the newest time
        known = {p: (h if there else None, us) for p, there, h, us in struct.iter_unpack(record, state.get[0] if state.exists else b"")}
        parts = list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        if len(rows) > 1:
            rows = rows.sort_values("us", kind="stable")
        kept, renewed = [], False
        for path, us, text_hash, is_own in zip(rows["path"], rows["us"], rows["hash"], rows["own"]):
            place, at = digest(path), no_time if pd.isna(us) else int(us)
            last, newest = known.get(place, (None, no_time))
            if no_time < at < newest:
                kept.append(False)
                continue
            now = None if text_hash is None else bytes.fromhex(text_hash)
            # a null text differs from everything
            kept.append((now is None or now != last) and not is_own)
            known[place], renewed = (now, max(at, newest)), True
        if renewed:
            state.update((b"".join(struct.pack(record, p, h is not None, h or b"", us) for p, (h, us) in known.items()),))
        if any(kept):
            yield rows.loc[kept, ["path", "us", "text", "hash"]]

    changed = hashed.groupBy("bucket").applyInPandasWithState(
        step, "path string, us bigint, text string, hash string", _CHANGE_STATE, "append", GroupStateTimeout.NoTimeout)
    return changed.select("path", F.timestamp_micros("us").alias("version_ts"), "text", "hash")


class Ledger(RunTable):
    """What was acted on: (``path``, ``version_ts``, ``before``, ``after``), hashes of the text as found and as left; runs are batches."""

    def __init__(self, spark: SparkSession, folder: str, fold_every: int = 100):
        super().__init__(spark, folder, "path string, version_ts timestamp, before string, after string",
                         lambda rows: newest(rows, "path", "version_ts"), fold_every)

    def left(self, before: int) -> DataFrame:
        """(``path``, ``after``) of the newest version acted on in batches before ``before``."""
        return newest(self.rows(before), "path", "version_ts").select("path", "after")


def without_echoes(batch: DataFrame, ledger: Ledger, batch_id: int) -> DataFrame:
    """Changed versions less those that a path was left with when it was last acted on: our own rewrites coming round.

    Only the batch's paths are looked up, by hash; texts stay where they are.
    """
    paths = batch.select("path").distinct()
    left = ledger.left(batch_id).join(paths, "path", "left_semi").withColumnRenamed("after", "hash")
    return batch.join(left, ["path", "hash"], "left_anti")


def start_tagging(
    changes: DataFrame, rules: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
    once: bool = False, ledger: Ledger | None = None,
) -> StreamingQuery:
    """Re-tag every changed note as it arrives; ``sink(modified, batch_id)`` stores it.

    With a ``ledger``, rewrites that come back as changes are not acted on, and what is acted on is recorded. A
    micro-batch may be replayed after a failure, so the sink should be idempotent per ``batch_id``, as the ledger is. ``once``
    works off what is there and stops.
    """
    def work(batch: DataFrame, batch_id: int) -> None:
        # tagging starts several jobs; the stateful operator above runs once for all of them
        held, done = batch.persist(), None
        try:
            fresh = held if ledger is None else without_echoes(held, ledger, batch_id)
            docs = fresh.select(F.concat_ws(
                "@", "path", F.date_format("version_ts", "yyyyMMddHHmmssSSSSSS")).alias("doc_id"),
                "path", "version_ts", "hash", "text")
            # the ledger and the sink read the result of one pass over the texts
            done = reconcile(docs, rules).persist()
            if ledger is not None:
                # recorded first: a rewrite must never come round before the ledger knows it
                ledger.record(done.select("path", "version_ts", F.col("hash").alias("before"), F.when(
                    F.col("modified"), content_hash(F.col("text"))).otherwise(F.col("hash")).alias("after")), batch_id)
            sink(modified_only(done).drop("hash"), batch_id)
        finally:
            if done is not None:
                done.unpersist()
            held.unpersist()

    writer = changes.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
