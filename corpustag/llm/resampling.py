"""Target-distribution importance resampling with a head-tail vocabulary.

Features are words and pairs of neighbouring words, hashed by CRC-32 into buckets. A document's weight is the mean, over its
features, of the logarithm of how much more frequent their buckets are among the target texts; documents are drawn
by weight plus Gumbel noise.

Few words and pairs make up most of a corpus. The head, found by counting all documents, is broadcast: for frequent words the
state of the CRC after their bytes, so that a pair's CRC goes on from its first word's, and for frequent pairs their
bucket. Features of the tail take a direct CRC of their bytes. Both give the same bucket, so the head decides nothing but
speed, and both feed the exact totals of buckets.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpustag.llm import words as hashing
from corpustag.llm.ordering import numbered
from corpustag.llm.storage import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
#: The head: at most so many words and pairs, none longer than so many bytes. At most 2 * 8192 * 130 bytes and as many small objects.
HEAD = 8192
HEAD_BYTES = 64
#: Of each slice of text a task counts so many of its most frequent words and pairs, and it passes on as many of its own. Its counters
#: lose what they have seen least when they hold more than ``COUNTED``.
PASSED_ON = 4096
COUNTED = 1 << 17
#: Bytes of text taken apart at once.
PIECE = 1 << 18
#: Documents of one Arrow batch handed on.
ROWS = 256

#: Digits, small letters, and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def pieces(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lower case, a piece of about ``piece`` bytes at a time; pieces end where words do."""
    first = 0
    while first < len(text):
        last = min(first + piece, len(text))
        words = WORD.findall(text[first:last].lower())
        end = last
        if words and last < len(text) and WORD.match(text[last - 1:last].lower()) and WORD.match(text[last:last + 1].lower()):
            end = last - len(words.pop())
            if end == first:  # one word longer than the piece
                piece *= 2
                continue
        if words:
            yield words
        first = end


class States(dict):
    """CRC-32 of a word: looked up for words of the head, else worked out."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Features:
    """Buckets of a text's features."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int = BUCKETS):
        self.buckets = buckets
        self.states = States((w, zlib.crc32(w)) for w in words)
        self.pairs = {(one, two): zlib.crc32(b" " + two, self.states[one]) % buckets for one, two in pairs}

    def of(self, text: bytes) -> tuple[int, np.ndarray]:
        """(number of words, buckets of all features) of a text."""
        n, out, before = 0, [np.zeros(0, "<u2")], None
        for words in pieces(text):
            n += len(words)
            ahead = words if before is None else [before, *words]
            states = list(map(self.states.__getitem__, ahead))
            following = ahead[1:]
            frequent = map(self.pairs.get, zip(ahead, following))
            pairs = [zlib.crc32(b" " + w, s) if b is None else b for b, s, w in zip(frequent, states, following)]
            out.append((np.array(states[len(ahead) - len(words):] + pairs, np.uint32) % self.buckets).astype("<u2"))
            before = words[-1]
        return n, np.concatenate(out)


def _texts(docs: DataFrame, text_column: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))


def _spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the words in a slice of lower-case texts."""
    ink = (data >= 0x80) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def _frequent(hashes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(a place, how often) of the most frequent hashes."""
    if len(hashes):
        _, places, n = np.unique(hashes, return_index=True, return_counts=True)
        top = np.argsort(n, kind="stable")[::-1][:PASSED_ON]
        yield from zip(places[top].tolist(), n[top].tolist())


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent words and pairs of a task's documents, as bounded counters see them."""
    counters, powers = (Counter(), Counter()), hashing.Powers()
    for batch in batches:
        for _, data, bounds in hashing.slices(batch.column(0)):
            starts, ends, rows = _spans(data, bounds)
            hashes = hashing.hashed(data, starts, ends, powers)
            word = lambda i: data[starts[i]:ends[i]].tobytes()
            for i, n in _frequent(hashes):
                if ends[i] - starts[i] <= HEAD_BYTES:
                    counters[0][word(i)] += n
            pairs = np.flatnonzero(rows[1:] == rows[:-1])
            for i, n in _frequent(hashing.mix(hashes[pairs] * hashing.FACTOR + hashes[pairs + 1])):
                i = pairs[i]
                if max(ends[i] - starts[i], ends[i + 1] - starts[i + 1]) <= HEAD_BYTES:
                    counters[1][word(i), word(i + 1)] += n
            for counter in counters:
                if len(counter) > COUNTED:
                    for feature, _ in counter.most_common()[COUNTED // 2:]:
                        del counter[feature]
    rows = [(w, b"", n) for w, n in counters[0].most_common(PASSED_ON)] + [(*p, n) for p, n in counters[1].most_common(PASSED_ON)]
    if rows:
        one, two, n = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(two, pa.binary()), pa.array(n, pa.int64())], ["one", "two", "n"])


def head(docs: DataFrame, text_column: str, size: int, scratch: Scratch) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """At most ``size`` frequent words and pairs of all documents, each of at most ``HEAD_BYTES`` bytes a word."""
    seen = scratch.keep(_texts(docs, text_column).mapInArrow(_counting, "one binary, two binary, n bigint").groupBy("one", "two").agg(
        F.sum("n").alias("n")), "seen")
    order = [F.desc("n"), "one", "two"]
    words = seen.filter(F.length("two") == 0).orderBy(*order).limit(size).collect()
    pairs = seen.filter(F.length("two") > 0).orderBy(*order).limit(size).collect()
    return [bytes(r["one"]) for r in words], [(bytes(r["one"]), bytes(r["two"])) for r in pairs]


def _bucketing(shared) -> Callable:
    """(doc_id, n_words, n_features, buckets) of every text; buckets are little-endian unsigned 16-bit numbers."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                ids, texts = batch.column(0).slice(start, ROWS), batch.column(1).slice(start, ROWS)
                found = [features.of(t.as_py()) for t in texts]
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()),
                    pa.array([b.tobytes() for _, b in found], pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])
    return work


def bucketed(docs: DataFrame, words: list[bytes], pairs: list[tuple[bytes, bytes]], id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of every row; the head goes to the tasks as one broadcast variable of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast((words, pairs))
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_bucketing(shared), "doc_id bigint, n_words bigint, n_features bigint, buckets binary")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each bucket occurs among a task's features."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            total += np.bincount(np.frombuffer(batch.column(0)[i].as_py(), "<u2"), minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])


def totals(rows: DataFrame) -> list[int]:
    """The number of features in each bucket, over all rows: ``BUCKETS`` values come to the driver."""
    out = [0] * BUCKETS
    for r in rows.select("buckets").mapInArrow(_counts, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """What a feature of each bucket adds: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), in doubles."""
    b, s_all, t_all = float(len(source)), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source, target)]


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 times a Gumbel variate) that seed and id decide; a null id counts as the word null."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scoring(gain: np.ndarray, seed: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_words, n_features = batch.column(0), batch.column(1), batch.column(2)
            weights = []
            for i in range(batch.num_rows):
                own = gain[np.frombuffer(batch.column(3)[i].as_py(), "<u2")]
                weights.append(int(own.sum()) // len(own) if len(own) else 0)
            scores = [w + noise(d, seed) for w, d in zip(weights, ids.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [ids, n_words, n_features, pa.array(weights, pa.int64()), pa.array(scores, pa.int64())],
                ["doc_id", "n_words", "n_features", "weight", "score"])
    return work


def resampled(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text",
              percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = 7, head_size: int = HEAD) -> DataFrame:
    """Every document's ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` among the drawn (null if not drawn).

    Of the documents with at least ``min_words`` words, ``percent`` out of 100 are drawn, by highest score, ties by smaller id. Texts
    are taken apart once and kept as numbers of buckets, two bytes a feature; totals and scores are read from those. Only
    the head, of bounded size, and the totals of buckets come to the driver; ranks are numbered by a range sort.

    A null or empty text has no features and a weight of 0. A null id draws its own noise and comes last among equal scores. Rows
    that share an id each count and are drawn for themselves, equal ones in any order. Without target texts all targets are 0; an
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    words, pairs = head(docs, text_column, head_size, scratch)
    rows = scratch.keep(bucketed(docs, words, pairs, id_column, text_column), "buckets")
    goal = bucketed(target.select(F.lit(0).alias("_id"), F.col(target_column).alias("_text")), words, pairs, "_id", "_text")
    gain = np.array(gains(totals(rows), totals(goal)), np.int64)
    scored = scratch.keep(
        rows.mapInArrow(_scoring(gain, seed), "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"), "scores")
    scratch.drop("buckets")
    long = scored.filter(F.col("n_words") >= min_words)
    drawn = long.count() * percent // 100
    placed = numbered(long.withColumn("_from_top", -F.col("score")), ["_from_top", "doc_id", "n_features", "weight", "n_words"], scratch, "order")
    rank = F.when(F.col("row_no") < drawn, F.col("row_no") + 1).cast("bigint")
    columns = [F.col("doc_id").alias(id_column), "n_words", "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).unionByName(
        scored.filter(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("bigint").alias("rank")))
