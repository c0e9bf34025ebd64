"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Training takes a bounded sample of labelled rows (``SAMPLE``, by a hash of the id) to the driver; scoring covers all
rows. Pairwise interactions are scored in linear time: half of (square of sums - sum of squares) per factor.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpustag.llm import words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows to learn from, at most.
SAMPLE = 8_000
FOLDS = 5
THRESHOLD = 0.3
BUCKETS = 1 << 16
FACTORS = 4
EPOCHS = 5
#: Places of the features that are not words: a constant, statistics, metadata.
FIXED = 32
SYMBOLS = b"#*$%&|<>"


class Rows:
    """Sparse rows: features ``index`` with ``value``; row i has those from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, index: np.ndarray, value: np.ndarray, first: np.ndarray):
        self.index, self.value, self.first = index, value, first


def features(data: np.ndarray, bounds: np.ndarray, meta: np.ndarray, powers: words.Powers) -> Rows:
    """Features of each text: damped and normed counts of hashed words, statistics, metadata."""
    n = len(bounds) - 1
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    starts, ends, row = words.spans(lower, bounds)
    bucket = (words.hashed(lower, starts, ends, powers) % np.uint64(BUCKETS)).astype(np.int64)
    cell, count = np.unique(row * BUCKETS + bucket, return_counts=True)
    word_row, word_value = cell // BUCKETS, 1.0 + np.log(count)
    norm = np.sqrt(np.bincount(word_row, weights=word_value ** 2, minlength=n))
    word_value /= norm[word_row]

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(mask)][bounds]).astype(float)

    size = np.maximum(np.diff(bounds).astype(float), 1)
    n_words = np.bincount(row, minlength=n).astype(float)
    distinct = np.bincount(word_row, minlength=n).astype(float)
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    per_word = np.maximum(n_words, 1)
    statistics = np.stack([
        np.ones(n), np.log1p(n_words) / 10, np.log1p(np.diff(bounds)) / 12, total((data >= 97) & (data <= 122)) / size,
        total((data >= 65) & (data <= 90)) / size, total((data >= 48) & (data <= 57)) / size, total(data >= 128) / size,
        total(symbols[data]) / per_word, total(data == 10) / per_word, total((data == 46) | (data == 44)) / per_word,
        np.bincount(row, weights=ends - starts, minlength=n) / per_word / 10, distinct / per_word,
        n_words < 50, n_words < 10, *meta.T], axis=1).astype(float)
    fixed = statistics.shape[1]
    index = np.concatenate([np.tile(np.arange(fixed), n), word_row * 0 + FIXED + cell % BUCKETS])
    value = np.concatenate([statistics.ravel(), word_value])
    of = np.concatenate([np.repeat(np.arange(n), fixed), word_row])
    order = np.argsort(of, kind="stable")
    return Rows(index[order], value[order], np.r_[0, np.cumsum(np.bincount(of, minlength=n))])


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, seed: int = 3):
        self.bias = 0.0
        self.weight = np.zeros(FIXED + BUCKETS)
        self.factor = np.random.default_rng(seed).normal(0, 0.05, (FIXED + BUCKETS, FACTORS))

    @classmethod
    def of(cls, bias: float, weight: np.ndarray, factor: np.ndarray) -> "Machine":
        machine = cls.__new__(cls)
        machine.bias, machine.weight, machine.factor = bias, weight, factor
        return machine

    def forward(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        begin = rows.first[:-1]
        linear = np.add.reduceat(self.weight[rows.index] * rows.value, begin)
        scaled = self.factor[rows.index] * rows.value[:, None]
        sums = np.add.reduceat(scaled, begin, axis=0)
        squares = np.add.reduceat(scaled ** 2, begin, axis=0)
        return self.bias + linear + 0.5 * (sums ** 2 - squares).sum(axis=1), sums

    def score(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(rows)[0], -30, 30)))

    def fit(self, rows: Rows, label: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.1, decay: float = 1e-5) -> "Machine":
        seen_w, seen_f = np.full(len(self.weight), 1e-6), np.full(self.factor.shape, 1e-6)
        seen_b = 1e-6
        # both classes weigh the same, however rare one is
        share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
        heavy = np.where(label > 0.5, 0.5 / share, 0.5 / (1 - share))
        for _ in range(epochs):
            for a in range(0, len(label), batch):
                b = min(a + batch, len(label))
                lo, hi = rows.first[a], rows.first[b]
                part = Rows(rows.index[lo:hi], rows.value[lo:hi], rows.first[a: b + 1] - lo)
                raw, sums = self.forward(part)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[a:b]) * heavy[a:b] / (b - a)
                of = np.repeat(np.arange(b - a), np.diff(part.first))
                used, back = np.unique(part.index, return_inverse=True)
                pull = error[of] * part.value
                g = np.bincount(back, pull, len(used)) + decay * self.weight[used]
                deep = pull[:, None] * (sums[of] - self.factor[part.index] * part.value[:, None])
                gf = np.stack([np.bincount(back, deep[:, k], len(used)) for k in range(FACTORS)], axis=1) + decay * self.factor[used]
                gb = error.sum()
                seen_b += gb ** 2
                self.bias -= rate * gb / np.sqrt(seen_b)
                seen_w[used] += g ** 2
                self.weight[used] -= rate * g / np.sqrt(seen_w[used])
                seen_f[used] += gf ** 2
                self.factor[used] -= 0.5 * rate * gf / np.sqrt(seen_f[used])
        return self


def fold(id_column: str, folds: int = FOLDS) -> Column:
    """Fold of a row: checksum of its id as text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds


def _inputs(docs: DataFrame, id_column: str, text_column: str, meta: list[str], more: list[Column] = ()) -> DataFrame:
    known = [F.coalesce(F.ln(F.greatest(F.col(c).cast("double"), F.lit(0.0)) + 1) / 12, F.lit(0.0)) for c in meta]
    missing = [F.col(c).isNull().cast("double") for c in meta]
    return docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"),
                       F.array(*known, *missing).cast("array<double>").alias("meta"), *more)


def _pieces(batch: pa.RecordBatch, width: int, powers: words.Powers) -> Iterator[tuple[int, Rows]]:
    meta = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
    for first, data, bounds in words.slices(batch.column(1), lower=False):
        yield first, features(data, bounds, meta[first: first + len(bounds) - 1], powers)


def trained(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            label_column: str = "quality", meta: list[str] = ("n_chars",), sample: int = SAMPLE) -> Machine:
    """A machine fitted to at most ``sample`` labelled documents outside fold 0, chosen by a hash of their ids.

    An id labelled more than once takes its lowest label; null labels and ids teach nothing, labels without a document
    neither. Without labels of any kind every score is one half.
    """
    usable = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & (fold(id_column) != 0))
    chosen = (usable.groupBy(F.col(id_column).alias("_id")).agg(F.min(label_column).alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    found = docs.join(F.broadcast(chosen), F.col(id_column) == F.col("_id"))  # ``sample`` rows at most
    one = _inputs(found, id_column, text_column, list(meta), [F.col("_label").cast("double").alias("label")]).dropDuplicates(["id"])
    width = 2 * len(meta)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for batch in batches:
            for first, rows in _pieces(batch, width, powers):
                n = len(rows.first) - 1
                offsets = pa.array(rows.first.astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n).cast(pa.int64()), batch.column(3).slice(first, n),
                    pa.ListArray.from_arrays(offsets, pa.array(rows.index.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(rows.value.astype(np.float32)))], ["id", "label", "index", "value"])
    got = one.mapInArrow(work, "id bigint, label double, index array<int>, value array<float>").toArrow().sort_by("id")
    machine = Machine()
    if not len(got):
        machine.factor[:] = 0
        return machine
    order = np.random.default_rng(1).permutation(len(got))
    got = got.take(pa.array(order)).combine_chunks()
    index, value = got.column("index").combine_chunks(), got.column("value").combine_chunks()
    lengths = np.diff(index.offsets.to_numpy())
    rows = Rows(index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(float), np.r_[0, np.cumsum(lengths)])
    return machine.fit(rows, got.column("label").to_numpy())


def scored(docs: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text",
           meta: list[str] = ("n_chars",), threshold: float = THRESHOLD, carry: list[str] = ()) -> DataFrame:
    """(id, ``score``, ``predicted``) of every document, with the columns of ``carry``.

    A null text is empty and gets the score of its statistics; a null in metadata has a feature of its own. Repeated
    rows get equal scores, an empty table gives no rows, other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weight, machine.factor))  # of fixed size
    width = 2 * len(meta)
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, scorer = words.Powers(), Machine.of(*model.value)
        for batch in batches:
            for first, rows in _pieces(batch, width, powers):
                n = len(rows.first) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(scorer.score(rows)),
                     *[batch.column(3 + i).slice(first, n) for i in range(len(carry))]],
                    ["id", "score", *[f"carry{i}" for i in range(len(carry))]])
    more = [F.col(f"`{c}`").alias(f"carry{i}") for i, c in enumerate(carry)]
    kinds = "".join(f", carry{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    out = _inputs(docs, id_column, text_column, list(meta), more).mapInArrow(work, f"id {kind}, score double{kinds}")
    return out.select(F.col("id").alias(id_column), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                      *[F.col(f"carry{i}").alias(c) for i, c in enumerate(carry)])
