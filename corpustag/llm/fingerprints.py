"""Document fingerprints: SimHash, and all fingerprints within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpustag.llm import words
from corpustag.llm.ordering import slice_bounds, slice_of
from corpustag.llm.storage import Scratch, partitions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
RADIUS = 3
#: A fingerprint is cut into so many blocks; a table sorts by each choice of ``BLOCKS - RADIUS`` of them.
BLOCKS = 5
#: Weights are whole multiples of 1 / UNIT: their sums are exact, so that equal texts get equal votes wherever they stand.
UNIT = 1 << 20


def simhash(column: pa.Array, powers: words.Powers) -> np.ndarray:
    """64-bit fingerprints of a column of texts (0 for a text without words).

    Terms are words and pairs of neighbouring words, letters A-Z in lower case; a term found n times votes
    with weight 1 + ln n (in whole 2^-20) on each bit, for it where the bit of its hash is set and against it elsewhere.
    """
    signs = np.where((np.arange(256)[:, None] >> np.arange(8)) & 1, 1.0, -1.0)
    out = np.zeros(len(column), np.uint64)
    for first, data, bounds in words.slices(column):
        n = len(bounds) - 1
        starts, ends, row = words.spans(data, bounds)
        if not len(starts):
            continue
        word = words.hashed(data, starts, ends, powers)
        near = row[1:] == row[:-1]
        pair = words.mix(word[:-1][near] * words.FACTOR + word[1:][near])
        term, of = np.concatenate([word, pair]), np.concatenate([row, row[:-1][near]])
        _, at, count = np.unique(term + words.mix(of.astype(np.uint64)), return_index=True, return_counts=True)
        term, of, weight = term[at], of[at], np.round(UNIT * (1.0 + np.log(count)))
        octets = term.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            votes = np.bincount(of * 256 + octets[:, k], weights=weight, minlength=n * 256).reshape(n, 256) @ signs
            value = ((votes > 0) << np.arange(8)).sum(axis=1).astype(np.uint64)
            out[first: first + n] |= value << np.uint64(8 * k)
    return out


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bits = np.unpackbits((a ^ b).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
    return 1.0 - bits / BITS


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; a row is done when the next one of its slice is there."""
    powers = words.Powers()
    last = None  # slice, guest, id, text, fingerprint
    for batch in batches:
        place = batch.column(0).to_pylist()
        guest = batch.column(1).to_pylist()
        ids = batch.column(2).to_pylist()
        texts = batch.column(3).cast(pa.string()).to_pylist()
        prints = simhash(batch.column(3), powers)
        if last is not None:
            place, guest, ids, texts = [last[0], *place], [last[1], *guest], [last[2], *ids], [last[3], *texts]
            prints = np.concatenate([np.array([last[4]], np.uint64), prints])
        done = [i for i in range(len(place) - 1) if not guest[i] and place[i] == place[i + 1]]
        last = (place[-1], guest[-1], ids[-1], texts[-1], prints[-1]) if place else None
        at = 0
        while at < len(done):
            some, size = [], 0
            while at < len(done) and size < 4 * words.SLICE_BYTES:
                some.append(done[at])
                size += len(texts[done[at]])
                at += 1
            changed = []
            for i in some:
                half = len(texts[i]) // 2
                changed.append((texts[i][: len(texts[i]) - half] + texts[i + 1][:half]).encode())
            after = simhash(pa.array(changed, pa.binary()), powers)
            mine, theirs = prints[some], prints[[i + 1 for i in some]]
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in some], pa.int64()), pa.array([len(texts[i]) for i in some], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                pa.array(mine.view(np.int64)), pa.array(after.view(np.int64)),
                pa.array(_likeness(mine, after)), pa.array(_likeness(mine, theirs))],
                ["doc_id", "n_chars", "edited_sha256", "_print", "_edited_print", "near_edited", "near_next"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ``fingerprint``) of every document, a null text counting as empty; other columns are ignored."""
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(simhash(batch.column(1), powers).view(np.int64))], ["doc_id", "fingerprint"])
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).mapInArrow(
        prints, f"doc_id {kind}, fingerprint bigint").withColumnRenamed("doc_id", id_column)


def blocks(blocks_of: int = BLOCKS) -> list[int]:
    """Masks of the blocks of a fingerprint."""
    edges = [round(i * BITS / blocks_of) for i in range(blocks_of + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def within_radius(index: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks_of: int = BLOCKS) -> DataFrame:
    """(``query``, ``found``) for all fingerprints of ``index`` within ``radius`` bits of one of ``queries``.

    Both take distinct values in a column ``fingerprint``. Two fingerprints that differ in at most
    ``radius`` bits agree in ``blocks_of - radius`` blocks at least, and so meet in the table of some choice of
    blocks; a pair is let through in the first table where it meets, once its bits are counted.
    """
    tables = [sum(chosen) for chosen in combinations(blocks(blocks_of), blocks_of - radius)]
    masks = F.array(*[F.lit(_signed(m)).cast("bigint") for m in tables])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col("fingerprint").alias(name), F.posexplode(masks).alias("_table", "_mask"))
        return rows.withColumn("_key", F.col(name).bitwiseAND(F.col("_mask")))

    left = keyed(queries, "query").drop("_mask")
    right = keyed(index, "found").drop("_mask")
    differ = F.col("query").bitwiseXOR(F.col("found"))
    earlier = F.lit(False)
    for t, m in enumerate(tables):
        earlier = earlier | ((F.col("l._table") > t) & (differ.bitwiseAND(F.lit(_signed(m)).cast("bigint")) == 0))
    on = (F.col("l._table") == F.col("r._table")) & (F.col("l._key") == F.col("r._key")) & (
        F.bit_count(differ) <= radius) & ~earlier
    return left.alias("l").join(right.alias("r"), on).select("query", "found")


def edited_neighbours(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", every: int = 50) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how alike they and the next document's are.

    The next document is the one before in order of the id (after the last, the first again); the edited text has the
    last half of its code points replaced by the next text's first. ``n_within_radius`` counts, for documents
    whose id ``every`` divides, the documents whose fingerprint lies within ``RADIUS`` bits, itself included.

    Texts are shuffled once, by slices of the id's range cut at quantiles; the head of a slice also goes to the
    slice before as a guest. A null text is empty. Null ids come last, rows that share an id follow each
    other in order of a hash of the text. A lone document is its own next. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(lowest)).alias("_key"),
                       F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("_text"))
    n = partitions(spark)
    bounds = slice_bounds(rows.select("_key"), "_key", 4 * n)
    place = slice_of(F.col("_key"), bounds)
    # one row for each slice, of which there are four for each shuffle partition
    heads = sorted(tuple(r) for r in rows.groupBy(place.alias("s")).agg(F.max("_key")).collect())
    guests = spark.createDataFrame(
        [(heads[i - 1][1], s) for i, (s, _) in enumerate(heads)], "_head bigint, _guest_of int")
    placed = (
        rows.join(F.broadcast(guests), F.col("_key") == F.col("_head"), "left")
        .withColumn("_places", F.when(F.col("_guest_of").isNull(), F.array(F.struct(place.alias("s"), F.lit(0).alias("g")))).otherwise(
            F.array(F.struct(place.alias("s"), F.lit(0).alias("g")), F.struct(F.col("_guest_of").alias("s"), F.lit(1).alias("g")))))
        .select(F.explode("_places").alias("_at"), "_key", "_text")
        .select("_at.s", "_at.g", "_key", "_text"))
    order = [F.asc("s"), F.asc("g"), F.desc("_key"), F.asc("_hash")]
    done = (
        placed.withColumn("_hash", F.xxhash64("_text")).repartition(n, "s").sortWithinPartitions(*order).drop("_hash")
        .mapInArrow(_edited, "doc_id bigint, n_chars bigint, edited_sha256 string, _print bigint, _edited_print bigint, "
                             "near_edited double, near_next double"))
    done = scratch.keep(done, "edited")
    prints = scratch.keep(done.groupBy(F.col("_print").alias("fingerprint")).agg(F.count(F.lit(1)).alias("_docs")), "prints")
    queries = done.filter(F.col("doc_id") % every == 0).select(F.col("_print").alias("fingerprint")).distinct()
    near = (within_radius(prints.select("fingerprint"), queries).join(prints, F.col("found") == F.col("fingerprint"))
            .groupBy("query").agg(F.sum("_docs").alias("_near")))
    text_of = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return done.join(near, F.col("_print") == F.col("query"), "left").select(
        F.when(F.col("doc_id") != lowest, F.col("doc_id")).alias(id_column), "n_chars", "edited_sha256",
        text_of("_print").alias("fingerprint"), text_of("_edited_print").alias("edited_fingerprint"),
        "near_edited", "near_next", F.when(F.col("doc_id") % every == 0, F.col("_near")).alias("n_within_radius"))
