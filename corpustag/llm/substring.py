"""Substring deduplication: paragraphs by MinHash banding.

A paragraph ends at a blank line; a line of ``LINE`` words or more is one by itself, as text wrapped to a width has shorter
lines. One of more than ``PIECE`` words is cut into pieces besides: at words whose hash (with the next word's) is least among
the ``RADIUS`` on either side, so that what is copied into another paragraph is cut alike there, but for its ends. Paragraphs
and pieces that share a band are compared by the exact Jaccard similarity of their five-word shingles; components of linked
ones that lie in two documents or more are repeats.

That promises nothing of a passage that lies across paragraphs. So, as a complement, runs of ``RUN`` words are taken whole
where their hash is the least of ``REACH`` neighbouring ones, and at both ends of texts; equal runs are repeats. An
exact repeat of ``RUN + REACH - 1`` words (30) or more is found, but for less than ``REACH`` words at each end. Repeats of a row that
touch or overlap make one span.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpustag.llm import graph, words
from corpustag.llm.storage import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
PERCENT = 80
#: A line of so many words is a paragraph.
LINE = 20
#: Longer paragraphs are cut into pieces too, of 25 words at least and 49 on average; those of more than ``WHOLE`` words only so.
PIECE, WHOLE, RADIUS = 200, 1000, 24
#: Bands of rows: at similarity s a pair meets with chance 1 - (1 - s^ROWS)^BANDS: 98.3 % at 0.8, 99.9 % at 0.9, always at 1.
BANDS, ROWS = 4, 2
#: Words of a run taken whole; of so many neighbouring runs the one with the least hash is.
RUN, REACH = 20, 11
#: Shorter spans are not reported.
MIN_SPAN = 15
#: Contents of paragraphs that a task remembers, so as to pass on the bands of copies once.
REMEMBERED = 1 << 18
#: A content with more than this part of all rows is joined by broadcast; there are at most so many of them.
HOT = 10_000


def paragraphs(data: np.ndarray, bounds: np.ndarray, powers: words.Powers) -> tuple:
    """Of a slice of texts: words' hashes and rows; and (first words, ends) of paragraphs and of the pieces of long ones."""
    starts, ends, row = words.spans(data, bounds)
    n = len(starts)
    if not n:
        return np.empty(0, np.uint64), row, [(starts, ends), (starts, ends)]
    word = words.hashed(data, starts, ends, powers)
    feeds = np.r_[0, np.cumsum(data == 10)]
    line = row + feeds[starts]  # grows with each row and each line
    new_line = np.r_[True, line[1:] != line[:-1]]
    line_first = np.flatnonzero(new_line)
    long_line = np.diff(np.r_[line_first, n]) >= LINE
    breaks = np.r_[True, (row[1:] != row[:-1]) | (feeds[starts[1:]] - feeds[ends[:-1]] > 1)]
    breaks[line_first] |= long_line | np.r_[False, long_line[:-1]]
    first = np.flatnonzero(breaks)
    end = np.r_[first[1:], n]

    of = np.cumsum(breaks) - 1
    size = end - first
    # of equal ones the first is cut, and none near the paragraph's ends, so that pieces have RADIUS // 2 words at least
    at = np.flatnonzero(size[of] > PIECE)
    part, place = of[at], at - first[of[at]]
    inside = place + 1 < size[part]
    value = np.where(inside, words.mix(word[at] * words.FACTOR + word[np.minimum(at + 1, n - 1)]), word[at])
    least = (place >= RADIUS // 2) & (size[part] - place > RADIUS // 2)
    for k in range(1, min(RADIUS + 1, len(at))):
        apart = part[k:] != part[:-k]
        least[:-k] &= apart | (value[:-k] <= value[k:])
        least[k:] &= apart | (value[k:] < value[:-k])
    cut = np.zeros(n, bool)
    cut[at[least]] = True
    piece = np.flatnonzero(breaks | cut)
    piece_end = np.r_[piece[1:], n]
    # a long paragraph that is not cut is no piece besides
    of_long = (size[of[piece]] > PIECE) & ((piece_end - piece < size[of[piece]]) | (size[of[piece]] > WHOLE))
    whole = (size >= SHINGLE) & (size <= WHOLE)
    return word, row, [(first[whole], end[whole]), (piece[of_long], piece_end[of_long])]


def _shingles(word: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of runs of ``size`` words, without regard to where texts end."""
    n = max(len(word) - size + 1, 0)
    total, done = word, 1  # hashes of runs of ``done`` words: doubled, and a word longer, as the bits of ``size`` say
    for bit in bin(size)[3:]:
        power = np.uint64(pow(int(words.FACTOR), done, 1 << 64))
        total, done = total[:-done] * power + total[done:], 2 * done
        if bit == "1":
            total, done = total[:-1] * words.FACTOR + word[done:][:max(0, len(total) - 1)], done + 1
    total = total[:n]
    return words.mix(total)


def _edges(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the shingles of each paragraph, alternating with those of the runs between paragraphs."""
    edges = np.stack([first, end - SHINGLE + 1], axis=1).ravel()
    return edges[:-1] if edges[-1] >= n else edges


def _contents(shingle: np.ndarray, first: np.ndarray, end: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each paragraph: sums over its shingles, each mixed with its place."""
    place = np.arange(len(shingle), dtype=np.uint64) - _first_of(first, end, len(shingle))
    size = (end - first).astype(np.uint64)
    sums = [np.add.reduceat(mixed, edges)[::2] for mixed in (words.mix(shingle ^ place), words.mix(shingle * words.FACTOR + place))]
    return words.mix(sums[0] + size), words.mix(sums[1] + size)


def _sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` of each run of ``size`` values."""
    out, done = values, 1
    while 2 * done <= size:
        out, done = pick(out[:-done], out[done:]), 2 * done
    return pick(out[:len(out) - size + done], out[size - done:]) if done < size else out


def anchors(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the runs of ``RUN`` words that are taken whole, and two hashes of each run."""
    n = len(word) - RUN + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    value = _shingles(word, RUN)
    taken = np.zeros(n, bool)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    end = np.r_[first[1:], len(row)]
    long_enough = end - first >= RUN
    taken[first[long_enough]] = True
    taken[end[long_enough] - RUN] = True
    if n >= REACH:
        least = _sliding(value, REACH, np.minimum)
        least[row[:len(least)] != row[RUN + REACH - 2:]] = 0
        none = np.zeros(REACH - 1, np.uint64)
        taken |= (value == _sliding(np.r_[none, least, none], REACH, np.maximum)) & (row[:n] == row[RUN - 1:])
    at = np.flatnonzero(taken)
    check = np.zeros(len(at), np.uint64)
    for k in range(RUN):
        check = words.mix(check + word[at + k])
    return at, words.mix(value[at] + np.uint64(RUN)), check


def _multipliers() -> np.ndarray:
    return np.random.default_rng(17).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


PLACES = ["doc", "row", "start", "words", "content", "check"]
TYPES = "doc bigint, row bigint, start bigint, words int, content bigint, check int"


def _places(batch: pa.RecordBatch, at: int, row: np.ndarray, first: np.ndarray, size: np.ndarray, content: np.ndarray, check: np.ndarray) -> list[pa.Array]:
    of = pa.array(at + row[first])
    return [batch.column(0).take(of), batch.column(2).take(of), pa.array((first - np.searchsorted(row, row[first])).astype(np.int64)),
            pa.array(size.astype(np.int32)), pa.array(content.view(np.int64)), pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32))]


def _found(texts: DataFrame) -> DataFrame:
    """``PLACES``, ``who`` and ``bands`` of each paragraph or piece of ``SHINGLE`` words or more; bands are null once passed on.
    So too of each run taken whole, which has neither key nor bands."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, factors = words.Powers(), _multipliers()
        passed: set[int] = set()
        for batch in batches:
            for at, data, bounds in words.slices(batch.column(1)):
                word, row, levels = paragraphs(data, bounds, powers)
                run, content, check = anchors(word, row)
                if len(run):
                    yield pa.RecordBatch.from_arrays(
                        [*_places(batch, at, row, run, np.full(len(run), RUN), content, check), pa.nulls(len(run), pa.int64()),
                         pa.nulls(len(run), pa.list_(pa.int64()))], [*PLACES, "who", "bands"])
                shingle = _shingles(word)
                for first, end in levels:
                    if not len(first):
                        continue
                    edges = _edges(first, end, len(shingle))
                    content, check = _contents(shingle, first, end, edges)
                    least = [np.minimum.reduceat(shingle * f, edges)[::2] for f in factors]
                    bands = []
                    for b in range(BANDS):
                        key = np.full(len(first), b, np.uint64)
                        for m in least[b * ROWS: (b + 1) * ROWS]:
                            key = words.mix(key * words.FACTOR + m)
                        bands.append(key)
                    if len(passed) > REMEMBERED:
                        passed.clear()
                    new = np.zeros(len(content), bool)
                    for i, c in enumerate(content.tolist()):
                        if c not in passed:
                            passed.add(c)
                            new[i] = True
                    offsets = pa.array(np.r_[0, np.cumsum(new * BANDS)].astype(np.int32), mask=np.r_[~new, False])
                    yield pa.RecordBatch.from_arrays(
                        [*_places(batch, at, row, first, end - first, content, check), batch.column(3).take(pa.array(at + row[first])),
                         pa.ListArray.from_arrays(offsets, pa.array(np.stack(bands, axis=1)[new].ravel().view(np.int64)))],
                        [*PLACES, "who", "bands"])
    return texts.mapInArrow(work, f"{TYPES}, who bigint, bands array<bigint>")


def _first_of(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """For each place, the first word of the paragraph it lies in (or of the one before)."""
    out = np.zeros(n, np.int64)
    inside = first[first < n]
    out[inside] = np.diff(np.r_[0, inside])
    return np.cumsum(out).astype(np.uint64)


def _sets(holders: DataFrame) -> DataFrame:
    """(content, check, tokens) of the paragraphs of ``holders`` (text, wanted) whose content is wanted of that text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for batch in batches:
            lists = batch.column(1)
            for at, data, bounds in words.slices(batch.column(0)):
                word, row, levels = paragraphs(data, bounds, powers)
                shingle = _shingles(word)
                wanted = lists.slice(at, len(bounds) - 1).flatten().to_numpy().view(np.uint64)
                for first, end in levels:
                    if not len(first):
                        continue
                    content, check = _contents(shingle, first, end, _edges(first, end, len(shingle)))
                    _, once = np.unique(content, return_index=True)
                    once = once[np.isin(content[once], wanted)]
                    if not len(once):
                        continue
                    sets = [np.unique(shingle[first[i]: end[i] - SHINGLE + 1]) for i in once]
                    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(content[once].view(np.int64)), pa.array((check[once] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))],
                        ["content", "check", "tokens"])
    return holders.select("text", "wanted").mapInArrow(work, "content bigint, check int, tokens array<bigint>")


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT,
            min_span: int = MIN_SPAN) -> DataFrame:
    """One row per repeated span: the id, ``start`` and ``n_words`` (in words of the text), ``n_removed`` words that
    an earlier document holds too, ``first_doc`` (the least id that shares part of it), ``row`` (a number of the row).

    The first occurrence of a paragraph, by id, row and place, is kept; the others are removals. Words are runs without
    ASCII white space, A-Z in lower case. A null or empty text has no paragraphs. Spans are those of one row's text each. Rows with the
    same id count as one document when it is asked whether a paragraph stands in another, so do those with a null id, which comes
    last; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings", "zstd")
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_column).cast("bigint").alias("doc"), text.alias("text"))
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    found = scratch.keep(_found(numbered.withColumn("who", F.xxhash64("doc", "text"))), "paragraphs")
    banded = found.filter(F.col("bands").isNotNull()).select(F.explode("bands").alias("key"), F.col("content").alias("node"))
    shared = banded.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    index = scratch.keep(banded.join(shared, "key", "left_semi").groupBy("key", "node").agg((-F.count(F.lit(1))).alias("rank")), "index")

    # for each content to be compared one text that holds it, with all that is wanted of it; rows with the same id and text are one
    contents = index.select(F.col("node").alias("content")).distinct()
    wanted = (found.filter(F.col("bands").isNotNull()).join(contents, "content", "left_semi")
              .groupBy("content").agg(F.min("who").alias("who")).groupBy("who").agg(F.collect_list("content").alias("wanted")))
    distinct = texts.withColumn("who", F.xxhash64("doc", "text")).groupBy("who").agg(F.first("text").alias("text"))
    sets = scratch.keep(_sets(distinct.join(wanted, "who")), "sets")

    linked = graph.linked_components(index, sets.select(F.col("content").alias("node"), "tokens"), percent, scratch)
    # a link holds for the paragraph whose set was compared, not for another with the same first hash
    linked = scratch.keep(linked.join(sets.select(F.col("content").alias("node"), "check"), "node"), "linked")
    for name in ("index", "sets", "components"):
        scratch.drop(name)

    found = found.select(*PLACES)
    # groups of paragraphs: a component, or one content; those of one document are no repeats
    none = F.col("doc").isNull()
    per_content = found.groupBy("content", "check").agg(
        F.min(F.struct(none.alias("none"), "doc", "row", "start")).alias("first"), F.max("doc").alias("hi"),
        F.max(none).alias("any_null"), F.count(F.lit(1)).alias("n"))
    spread_out = "first.doc < hi OR (any_null AND NOT first.none)"  # a null id is an id of its own
    grouped = per_content.alias("p").join(
        linked.alias("l"), (F.col("p.content") == F.col("node")) & (F.col("p.check") == F.col("l.check")), "left")
    per_group = scratch.keep(grouped.select(
        "content", F.col("p.check").alias("check"), F.coalesce("component", "content").alias("group"),
        F.when(F.col("component").isNull(), F.col("p.check")).alias("alone"), "first", "hi", "any_null", "n").filter(
        f"alone IS NULL OR {spread_out}"), "contents")
    alone = per_group.filter("alone IS NOT NULL").select("content", "check", "first", "n")
    spread = per_group.filter("alone IS NULL").groupBy("group").agg(F.min("first").alias("first"), F.max("hi").alias("hi"),
        F.max("any_null").alias("any_null")).filter(spread_out).select("group", "first")
    together = per_group.filter("alone IS NULL").select("content", "check", "group", "n").join(spread, "group").select("content", "check", "first", "n")
    repeated = scratch.keep(alone.unionByName(together), "repeated")
    for name in ("linked", "contents"):
        scratch.drop(name)

    total = found.count()
    # at most HOT contents have more than their part of all rows: their rows stay where they are
    hot = F.broadcast(repeated.filter(F.col("n") > total / HOT).drop("n"))
    rest = repeated.filter(F.col("n") <= total / HOT).drop("n")
    same = ["content", "check"]
    places = found.join(hot, same).unionByName(found.join(hot, same, "left_anti").join(rest, same))

    by_doc = Window.partitionBy("row").orderBy("start", "end", "_gone")
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    kept = (F.col("first.row") == F.col("row")) & (F.col("first.start") == F.col("start"))
    end = F.col("start") + F.col("words")
    # ``_gone`` is the end of a removal; its words before the end of an earlier one are counted there
    spans = (
        places.withColumn("end", end).withColumn("_gone", F.when(~kept, end))
        .withColumn("_fresh", F.when(F.max("end").over(before) >= F.col("start"), 0).otherwise(1))
        .withColumn("_new", F.greatest(F.lit(0), F.col("_gone") - F.greatest("start", F.max("_gone").over(before))))
        .withColumn("_span", F.sum("_fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "_span").agg(
            F.first("doc").alias("doc"), F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("n_words"),
            F.sum(F.when(F.col("_gone").isNull(), 0).otherwise(F.col("_new"))).cast("bigint").alias("n_removed"),
            F.min("first.doc").alias("first_doc")))
    return spans.filter(F.col("n_words") >= min_span).select(F.col("doc").alias(id_column), "start", "n_words", "n_removed", "first_doc", "row")
