"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the hashes of its distinct shingles. Two sets with Jaccard >= t share at least
``need(n)`` = ceil(t n) tokens, n being either's size. Candidates are narrowed down in two steps.

First, in the order of the hashes, they share at least ``shared(n)`` tokens of their extended prefixes, the first
``n - need(n) + extra(n)`` tokens of each. Tokens that no other prefix holds are dropped; a document left with fewer
tokens than that is done. This looks at a fifth of all tokens.

Then whole sets of the documents left are compared by classes of sizes: sets of classes a and b share at least
``overlap(n, m)`` tokens, m being the least possible size of the partner. A set is done with class b unless so many of its
tokens are held by sets of class b. In ascending order of how many sets hold a token, those of the usual prefix count:

* rare tokens (held by at most ``RARE`` sets) are indexed singly;
* where frequent ones are among them, all tokens shared in the prefix may be frequent. A prefix longer by k tokens shares k
  more; its frequent tokens are dealt to k parts, so that two shared ones fall in one part: pairs of frequent tokens
  of a part are indexed.

Documents that share an index key are compared with the key's leader first; what is linked then is one
component. Afterwards only members of different components are compared that share enough differences from the leader, so
a large group of copies costs about its size, and still no link between components is missed. Every comparison is exact,
on whole sets.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpustag.llm import graph, words
from corpustag.llm.ordering import slice_of
from corpustag.llm.storage import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RARE = 16
#: One part for so many tokens of a set.
PART = 24
#: A prefix is extended by at least so many tokens, or a twentieth of the set.
EXTRA, EXTRA_SHARE = 10, 20


def need(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set it links with; also the least size of such a set."""
    return -(-n * percent // 100)


def extra(n: int, percent: int) -> int:
    return min(need(n, percent), max(EXTRA, -(-n // EXTRA_SHARE)))


def prefix_length(n: int, percent: int) -> int:
    return n - need(n, percent) + extra(n, percent)


def shared(n: int, percent: int) -> int:
    """Tokens that linked sets share in their extended prefixes, whatever the partner's size."""
    return extra(need(n, percent), percent)


def overlap(n: int, m: int, percent: int) -> int:
    """Least overlap of linked sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def _lowers() -> list[int]:
    """Least sizes of the classes of sizes, a twentieth apart."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 21 // 20))
    return out


LOWERS = _lowers()
#: More than there are classes of sizes.
CLASSES = 1024


def sets_of(column: pa.Array, size: int, powers: words.Powers) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, data, bounds in words.slices(column):
        starts, ends, row = words.spans(data, bounds)
        tokens, of = words.shingles(words.hashed(data, starts, ends, powers), row, size)
        cuts = np.searchsorted(of, np.arange(len(bounds)))
        for a, b in zip(cuts, cuts[1:]):
            yield np.unique(tokens[a:b])


def _set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.uint64).view(np.int64)))


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))


def _prefixes(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: id, size of the set, its key (null if empty), tokens shared with partners, extended prefix."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for batch in batches:
            ns, keys, wanted, heads = [], [], [], []
            for tokens in sets_of(batch.column(1), size, powers):
                n = len(tokens)
                ns.append(n)
                keys.append(_set_key(tokens) if n else None)
                wanted.append(shared(n, percent))
                # equal sets meet by their key; a different partner has another token in at least 100 / (100 - percent)
                possible = n > need(n, percent) or n + 1 <= 100 * n // percent
                heads.append(tokens[:prefix_length(n, percent)] if possible else tokens[:0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(wanted, pa.int64()), _lists(heads)],
                ["id", "n", "set_key", "wanted", "prefix"])
    return texts.mapInArrow(work, "id bigint, n bigint, set_key binary, wanted bigint, prefix array<bigint>")


def _whole_sets(texts: DataFrame, size: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for batch in batches:
            some: list[np.ndarray] = []
            for tokens in sets_of(batch.column(1), size, powers):
                some.append(tokens)
                if sum(map(len, some)) > words.SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(map(_set_key, some), pa.binary()), _lists(some)], ["set_key", "tokens"])
                    some = []
            yield pa.RecordBatch.from_arrays([pa.array(map(_set_key, some), pa.binary()), _lists(some)], ["set_key", "tokens"])
    return texts.select("id", "text").mapInArrow(work, "set_key binary, tokens array<bigint>")


def _index_keys(held: DataFrame, percent: int, rare: int) -> DataFrame:
    """(node, key, rank) from rows (cid, n, a, b, held: array of (df, token) in ascending order).

    ``rank`` is less for sets whose tokens more sets hold: those are near the middle of a group of copies.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, n, a, b, rows in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                df = np.asarray(rows.values.field(0).to_numpy())
                token = np.asarray(rows.values.field(1).to_numpy()).astype(np.int64).view(np.uint64)
                head = len(df) - overlap(n, max(LOWERS[b], need(n, percent)), percent) + 1
                both = np.uint64((min(a, b) << 16) + max(a, b))
                keys = [words.mix(token[:head][df[:head] <= rare] + both)]
                if (df[:head] > rare).any():
                    parts = 1 << max(1, LOWERS[min(a, b)] // PART).bit_length() - 1
                    longer = head + parts
                    often = np.sort(token[:longer][df[:longer] > rare])
                    of = words.mix(often) % np.uint64(parts)
                    order = np.argsort(of, kind="stable")
                    often, cuts = often[order], np.searchsorted(of[order], np.arange(parts + 1))
                    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        if hi - lo > 1:
                            i, j = np.triu_indices(hi - lo, 1)
                            keys.append(words.mix(words.mix(often[lo:hi][i] + both) * words.FACTOR + often[lo:hi][j]))
                found = np.unique(np.concatenate(keys)).view(np.int64)
                rank = -float(df.sum()) / n
                for at in range(0, len(found), 1 << 20):
                    part = found[at: at + (1 << 20)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), cid, np.int64)), pa.array(part), pa.array(np.full(len(part), rank))], ["node", "key", "rank"])
    return held.select("cid", "n", "a", "b", "held").mapInArrow(work, "node bigint, key bigint, rank double")


def _by_class(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, n, a, b, held) for each class b of sizes in which a set may have a partner, from (cid, n, tokens).

    ``held`` are (df, token), the tokens that other sets hold and how many do. Tokens are dealt out once: sizes and classes go in one
    number and holders are told apart by ids, so that all readings ask for the same columns and are one shuffle.
    """
    lowers = F.array(*[F.lit(x).cast("bigint") for x in LOWERS])
    # never null, or the planner asks for that in one reading and not in the other
    sized = sets.withColumn("na", F.coalesce(F.col("n") * CLASSES + slice_of(F.col("n") + 1, LOWERS) - 1, F.lit(0).cast("bigint")))
    dealt = sized.select("cid", "na", F.explode("tokens").alias("token")).repartition("token")
    size, of = F.shiftright("na", 10), F.col("na").bitwiseAND(CLASSES - 1).cast("int")
    holders = dealt.groupBy("token", of.alias("b")).agg(F.count(F.lit(1)).alias("of_class"), F.min("cid").alias("lo"), F.max("cid").alias("hi"))
    counts = holders.groupBy("token").agg(F.sum("of_class").alias("df"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")
    rows = dealt.join(counts.select("token", "df"), "token").join(holders.select("token", "b", (F.col("lo") < F.col("hi")).alias("several")), "token")
    rows = rows.select("cid", size.alias("n"), of.alias("a"), "b", "several", "df", "token")
    low, high = F.get(lowers, F.col("b")), F.get(lowers, F.col("b") + 1) - 1
    possible = (100 * high >= percent * F.col("n")) & (percent * low <= 100 * F.col("n")) & ((F.col("a") != F.col("b")) | F.col("several"))
    groups = rows.filter(possible).groupBy("cid", "n", "a", "b").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    least = F.greatest(low, F.ceil(F.col("n") * percent / 100))
    return groups.filter((100 + percent) * F.size("held") >= percent * (F.col("n") + least))


def _held(tokens: DataFrame) -> DataFrame:
    """Rows of ``tokens`` (cid, token) whose token other documents hold, too. They are dealt out once, for counting and looking up."""
    dealt = tokens.select("cid", "token").repartition("token")
    # by ids, not by their number, so that both readings ask for the same columns and are one shuffle
    several = dealt.groupBy("token").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo < hi").select("token")
    return dealt.join(several, "token")


def joined(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 4, percent: int = 85,
           rare: int = RARE) -> DataFrame:
    """One row per document: ``n_shingles``, ``component_id``, ``n_equal`` (documents with its set).

    Words are runs without ASCII white space, A-Z in lower case; a shorter text is one shingle. Documents link
    when ``100 * |x and y| >= percent * |x or y|``; a component's name is its smallest id.

    A null or empty text has no shingles and links with nothing; repeated rows and ids are documents of
    their own with equal sets; a null id gets its component's name, or null; ties don't arise, an empty
    table gives no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    texts = _texts(docs, id_column, text_column)
    whole = scratch.keep(_prefixes(texts, size, percent).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    rows = scratch.keep(whole.drop("prefix"), "rows")

    # documents with equal sets are one class, named by one of its rows
    classes = scratch.keep(rows.filter("n > 0").groupBy("set_key").agg(
        F.min("row").alias("cid"), F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_equal")), "classes")
    chosen = whole.join(classes.select(F.col("cid").alias("row")), "row", "left_semi").withColumnRenamed("row", "cid")
    near = _held(chosen.select("cid", F.explode("prefix").alias("token"))).groupBy("cid").agg(F.count(F.lit(1)).alias("m"))
    meta = rows.select(F.col("row").alias("cid"), "id", "n", "set_key", "wanted")
    alive = scratch.keep(near.join(meta, "cid").filter("m >= wanted").select("cid", "id", "n", "set_key"), "alive")
    scratch.drop("prefixes")  # rows without them stay to the end

    whose = alive.select(F.col("id").alias("wanted_id")).distinct()
    # the same join at every size, so that a small run tells what a large one costs
    again = texts.join(whose.hint("merge"), F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
    # a key has one cid; they lie together by key, so that no set is moved again to drop its copies
    sets = _whole_sets(again, size).join(alive.select("cid", "n", "set_key"), "set_key").dropDuplicates(["set_key"])
    sets = scratch.keep(sets.select("cid", "n", "tokens"), "sets")
    scratch.drop("alive")
    index = scratch.keep(_index_keys(_by_class(sets, percent), percent, rare), "index")

    grouped = graph.linked_components(index, sets.select(F.col("cid").alias("node"), "tokens"), percent, scratch)
    for name in ("index", "sets"):
        scratch.drop(name)

    placed = classes.join(grouped, F.col("cid") == F.col("node"), "left").withColumn("part", F.coalesce("component", "cid"))
    names = placed.groupBy("part").agg(F.min("first_id").alias("component_id"))
    of_key = placed.join(names, "part").select("set_key", "component_id", "n_equal")
    return rows.select("id", "n", "set_key").join(of_key, "set_key", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_equal", F.lit(1)).cast("bigint").alias("n_equal"))
