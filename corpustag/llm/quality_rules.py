"""Quality rules: base counts, and the divergence of a document from its language (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpustag.llm.storage import Scratch

SPACE = r"[\x20\x09-\x0D]+"
INK = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Character classes, in the order in which they are taken out of a text; what is left is a class too.
CLASSES = ["[a-z]+", "[A-Z]+", "[0-9]+", SPACE, r"[^\x00-\x7F]+"]
COMMON_WORDS = 16
MIN_WORDS = 50
#: Jensen-Shannon distances (base 2) above which a document is unlike its language.
MAX_CLASS_DISTANCE = 0.25
#: For common words the limit is a share of the distance that a text without any of its language's common words has, plus what chance
#: adds in a text of n words: the squared distance of a fair sample is ``CHANCE`` / n on average. It stays below that distance, so that
#: such a text never passes.
MAX_WORD_SHARE, LAST_WORD_SHARE = 0.7, 0.98
CHANCE = COMMON_WORDS / (8 * math.log(2))
#: A window's position takes the low part of a 63-bit number, its hash the rest: (unit, mask of the hash).
SHORT, LONG = (1 << 20, (1 << 43) - 1), (1 << 31, (1 << 32) - 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def with_repeats(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds ``name``: words of the array ``words`` in three-word windows that occur twice or more in it.

    Windows are sorted as one number each, hash above position, and equal neighbours are compared word by
    word; the positions found, sorted again, are covered from left to right.
    """
    w = F.col(words)
    unit = F.when(F.size(w) > SHORT[0], F.lit(LONG[0])).otherwise(F.lit(SHORT[0])).cast("bigint")
    mask = F.when(F.size(w) > SHORT[0], F.lit(LONG[1])).otherwise(F.lit(SHORT[1])).cast("bigint")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(
        F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.col("_mask")) * F.col("_unit") + i)
    none = F.array().cast("array<bigint>")

    def alike(x: Column, y: Column) -> Column:
        at = lambda k, z: F.get(w, (z % F.col("_unit") + k).cast("int"))
        same = F.floor(x / F.col("_unit")) == F.floor(y / F.col("_unit"))
        return F.coalesce(same & (at(0, x) == at(0, y)) & (at(1, x) == at(1, y)) & (at(2, x) == at(2, y)), F.lit(False))

    keys = F.col("_keys")
    found = F.filter(keys, lambda x, i: (alike(x, F.get(keys, i - 1)) & (i > 0)) | alike(x, F.get(keys, i + 1)))
    covered = F.aggregate(
        F.sort_array(F.transform(found, lambda x: x % F.col("_unit"))),
        F.struct(F.lit(-3).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3).cast("bigint"), p - s["last"])).alias("n")),
        lambda s: s["n"])
    return (df.withColumn("_unit", unit).withColumn("_mask", mask)
            .withColumn("_keys", F.when(F.size(w) >= 4, F.sort_array(windows)).otherwise(none))
            .withColumn(name, covered).drop("_unit", "_mask", "_keys"))


def with_classes(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_classes``: code points of the text by character class."""
    left = [text]
    for i, pattern in enumerate(CLASSES):
        df = df.withColumn(f"_left{i}", F.regexp_replace(left[-1], pattern, ""))
        left.append(f"_left{i}")
    lengths = [F.length(c) for c in left] + [F.lit(0)]
    return df.withColumn("_classes", F.array(*[(a - b).cast("bigint") for a, b in zip(lengths, lengths[1:])])).drop(*left[1:])


def references(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per language of ``texts`` (``_lang``, ``_text``): shares by class, common words and their shares.

    Counts cover all documents. Words are counted map-side first, and each task passes on its first
    ``COMMON_WORDS`` of a language only.
    """
    classes = with_classes(texts, "_text").groupBy("_lang").agg(
        *[F.sum(F.col("_classes")[i]).alias(f"_c{i}") for i in range(len(CLASSES) + 1)])
    all_chars = sum((F.col(f"_c{i}") for i in range(1, len(CLASSES) + 1)), F.col("_c0"))
    classes = classes.select("_lang", F.array(*[
        F.when(all_chars > 0, F.col(f"_c{i}") / all_chars).otherwise(0.0) for i in range(len(CLASSES) + 1)]).alias("_ref_classes"))
    counts = texts.select("_lang", F.explode(words_of(F.col("_text"))).alias("_word")).groupBy("_lang", "_word").agg(
        F.count(F.lit(1)).alias("_n"))
    counts = scratch.keep(counts, "word_counts")
    totals = counts.groupBy(F.col("_lang").alias("_of")).agg(F.sum("_n").alias("_all"))
    first = Window.partitionBy("_lang").orderBy(F.desc("_n"), F.asc("_word"))
    top = counts.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= COMMON_WORDS)
    common = top.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("_rank", "_word", "_n"))).alias("_top"))
    common = common.join(totals, F.col("_lang").eqNullSafe(F.col("_of"))).select(
        F.col("_lang").alias("_with"), F.col("_top._word").alias("_ref_words"),
        F.transform("_top", lambda t: t["_n"] / F.col("_all")).alias("_ref_shares"))
    return classes.join(common, F.col("_lang").eqNullSafe(F.col("_with")), "left").select(
        F.col("_lang").alias("_ref_lang"), "_ref_classes", "_ref_words", "_ref_shares")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def judged(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
           max_class_distance: float = MAX_CLASS_DISTANCE, max_word_share: float = MAX_WORD_SHARE) -> DataFrame:
    """Base counts of every document and whether it is kept.

    A document fails the base rules with fewer than ``MIN_WORDS`` words or with over half of its words in repeated
    windows. It fails the divergence rules if its histogram of character classes is farther
    from the language's reference than the limit, or that of the language's common words farther than ``max_word_share`` of
    the distance of a text without any, with an allowance for short texts.

    A null text is empty: no words, base rules failed. A null language is a language of its own; documents
    sharing an id are judged each by itself; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    texts = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"),
                        F.col(lang_column).alias("_lang"))
    refs = scratch.keep(references(texts.select("_lang", "_text"), scratch), "references")
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda l: F.rlike(l, F.lit(INK)))
    df = (with_classes(texts, "_text").withColumn("_words", words_of(text)).withColumn("_lines", lines)
          .withColumn("n_words", F.size("_words").cast("bigint"))
          .withColumn("word_chars", F.length(F.translate(text, BLANKS, "")).cast("bigint"))
          .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"))
          .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")))
    df = with_repeats(df, "_words", "n_repeat_words")
    df = df.withColumn("_spaced", F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" "))).drop("_words", "_lines", "_text")
    df = df.join(refs, F.col("_lang").eqNullSafe(F.col("_ref_lang")), "left")
    chars = F.aggregate("_classes", F.lit(0).cast("bigint"), lambda s, x: s + x)
    shares = F.transform("_classes", lambda c: F.when(F.col("_chars") > 0, c / F.col("_chars")).otherwise(0.0))
    padded = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    found = F.transform("_ref_words", lambda w: (
        F.octet_length(F.col("_spaced")) - F.octet_length(F.replace(F.col("_spaced"), padded(w)))) / F.octet_length(padded(w)))
    with_rest = lambda a: F.concat(a, F.array(F.lit(1.0) - F.aggregate(a, F.lit(0.0), lambda s, x: s + x)))
    df = (df.withColumn("_chars", chars).withColumn("_class_distance", distance(shares, F.col("_ref_classes")))
          .withColumn("_found", F.transform(found, lambda n: F.when(F.col("n_words") > 0, n / F.col("n_words")).otherwise(0.0)))
          .withColumn("_word_distance", distance(with_rest(F.col("_found")), with_rest(F.col("_ref_shares"))))
          .withColumn("_none_distance", distance(
              F.concat(F.transform("_ref_shares", lambda _: F.lit(0.0)), F.array(F.lit(1.0))), with_rest(F.col("_ref_shares"))))
          .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    none = F.col("_none_distance")
    word_limit = F.least(LAST_WORD_SHARE * none, F.sqrt(F.pow(max_word_share * none, F.lit(2.0)) + F.lit(CHANCE) / F.col("n_words")))
    unlike = (F.coalesce(F.col("_class_distance"), F.lit(0.0)) > max_class_distance) | F.coalesce(
        F.col("_word_distance") > word_limit, F.lit(False))
    return df.select(
        F.col("_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & ~unlike).alias("kept"),
        F.col("_class_distance").alias("class_distance"), F.col("_word_distance").alias("word_distance"))
