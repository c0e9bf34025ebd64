"""From raw documents to packed training sequences.

``STAGES`` run in order; each is written as Parquet and read again as the next one's documents. The classifier is
trained and the tokenizer is a program, so the whole has no SQL twin: tests hold it against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpustag.llm import classifier, line_dedup, mixing, ngram_join, packing
from corpustag.llm.storage import Scratch

ORACLE_SQL = None
TOKENIZER = "word_bpe_49k.json"
#: Words of a shingle and likeness of near duplicates in training data; the query op2_ngram_join has a contract of its own.
SHINGLE, PERCENT = 5, 80


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of ``docs``, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = classifier.trained(docs, labels)
    # under names of our own, as columns may be named like the verdict
    carried = {c: f"_carried{i}" for i, c in enumerate(docs.columns)}
    named = docs.select("*", *[F.col(f"`{c}`").alias(n) for c, n in carried.items()])
    scores = classifier.scored(named, machine, carry=list(carried.values()))
    return scores.filter("predicted = 1").select(*[F.col(n).alias(c) for c, n in carried.items()])


def _free(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _own(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def _with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a hash of the row, and its column's name. Nulls count by their place."""
    name, columns = _free(docs, "_row"), _own(docs.columns)
    return docs.withColumn(name, F.xxhash64(*columns, *[c.isNull() for c in columns])), name


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; all stay, and ``n_chars`` follows the text."""
    kind = docs.schema["n_chars"].dataType
    # the operator's counts take names that columns of the input may have
    aside = {c: _free(docs, f"_aside{i}") for i, c in enumerate(docs.columns) if c.lower() in ("n_lines", "n_dropped")}
    cleaned = line_dedup.without_boilerplate(docs.withColumnsRenamed(aside)).drop("n_lines", "n_dropped")
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).withColumnsRenamed(
        {n: c for c, n in aside.items()}).select(*_own(docs.columns))


def _one_of_equal_rows(hashed: DataFrame, row: str) -> DataFrame:
    """Rows of ``hashed`` without repetitions."""
    nth = _free(hashed, "_nth")
    same = Window.partitionBy("doc_id", row).orderBy(row)
    return hashed.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).drop(nth)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least id, of rows that share it the one with the least hash; rows
    without an id stay."""
    hashed, row = _with_row(docs)
    groups = ngram_join.joined(hashed, id_column=row, size=SHINGLE, percent=PERCENT).select(
        F.col(row).alias("_of"), F.col("component_id").alias("_group")).distinct()
    rows = hashed.select(F.col(row).alias("_of"), F.col("doc_id").alias("_id")).distinct().join(groups, "_of")
    first = rows.filter("_id IS NOT NULL").groupBy("_group").agg(F.min(F.struct("_id", "_of"))["_of"].alias("_of"))
    stay = first.select("_of").unionByName(rows.filter("_id IS NULL").select("_of")).distinct().withColumnRenamed("_of", row)
    return _one_of_equal_rows(hashed.join(stay, row, "left_semi"), row).select(*_own(docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    hashed, row = _with_row(docs)
    times, copy = _free(docs, "_copies"), _free(docs, "_copy")
    copies = mixing.mixed(hashed.select("doc_id", "text", "source", row), carry=[row]).groupBy("doc_id", row).agg(
        F.sum("copies").alias("_sum")).filter("_sum > 0").select(F.col("doc_id").alias("_id"), F.col(row).alias("_of"), F.col("_sum").alias(times))
    one = _one_of_equal_rows(hashed, row).alias("d")
    taken = one.join(copies.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c._id")) & (F.col(f"d.{row}") == F.col("c._of")))
    out = taken.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col(f"c.{times}"))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*_own(docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, along the space-filling curve."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", accepted),
    ("line_dedup", without_boilerplate),
    ("ngram_join", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
