"""Registered queries of the numbered operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpustag.llm import fingerprints
    return fingerprints.edited_neighbours(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpustag.llm import ngram_join
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from corpustag.llm import packing
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(table(spark, sf_dir, "documents"), path).drop("ids")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; a source is the host."""
    from corpustag.llm import line_dedup
    docs = table(spark, sf_dir, "documents")
    return line_dedup.without_boilerplate(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpustag.llm import quality_rules
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpustag.llm import classifier
    docs = table(spark, sf_dir, "documents")
    scores = classifier.scored(docs, classifier.trained(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", (classifier.fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpustag.llm import archives
    return archives.round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpustag.llm import sharding
    return sharding.shards(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpustag.llm import substring
    return substring.repeats(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpustag.llm import mixing
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpustag.llm import va_file
    return va_file.clustered(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpustag.llm import resampling
    chosen = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return chosen.select("doc_id", "n_features", "weight", "score", "rank")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpustag.llm import url_templates
    return url_templates.judged(table(spark, sf_dir, "pages"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_ngram_join": op2_ngram_join,
        "op3_packing": op3_packing,
        "op4_line_dedup": op4_line_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_warc": op7_warc,
        "op8_sharding": op8_sharding,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_mixing": op10_mixing,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_url_filters": op13_url_filters,
    }
