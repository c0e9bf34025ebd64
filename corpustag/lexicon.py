"""Small default lexicons, and frames built from them or from user tables.

The defaults are closed-class English words plus a few opinion words; they are
plain Python so that a job can fold them into expressions. Larger vocabularies
come in as tables (``term, pos, lemma`` or ``term, valence``) and are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from .operators.scale import local_frame

# Part of speech by lower-cased word.
POS_TERMS: dict[str, list[str]] = {
    "DET": ["the", "a", "an", "this", "that", "these", "those", "every", "each"],
    "ADP": ["of", "in", "on", "for", "with", "by", "at", "to", "from", "into", "about"],
    "AUX": ["is", "was", "be", "are", "were", "been", "am", "has", "have", "had",
            "will", "would", "can", "could", "should", "must"],
    "CCONJ": ["and", "or", "but", "nor"],
    "SCONJ": ["because", "although", "if", "while", "unless"],
    "PRON": ["it", "he", "she", "they", "we", "you", "i", "who", "them", "us"],
    "PART": ["not"],
    "NOUN": ["clown", "idiot"],
    "ADJ": ["worthless"],
}

# Lemmas no suffix rule finds.
IRREGULAR_LEMMAS: dict[str, str] = {
    "is": "be", "was": "be", "are": "be", "were": "be", "been": "be", "am": "be",
    "has": "have", "had": "have", "ran": "run", "went": "go", "made": "make",
}

# Word valence, -5 to 5.
VALENCES: dict[str, int] = {
    "clown": -2, "worthless": -3, "idiot": -3, "released": 1, "license": 1,
    "good": 3, "great": 3, "excellent": 4, "happy": 3, "love": 3,
    "bad": -3, "terrible": -4, "awful": -3, "sad": -2, "hate": -3,
}

# Words that are entities by themselves.
DATE_WORDS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday",
              "sunday", "today", "tomorrow", "yesterday"]
ORDINAL_WORDS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh",
                 "eighth", "ninth", "tenth"]


def pos_by_term() -> dict[str, str]:
    return {term: pos for pos, terms in POS_TERMS.items() for term in terms}


def sentiment_lexicon(spark: SparkSession) -> DataFrame:
    """The default ``(term, valence)`` table."""
    return local_frame(
        spark, [Row(term=t, valence=v) for t, v in sorted(VALENCES.items())],
        T.StructType([T.StructField("term", T.StringType()), T.StructField("valence", T.IntegerType())]))
