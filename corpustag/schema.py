"""Table contracts: the schemas every job reads or returns."""

from __future__ import annotations

from pyspark.sql import types as T

SENTIMENT_SCHEMA = T.StructType([
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("scope", T.StringType()),
])

REQUIRE_ENTITY_SCHEMA = T.StructType([
    T.StructField("types", T.ArrayType(T.StringType())),
    T.StructField("scope", T.StringType()),
])

FILTERS_SCHEMA = T.StructType([
    T.StructField("pos", T.ArrayType(T.StringType())),
    T.StructField("requireEntity", T.ArrayType(REQUIRE_ENTITY_SCHEMA)),
    T.StructField("sentiment", SENTIMENT_SCHEMA),
])

RULE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("match", T.StringType()),
    T.StructField("lemma", T.BooleanType()),
    T.StructField("stem", T.BooleanType()),
    T.StructField("filters", FILTERS_SCHEMA),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("groups", T.ArrayType(T.StringType())),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("description", T.StringType()),
    T.StructField("created", T.StringType()),
    T.StructField("modified", T.StringType()),
])

GROUP_SCHEMA = T.StructType([
    T.StructField("description", T.StringType()),
    T.StructField("additionalTags", T.ArrayType(T.StringType())),
    T.StructField("enabled", T.BooleanType()),
])

CONFIG_SCHEMA = T.StructType([
    T.StructField("rules", T.ArrayType(RULE_SCHEMA)),
    T.StructField("groups", T.MapType(T.StringType(), GROUP_SCHEMA)),
    T.StructField("settings", T.StructType([T.StructField("defaultScope", T.StringType())])),
])

# The labels and scopes a rule may name.
RULE_TYPES = ["pattern", "keyword", "literal", "entity"]
SCOPES = ["sentence", "paragraph", "document", "match"]
POS_LABELS = [
    "VERB", "NOUN", "ADJ", "ADV", "PROPN", "DET", "ADP", "PRON", "NUM", "AUX",
    "CCONJ", "SCONJ", "PART", "INTJ", "SYM", "X",
]
ENTITY_TYPES = [
    "DATE", "TIME", "CARDINAL", "ORDINAL", "MONEY", "PERCENT", "DURATION",
    "EMAIL", "URL", "HASHTAG", "MENTION", "EMOJI", "EMOTICON",
]

# Column names of the annotation tables.
TOKEN_COLUMNS = ["doc_id", "sent_no", "tok_no", "begin", "end", "surface", "pos", "lemma"]
MATCH_COLUMNS = ["doc_id", "rule_no", "rule_id", "text", "begin", "end", "pos_tags"]
