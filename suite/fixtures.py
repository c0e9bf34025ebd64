"""Inputs shared by the registered queries: tables, derived notes, fixture rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpustag.operators.scale import settled
from corpustag.schema import RULE_SCHEMA
from corpustag.sources.notes import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *extra))


def notes(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Documents dressed as notes: front matter, a fenced block, tag lines, an open fence."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality"))
    lang_tags = F.concat(F.lit("#lang/"), "lang", F.lit(" #stale\n"))
    quality = F.concat(F.lit("#quality/"), F.col("quality").cast("string"), F.lit("\n"))
    text = F.concat(
        F.lit("---\nlang: "), "lang", F.lit("\n---\n"), "text",
        F.lit("\n\n```sh\nx #in-code\n```\n"),
        F.when(F.col("doc_id") % 3 == 0, lang_tags).otherwise(""),
        F.coalesce(quality, F.lit("")),
        F.when(F.col("doc_id") % 7 == 0, F.lit("```\n#unclosed")).otherwise(""),
    )
    return docs.join(labels, "doc_id", "left").select("doc_id", text.alias("text"), *extra)


def _rule(rule_id: str, kind: str, match: str, tags: list[str], **more) -> dict:
    filters = {k: more.pop(k) for k in ("pos", "requireEntity", "sentiment") if k in more}
    if "sentiment" in filters:
        filters["sentiment"] = {"min": None, "max": None, "scope": None} | filters["sentiment"]
    row = {f: None for f in RULE_SCHEMA.fieldNames()}
    row |= {"id": rule_id, "type": kind, "match": match, "tags": tags} | more
    if filters:
        row["filters"] = {"pos": None, "requireEntity": None, "sentiment": None} | filters
    return row


# The fixture rule set, in file order.
RULES: list[dict] = [
    _rule("r01", "keyword", "The", ["lang/en"]),
    _rule("r02", "keyword", "clown", ["toxic/insult"], lemma=True, groups=["safety"]),
    _rule("r03", "literal", "LICENSE", ["legal/license"]),
    _rule("r04", "literal", "example.com", ["ref/example"]),
    _rule("r05", "entity", "EMAIL", ["pii/email"]),
    _rule("r06", "entity", "CARDINAL", ["num"], groups=["off"]),
    _rule("r07", "pattern", "VERB NOUN", ["action"]),
    _rule("r08", "pattern", "DET ADJ NOUN", ["concept"]),
    _rule("r09", "keyword", "clown", ["toxic/noun"], pos=["NOUN", "PROPN"], groups=["safety"]),
    _rule("r10", "literal", "worthless", ["toxic/num"],
          requireEntity=[{"types": ["CARDINAL"], "scope": None}], groups=["safety"]),
    _rule("r11", "keyword", "the", ["mood/neg"], sentiment={"max": -0.1, "scope": "sentence"}),
    _rule("r12", "entity", "EMAIL", ["never"], pos=["NOUN"]),
    _rule("r13", "literal", "zzz-never", ["stale"]),
    _rule("r14", "keyword", "a", ["disabled"], enabled=False),
    _rule("r15", "literal", "lang: de", ["lang/de"]),
    _rule("r16", "keyword", "licens", ["legal/stem"], stem=True),
    _rule("r17", "keyword", "mit license", ["never"]),
]

# Sentiment rules in the other scopes, and scoped entity rules.
SCOPED_RULES: list[dict] = [
    _rule("s1", "keyword", "the", ["p"], sentiment={"max": -0.1, "scope": "paragraph"}),
    _rule("s2", "keyword", "the", ["d"], sentiment={"min": -0.7, "max": -0.3, "scope": "document"}),
    _rule("s3", "literal", "license", ["m"], sentiment={"min": 0.1, "scope": "match"}),
    _rule("s4", "pattern", "ADP DET", ["t"], sentiment={"max": -0.5}),
]
ENTITY_SCOPE_RULES: list[dict] = [
    _rule("e1", "keyword", "the", ["s"], requireEntity=[{"types": ["CARDINAL", "EMAIL"], "scope": None}]),
    _rule("e2", "literal", "on", ["p"], requireEntity=[{"types": ["CARDINAL"], "scope": "paragraph"}]),
    _rule("e3", "keyword", "of", ["d"], requireEntity=[{"types": ["EMAIL"], "scope": "document"},
                                                       {"types": ["PERCENT"], "scope": "sentence"}]),
]

NUMBERED_SCHEMA = T.StructType([T.StructField("rule_no", T.IntegerType()), *RULE_SCHEMA.fields])


def rules_frame(spark: SparkSession, rules: list[dict] = RULES) -> DataFrame:
    return settled(spark.createDataFrame([{"rule_no": i} | r for i, r in enumerate(rules)], NUMBERED_SCHEMA))


LEGACY_KEYWORDS: list[tuple] = [
    (0, "license", ["licence"], False, ["legal"]),
    (1, "clown", ["idiot"], False, ["toxic"]),
    (2, "The", None, True, ["stale"]),
    (3, "example.com", None, False, ["ref"]),
    (4, "lang", None, False, ["lang/fr"]),
    (5, "in-code", None, False, ["code"]),
]


def legacy_keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        LEGACY_KEYWORDS,
        "keyword_no int, keyword string, variations array<string>, caseSensitive boolean, tags array<string>")


def derived_rule_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, json)``: one imported rule per document, some of them broken.

    The document's id picks the type (one of five is unknown), its language the match
    text, so that few ids serve many rules and numbering has work to do.
    """
    n = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ["keyword", "literal", "pattern", "entity", "regex"]]),
                        (n % 5 + 1).cast("int"))
    rule = F.struct(
        kind.alias("type"),
        F.when(n % 11 == 0, F.lit("  ")).otherwise(F.concat("lang", F.lit(" "), "source")).alias("match"),
        F.when(n % 13 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", F.lit(""))).alias("tags"),
        (n % 17 == 0).alias("lemma"), (n % 2 == 0).alias("stem"),
        F.struct(F.struct(F.when(n % 19 == 0, F.lit("low")).otherwise(
            (n % 31 / 10 - 1.5).cast("decimal(9,1)").cast("string")).alias("min")).alias("sentiment")).alias("filters"),
        F.lit("old").alias("modified"))
    return table(spark, sf_dir, "documents").select(n.alias("seq"), F.to_json(rule).alias("json"))


def derived_config_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, json)``: the rules of ``derived_rule_json``, each in a configuration with a group named for the document's source."""
    group = F.struct(F.col("lang").alias("description"), F.array("lang").alias("additionalTags"), F.lit(True).alias("enabled"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.to_json(F.struct(F.create_map("source", group).alias("groups"))).alias("g"))
    both = derived_rule_json(spark, sf_dir).join(docs, "seq")
    return both.select("seq", F.concat(F.lit('{"rules":['), "json", F.lit("],"), F.expr("substring(g, 2)")).alias("json"))


def stored_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups named for the sources that have German documents, and one more."""
    names = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("source").alias("name")).distinct()
    names = names.unionByName(spark.range(1).select(F.lit("stored only").alias("name")))
    return names.select("name", F.lit("old").alias("description"), F.array(F.lit("old")).alias("additionalTags"), F.lit(True).alias("enabled"))


def derived_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per document with group memberships drawn from its id."""
    n = F.col("doc_id")
    groups = F.array_compact(F.array(
        F.when(n % 2 == 0, F.lit("even")), F.when(n % 3 == 0, F.lit("third")), F.when(n % 10 == 0, F.lit("off"))))
    return table(spark, sf_dir, "documents").select(
        n.alias("rule_no"), F.concat(F.lit("k"), n.cast("string")).alias("id"), F.lit("keyword").alias("type"),
        F.col("source").alias("match"), F.array(F.col("lang")).alias("tags"), groups.alias("groups"),
        F.when(n % 7 == 0, F.lit(False)).alias("enabled"))


def rule_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("even", ["review", "en"], True), ("third", ["third"], None), ("off", None, False)],
        "name string, additionalTags array<string>, enabled boolean")
