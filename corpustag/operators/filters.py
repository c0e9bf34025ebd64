"""Filters on matches: part of speech, required entities, sentiment.

Rules without a given filter never reach that filter's join, and the filters run in
order of cost: a column test, a lookup per document, then scope lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language as lang
from ..functions.text import let
from . import annotate
from .match import made_anew
from .scale import INLINE_RULES, bounded_rows, held, keep_where, lookup_join, settled, values_of, where_or_shared


def _absent(values: Column) -> Column:
    return values.isNull() | (F.size(values) == 0)


def pos_passes(pos_tags: Column, allowed: Column) -> Column:
    """Some label is allowed; a match without labels fails. No list passes all."""
    return _absent(allowed) | F.coalesce(F.arrays_overlap(pos_tags, allowed), F.lit(False))


def required_types() -> Column:
    """All entity types of all of a rule's entity filters, as one list (any will do)."""
    return F.flatten(F.transform("filters.requireEntity", lambda f: F.coalesce(f["types"], F.array().cast("array<string>"))))


def filter_pos(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """P2 over a match table."""
    allowed = rules.select("rule_no", F.col("filters.pos").alias("_allowed"))
    kept = lookup_join(matches, allowed, ["rule_no"]).where(
        pos_passes(F.col("pos_tags"), F.col("_allowed")))
    return kept.select(*matches.columns)


def document_entity_types(docs: DataFrame, ents: DataFrame | None = None, wanted: list[str] | None = None) -> DataFrame:
    """``(doc_id, types)`` for documents that hold any entity; of types other than those ``wanted``, if given, some may be missing."""
    if ents is not None:
        return ents.groupBy("doc_id").agg(F.collect_set("type").alias("types"))
    text = F.col("text")
    types = lang.entity_types(text) if wanted is None else lang.entity_types_among(text, wanted)
    return keep_where(docs.select("doc_id", types.alias("types")), F.size("types") > 0)


def filter_entities(
    matches: DataFrame, rules: DataFrame, docs: DataFrame, ents: DataFrame | None = None,
) -> DataFrame:
    """The document holds an entity of any required type, wherever it stands."""
    needed = rules.select("rule_no", required_types().alias("_need"))
    asked = lookup_join(matches, needed, ["rule_no"])
    bound = asked.where(~_absent(F.col("_need")))
    types = document_entity_types(docs, ents, values_of(needed.select(F.explode("_need").alias("type")), "type"))
    passed = bound.join(types, "doc_id").where(F.arrays_overlap("_need", "types")).select(*matches.columns)
    if True not in values_of(needed, _absent(F.col("_need"))):
        return passed
    free = asked.where(_absent(F.col("_need")))
    return free.select(*matches.columns).unionByName(passed)


def opinion_words(rules: DataFrame, lexicon: DataFrame) -> list[str] | None:
    """Lower-cased words of which a document must have one for some match to pass: without any its scores are 0.

    None if a rule has no bounds or a range that holds 0, or if the lexicon is large.
    """
    low, high = F.col("filters.sentiment.min"), F.col("filters.sentiment.max")
    passes = F.col("filters.sentiment").isNull() | (F.coalesce(low <= 0, F.lit(True)) & F.coalesce(high >= 0, F.lit(True)))
    words = bounded_rows(lexicon.select(F.lower("term").alias("term")), INLINE_RULES)
    if not words or True in values_of(rules, F.coalesce(passes, F.lit(True))):
        return None
    return sorted({r["term"] for r in words if r["term"] is not None}) or None


def opinionated(docs: DataFrame, words: list[str]) -> DataFrame:
    """The documents with one of the words, by id; also those that share an id, as their texts are scored together."""
    worth = let(F.lower("text"), lambda low: lang.holds_word(low, words))
    return annotate.by_document(where_or_shared(docs.select("doc_id", "text"), "doc_id", worth))


def scope_units(docs: DataFrame, toks: DataFrame, scope: str, partitioned: bool = False) -> tuple[DataFrame, str]:
    """Bounds of a scope's units and the name of their number column."""
    if scope == "paragraph":
        return annotate.paragraphs(docs, partitioned).drop("text"), "para_no"
    return annotate.sentence_bounds(toks), "sent_no"


def filter_entities_in_scope(
    matches: DataFrame, rules: DataFrame, docs: DataFrame, toks: DataFrame, ents: DataFrame,
    partitioned: bool = False,
) -> DataFrame:
    """An entity of a required type in the match's own scope (default sentence).

    A match outside every unit is judged by the whole document.
    """
    listed = rules.select("rule_no", F.explode_outer("filters.requireEntity").alias("f")).select(
        "rule_no", F.coalesce("f.scope", F.lit("sentence")).alias("_scope"),
        F.explode_outer("f.types").alias("type"))
    asked = lookup_join(matches, listed, ["rule_no"])
    parts = [asked.where("type is null")] if True in values_of(listed, F.col("type").isNull()) else []
    scopes = values_of(listed.where("type is not null"), "_scope")
    in_document = ents.select("doc_id", "type").distinct()
    for scope in scopes:
        mine = asked.where((F.col("_scope") == scope) & F.col("type").isNotNull())
        if scope == "document":
            parts.append(mine.join(in_document, ["doc_id", "type"], "left_semi"))
            continue
        units, unit = scope_units(docs, toks, scope, partitioned)
        placed = annotate.locate(mine, units, unit)
        in_unit = annotate.locate(ents.select("doc_id", "type", "begin"), units, unit).where(
            F.col(unit).isNotNull()).select("doc_id", unit, "type").distinct()
        parts.append(placed.join(in_unit, ["doc_id", unit, "type"], "left_semi"))
        parts.append(placed.where(F.col(unit).isNull()).join(in_document, ["doc_id", "type"], "left_semi"))
    out = parts[0].select(*matches.columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*matches.columns))
    return out.distinct()


def paragraph_sentiment(
    docs: DataFrame, toks: DataFrame, lexicon: DataFrame, partitioned: bool = False, in_rows: DataFrame | None = None,
) -> DataFrame:
    """Mean valence / 5 per paragraph that has an opinion word. ``in_rows`` are the paragraphs' bounds, if at hand (``annotate.paragraph_units``)."""
    unit = "para_no"
    if in_rows is None:
        hits = annotate.locate(annotate.valence_hits(toks, lexicon), *scope_units(docs, toks, "paragraph", partitioned))
    else:
        hits = annotate.locate_in_rows(annotate.valence_hits(toks, lexicon), in_rows, unit)
    return hits.where(F.col(unit).isNotNull()).groupBy("doc_id", unit).agg(
        F.round(F.avg("valence") / 5.0, 6).alias("score"))


def filter_sentiment(
    matches: DataFrame, rules: DataFrame, docs: DataFrame, toks: DataFrame, lexicon: DataFrame,
    partitioned: bool = False,
) -> DataFrame:
    """P5: the score of the match's scope lies in the rule's closed range.

    Scope ``match`` is scored over its sentence. A match outside every unit is scored
    over the whole document.
    """
    bounds = rules.select(
        "rule_no", F.col("filters.sentiment").isNotNull().alias("_bound"),
        F.col("filters.sentiment.min").alias("_min"), F.col("filters.sentiment.max").alias("_max"),
        F.coalesce("filters.sentiment.scope", F.lit("sentence")).alias("_scope"))
    asked = lookup_join(matches, bounds, ["rule_no"])
    parts = [asked.where("not _bound")] if False in values_of(bounds, "_bound") else []
    scopes = values_of(bounds.where("_bound"), "_scope")
    in_range = (
        F.coalesce(F.col("_score") >= F.col("_min"), F.lit(True))
        & F.coalesce(F.col("_score") <= F.col("_max"), F.lit(True)))
    spoken, sentences = annotate.opinions(toks, lexicon)
    whole = annotate.document_sentiment(spoken, lexicon, "document").withColumnRenamed("score", "_doc_score")
    for scope in scopes:
        mine = asked.where(F.col("_bound") & (F.col("_scope") == scope))
        if scope == "document":
            scored = mine.join(whole, "doc_id", "left").withColumn(
                "_score", F.coalesce("_doc_score", F.lit(0.0)))
            parts.append(scored.where(in_range))
            continue
        unit = "para_no" if scope == "paragraph" else "sent_no"
        if sentences is None:
            placed = annotate.locate(mine, *scope_units(docs, toks, scope, partitioned))
            units = None
        else:
            units = held(annotate.paragraph_units(docs, partitioned)) if scope == "paragraph" else sentences
            placed = annotate.locate_in_rows(mine, units, unit)
        if scope == "paragraph":
            scores = paragraph_sentiment(docs, spoken, lexicon, partitioned, units)
            fallback = whole
        else:
            scores = annotate.sentence_sentiment(spoken, lexicon)
            fallback = whole if scope == "match" else annotate.document_sentiment(
                spoken, lexicon, units=sentences).withColumnRenamed("score", "_doc_score")
        inside = placed.where(F.col(unit).isNotNull()).join(scores, ["doc_id", unit], "left").withColumn(
            "_score", F.coalesce("score", F.lit(0.0)))
        outside = placed.where(F.col(unit).isNull()).join(fallback, "doc_id", "left").withColumn(
            "_score", F.coalesce("_doc_score", F.lit(0.0)))
        parts += [inside.where(in_range), outside.where(in_range)]
    out = parts[0].select(*matches.columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*matches.columns))
    return out


def filter_profile(rules: DataFrame) -> dict[str, bool]:
    """Which kinds of filter occur in the rule set."""
    return {
        "pos": True in values_of(rules, ~_absent(F.col("filters.pos"))),
        "entity": True in values_of(rules, ~_absent(required_types())),
        "sentiment": True in values_of(rules, F.col("filters.sentiment").isNotNull()),
    }


def apply_filters(
    matches: DataFrame, rules: DataFrame, docs: DataFrame, toks: DataFrame | None = None,
    ents: DataFrame | None = None, lexicon: DataFrame | None = None, entity_scope: str = "document",
    partitioned: bool = False,
) -> DataFrame:
    """Matches that pass all of their rule's filters.

    ``entity_scope='honor'`` looks for required entities in the scope a rule names;
    the default tests the document as a whole.
    """
    rules = settled(rules)
    profile = filter_profile(rules)
    anew = made_anew(matches, docs)
    if profile["sentiment"]:
        if lexicon is None:
            from ..lexicon import sentiment_lexicon
            lexicon = sentiment_lexicon(docs.sparkSession)
        words = opinion_words(rules, lexicon) if anew is not None and not partitioned and toks is None and ents is None else None
        if words is not None:  # documents of which no match can pass are left out before anything is matched
            docs, partitioned = opinionated(docs, words), True
            matches = anew(docs)
    if profile["pos"]:
        matches = filter_pos(matches, rules)
    honor = entity_scope == "honor"
    if toks is None and (profile["sentiment"] or (profile["entity"] and honor)):
        toks = annotate.tokens(docs, partitioned=partitioned)
    if profile["entity"]:
        if honor:
            found = annotate.entities(docs, partitioned) if ents is None else ents
            matches = filter_entities_in_scope(matches, rules, docs, toks, found, partitioned)
        else:
            matches = filter_entities(matches, rules, docs, ents)
    if profile["sentiment"]:
        matches = filter_sentiment(matches, rules, docs, toks, lexicon, partitioned)
    return matches
