"""Sync: rules and documents in, tag differences and rewritten notes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import language as lang
from ..functions import markdown as md
from ..functions.text import let, no_strings
from ..lexicon import sentiment_lexicon
from ..operators import annotate
from ..operators.filters import apply_filters, opinion_words, opinionated
from ..operators.hits import InlineSet, bounds_of, inline_hits, joined_hits, need_of, prepare_inline, scored_hits, scored_in_row
from ..operators.match import match_rules
from ..operators.reconcile import expected_tags, managed_tags, reconciled_text, with_changes, with_managed
from ..operators.rules import active_rules
from ..operators.scale import (
    BROADCAST_ROWS, INLINE_RULES, bounded_rows, held, is_small, keep_where, repeated_keys, settled, values_of,
)


def rule_hits(
    docs: DataFrame, rules: DataFrame, toks: DataFrame | None = None, ents: DataFrame | None = None,
    lexicon: DataFrame | None = None, entity_scope: str = "document", partitioned: bool = False,
) -> DataFrame:
    """M6 over the match tables: distinct ``(doc_id, rule_no)`` after all filters."""
    kept = filtered_matches(docs, rules, toks, ents, lexicon, entity_scope, partitioned)
    return kept.select("doc_id", "rule_no").distinct()


def filtered_matches(
    docs: DataFrame, rules: DataFrame, toks: DataFrame | None = None, ents: DataFrame | None = None,
    lexicon: DataFrame | None = None, entity_scope: str = "document", partitioned: bool = False,
) -> DataFrame:
    """M6 with P6: all matches that pass their rule's filters.

    The rules are split by filter first, so that matches of plain rules meet no join and
    a filter's tables are built for its own rules only.
    """
    rules = settled(rules)
    asks_sentiment = F.coalesce(F.col("filters.sentiment").isNotNull(), F.lit(False))
    asks_entity = F.coalesce(F.size("filters.requireEntity") > 0, F.lit(False))
    kinds = values_of(rules, F.when(asks_sentiment, 2).when(asks_entity, 1).otherwise(0))
    split = {0: ~asks_sentiment & ~asks_entity, 1: ~asks_sentiment & asks_entity, 2: asks_sentiment}
    out = None
    for kind in kinds or [0]:
        mine, near, parted = settled(rules.where(split[kind])), docs, partitioned
        if kind == 2:
            lexicon = sentiment_lexicon(docs.sparkSession) if lexicon is None else lexicon
            words = opinion_words(mine, lexicon) if not partitioned and toks is None and ents is None else None
            if words is not None:  # documents of which no match can pass are left out
                near, parted = opinionated(docs, words), True
        matches = match_rules(near, mine, toks, ents, parted)
        kept = apply_filters(matches, mine, near, toks, ents, lexicon, entity_scope, parted)
        out = kept if out is None else out.unionByName(kept)
    return out


def _positional_hits(
    docs: DataFrame, rules: DataFrame, inline: InlineSet, lexicon: DataFrame | None, entity_scope: str,
) -> DataFrame:
    """``(doc_id, extra)``: rule numbers found by the rules whose filters need positions.

    Only documents with some match of these rules are shuffled and taken apart, and of
    those, if no rule's range holds 0, only the ones with an opinion word.
    """
    chosen = settled(rules.where(F.col("rule_no").isin(inline.positional)))
    if lexicon is None:
        lexicon = sentiment_lexicon(docs.sparkSession)
    text = F.col("text")
    worth = F.size(inline_hits(inline.candidates, text)) > 0
    opinions = opinion_words(chosen, lexicon)
    if opinions is not None:
        worth = let(F.lower(text), lambda low: lang.holds_word(low, opinions)) & worth
    near = annotate.by_document(docs.where(worth))
    hits = rule_hits(near, chosen, None, None, lexicon, entity_scope, partitioned=True)
    return held(hits.groupBy("doc_id").agg(F.collect_set("rule_no").alias("extra")))


def _valences(lexicon: DataFrame) -> dict[str, list[float]] | None:
    """The opinion words of a lexicon that folds into the plan; None for one that is large, empty or not of plain numbers."""
    if not isinstance(lexicon.schema["valence"].dataType, (T.IntegralType, T.FloatType, T.DoubleType)):
        return None
    rows = bounded_rows(lexicon.select(F.lower("term").alias("term"), F.col("valence").cast("double")), INLINE_RULES)
    out: dict[str, list[float]] = {}
    for row in rows or []:
        if row["term"] is not None and row["valence"] is not None:
            out.setdefault(row["term"], []).append(row["valence"])
    return out or None


def _with_positional(
    docs: DataFrame, rules: DataFrame, inline: InlineSet, lexicon: DataFrame | None, entity_scope: str,
) -> tuple[DataFrame, Column]:
    """Documents, and an expression for the numbers of the rules with positions that hit them.

    Rules that a document's tokens decide are answered in the row, so that texts stay where they are. The match tables
    answer the others, and documents that share an id, whose texts stand together.
    """
    lexicon = sentiment_lexicon(docs.sparkSession) if lexicon is None else lexicon
    valences = _valences(lexicon)
    rows = bounded_rows(rules.withColumn("lowered", F.lower("match")), INLINE_RULES)
    near = scored_in_row(rows, entity_scope) if valences else []
    none = F.array().cast("array<bigint>")
    numbers = {r["rule_no"] for r in near}
    far = [n for n in inline.positional if n not in numbers]
    repeated = repeated_keys(docs, "doc_id") if near else None
    shared = repeated is not None and bool(repeated.take(1))
    told = []
    if shared:
        several = docs.join(repeated, "doc_id", "left_semi")
        found = _positional_hits(several, rules, inline, lexicon, entity_scope)
        told.append(repeated.join(found, "doc_id", "left").withColumn("told", F.lit(True)))
    if far:
        rest = docs.join(repeated, "doc_id", "left_anti") if shared else docs
        few = inline if not near else prepare_inline(docs, rules.where(F.col("rule_no").isin(far)), INLINE_RULES, entity_scope)
        told.append(_positional_hits(rest, rules, few, lexicon, entity_scope).withColumn("told", F.lit(False)))
    base, extra, is_told = docs, none, F.lit(False)
    if told:
        # Few documents found: broadcast them, and the texts stay where they are.
        found = told[0] if len(told) == 1 else told[0].unionByName(told[1])
        found = settled(found.select("doc_id", F.col("extra").alias("_extra"), F.col("told").alias("_told")), BROADCAST_ROWS)
        base = docs.join(F.broadcast(found) if is_small(found) else found, "doc_id", "left")
        extra = F.coalesce(F.col("_extra").cast("array<bigint>"), none)
        is_told = F.coalesce("_told", F.lit(False))
    if near:
        text, needed = F.col("text"), any(need_of(r) for r in near)
        ranges = [bounds_of(r) for r in near]
        worth = F.col("doc_id").isNotNull() & text.isNotNull() & ~is_told
        if not any((a is None or a <= 0) and (z is None or z >= 0) for a, z in ranges):
            worth = worth & let(F.lower(text), lambda low: lang.holds_word(low, sorted(valences)))
        own = scored_hits(near, valences, lang.token_pieces(text), lang.entity_types(text) if needed else no_strings())
        extra = F.concat(extra, F.when(worth, own).otherwise(none))
    return base, extra


def expected_and_existing(
    docs: DataFrame, rules: DataFrame, lexicon: DataFrame | None = None,
    entity_scope: str = "document", inline_limit: int = INLINE_RULES,
) -> DataFrame:
    """Per document: ``matched_rules``, ``expected``, ``existing``, ``managed`` and the text.

    ``rules`` must be active ones. Three plans, by what the rules need:

    * up to ``inline_limit`` rules without positions: one map-only stage;
    * some with sentiment filters on tokens: the same stage scores the sentences;
    * others with positions: the documents those can concern go through the match tables
      first, and their hits join the same stage;
    * larger rule sets: key joins, then the documents join in on ``doc_id``.
    """
    kept = [c for c in docs.columns if c not in ("doc_id", "text")]
    inline = prepare_inline(docs, rules, inline_limit, entity_scope)
    if inline is None:
        return _by_joins(docs, rules, lexicon, entity_scope)
    text = F.col("text")
    if inline.positional:
        base, extra = _with_positional(docs, rules, inline, lexicon, entity_scope)
        hits = inline_hits(inline, text, extra)
    else:
        base, hits = docs, inline_hits(inline, text)
    listed = base.select("doc_id", "text", *kept, hits.alias("_hits"))
    return listed.select(
        "doc_id", "text", *kept,
        F.col("_hits.id").alias("matched_rules"),
        F.array_distinct(F.flatten(F.col("_hits.tags"))).alias("expected"),
        md.existing_tags(text).alias("existing"), inline.managed().alias("managed"))


def _by_joins(
    docs: DataFrame, rules: DataFrame, lexicon: DataFrame | None, entity_scope: str,
) -> DataFrame:
    need_positions = F.coalesce(F.col("filters.sentiment").isNotNull(), F.lit(False))
    if entity_scope == "honor":
        need_positions |= F.coalesce(F.size("filters.requireEntity") > 0, F.lit(False))
    hits = joined_hits(docs, rules.where(~need_positions))
    positional = rules.where(need_positions)
    if positional.take(1):
        few = prepare_inline(docs, positional, INLINE_RULES, entity_scope)
        if few is None:
            more = rule_hits(docs, positional, lexicon=lexicon, entity_scope=entity_scope)
        else:  # only the documents that these rules can concern
            more = _positional_hits(docs, positional, few, lexicon, entity_scope).select("doc_id", F.explode("extra").alias("rule_no"))
        hits = hits.unionByName(more).distinct()
    tagged = docs.withColumn("existing", md.existing_tags(F.col("text"))).join(
        expected_tags(hits, rules), "doc_id", "left"
    ).withColumn("matched_rules", F.coalesce("matched_rules", no_strings())).withColumn(
        "expected", F.coalesce("expected", no_strings()))
    return with_managed(tagged, managed_tags(rules))


def tag_diff(
    docs: DataFrame, rules: DataFrame, groups: DataFrame | None = None, honor_groups: bool = False,
    lexicon: DataFrame | None = None, entity_scope: str = "document", inline_limit: int = INLINE_RULES,
) -> DataFrame:
    """What a sync would change; nothing is rewritten.

    Returns the document's columns other than ``text`` plus ``matched_rules, removed,
    added, modified``.
    """
    active = settled(active_rules(rules, groups, honor_groups))
    return with_changes(expected_and_existing(
        docs, active, lexicon, entity_scope, inline_limit)).drop("text")


def reconcile(
    docs: DataFrame, rules: DataFrame, groups: DataFrame | None = None, honor_groups: bool = False,
    lexicon: DataFrame | None = None, entity_scope: str = "document", inline_limit: int = INLINE_RULES,
    compat: bool = False,
) -> DataFrame:
    """The diff together with the rewritten ``text`` of every document."""
    active = settled(active_rules(rules, groups, honor_groups))
    diff = with_changes(expected_and_existing(docs, active, lexicon, entity_scope, inline_limit))
    return diff.withColumn(
        "text", reconciled_text(F.col("text"), F.col("removed"), F.col("added"), compat))


def document_tags(
    docs: DataFrame, rules: DataFrame, lexicon: DataFrame | None = None,
    entity_scope: str = "document", inline_limit: int = INLINE_RULES,
) -> DataFrame:
    """Matched rules and expected tags of the documents some rule hits."""
    tagged = expected_and_existing(
        docs, settled(active_rules(rules)), lexicon, entity_scope, inline_limit)
    return keep_where(tagged.select("doc_id", "matched_rules", "expected"), F.size("matched_rules") > 0)


def rule_coverage(docs: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """G11 for one run: ``(rule_id, match_count, last_triggered)``."""
    hits = document_tags(docs, rules, **options).select(F.explode("matched_rules").alias("rule_id"))
    return hits.groupBy("rule_id").agg(
        F.count("*").alias("match_count"), F.current_timestamp().alias("last_triggered"))


def only_unseen(docs: DataFrame, seen: DataFrame, version: str) -> DataFrame:
    """Documents whose text changed since ``seen(doc_id, hash, version)`` was written.

    Only ids and hashes are compared; the annotator ``version`` makes a new annotator
    look at everything again.
    """
    hashed = docs.withColumn("hash", F.sha2("text", 256))
    return hashed.join(
        seen.where(F.col("version") == version).select("doc_id", "hash"), ["doc_id", "hash"], "left_anti")
