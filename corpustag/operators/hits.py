"""Which rules hit which documents, without positions.

Most rules only ask whether a document matches. Those are answered inside the row:
the document's tokens, labels, entity types and phrases are cut down to the keys some
rule names, and the rule list, folded into the plan as one constant, is filtered by
them. One pass over the text, no join, no shuffle. Rules whose filters need positions
go through the match tables. Rule sets too large to fold in are joined on keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import language as lang
from ..functions.text import let, no_strings
from .filters import filter_profile, required_types
from .match import FEW, LABEL_GAP, are_telling, keyword_keys, of_type, pattern_rules, phrase_pairs, phrase_rules, spelt_at, stem_candidates
from .scale import INLINE_RULES, bounded_rows, lookup_join, one_by_one, settled, values_of

_RULES_TYPE = "array<struct<no:bigint,id:string,keys:array<string>,need:array<string>,tags:array<string>>>"


@dataclass
class InlineSet:
    """A rule set prepared for evaluation inside the row."""

    specs: list[dict] = field(default_factory=list)
    positional: list[int] = field(default_factory=list)
    terms: dict[str, set[str]] = field(default_factory=dict)
    candidates: InlineSet | None = None

    def wants(self, part: str) -> list[str]:
        return sorted(self.terms.get(part, ()))

    def constant(self) -> Column:
        """All rules, in rule order, as one folded array of structs."""
        return F.from_json(F.lit(json.dumps(self.specs)), _RULES_TYPE)

    def managed(self) -> Column:
        """Every tag some active rule gives."""
        tags = sorted({t for spec in self.specs for t in spec["tags"]})
        return F.lit(tags) if tags else no_strings()


def need_of(row: Row) -> list[str]:
    filters = row["filters"]
    listed = filters["requireEntity"] if filters else None
    return [t for f in listed or [] for t in f["types"] or []]


def _is_positional(row: Row, entity_scope: str) -> bool:
    filters = row["filters"]
    if not filters:
        return False
    return filters["sentiment"] is not None or (entity_scope == "honor" and bool(need_of(row)))


def compile_inline(rows: Sequence[Row], entity_scope: str = "document") -> InlineSet:
    """Turn rule rows (with ``lowered``, the lower-cased match) into keys per rule.

    Rules that need positions get no keys in the set; ``candidates`` holds them with the
    keys their matches would have, to find the documents worth looking at closely.

    A part-of-speech filter is settled here where it can be: literal and entity hits
    carry no label and fail it, a pattern's labels are known beforehand.
    """
    positional = [r for r in rows if _is_positional(r, entity_scope)]
    out = InlineSet(positional=[r["rule_no"] for r in positional])
    if positional:
        out.candidates = InlineSet()
        _add_keys(out.candidates, positional)
        for spec in out.candidates.specs:
            spec["need"] = []
    _add_keys(out, rows)
    return out


def _add_keys(out: InlineSet, rows: Sequence[Row]) -> None:
    for row in rows:
        pos = list(row["filters"]["pos"] or []) if row["filters"] else []
        keys: list[str] = []

        def key(part: str, term: str) -> None:
            out.terms.setdefault(part, set()).add(term)
            keys.append(f"{part}:{term}")

        if row["rule_no"] in out.positional:
            pass
        elif row["type"] == "keyword":
            base = "lemma" if row["lemma"] else "stem" if row["stem"] else "surface"
            term = row["lowered"]
            if pos:
                out.terms.setdefault(f"{base}_pos", set()).add(term)
                keys += [f"{base}_pos:{term} {label}" for label in pos]
            else:
                key(base, term)
        elif row["type"] == "pattern":
            labels = re.split(LABEL_GAP, row["match"])
            if not pos or set(labels) & set(pos):
                key("pattern", " ".join(labels))
        elif not pos:
            key(row["type"], row["lowered"] if row["type"] == "literal" else row["match"])
        out.specs.append({
            "no": row["rule_no"], "id": row["id"], "keys": keys, "need": need_of(row),
            "tags": list(row["tags"])})


def prepare_inline(
    docs: DataFrame, rules: DataFrame, limit: int, entity_scope: str = "document",
) -> InlineSet | None:
    """Read the rules for in-row use; None if there are more than ``limit``."""
    rows = bounded_rows(rules.withColumn("lowered", F.lower("match")), limit)
    if rows is None:
        return None
    return compile_inline(sorted(rows, key=lambda r: r["rule_no"]), entity_scope)


def _stem_heads(stems: Sequence[str]) -> set[str]:
    """A stem less its last character begins every term it stems from."""
    return {s[:-1] for s in stems}


def _begins(term: Column, heads: set[str]) -> Column:
    return F.lit(True) if "" in heads else F.exists(F.lit(sorted(heads)), lambda h: F.startswith(term, h))


def _may_have_stem(term: Column, stems: Sequence[str]) -> Column:
    """Whether a term can have one of the stems."""
    return _begins(term, _stem_heads(stems))


def _are_few(heads: set[str]) -> bool:
    """Whether a lower-cased text is worth a search for each of them. Letters other than ASCII may depend on their neighbours then."""
    return len(heads) <= FEW and "" not in heads and all(h.isascii() for h in heads)


def _where_held(low: Column, heads: set[str], found: Column) -> Column:
    """``found`` for lower-cased texts that hold one of the heads, an empty array for others; if they are many, ``found``."""
    if not _are_few(heads):
        return found
    return F.when(F.exists(F.lit(sorted(heads)), lambda h: F.contains(low, h)), found).otherwise(no_strings())


def _labelled(part: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(part + ":"), v))


def _spelt(pattern: str, tokens: Column, lows: Column) -> Column:
    """Whether some run of tokens has the pattern's labels."""
    n = pattern.count(" ") + 1
    places = F.sequence(F.lit(0), F.size(tokens) - n)
    return F.when(F.size(tokens) >= n, F.exists(places, lambda i: spelt_at(i, pattern, tokens, lows))).otherwise(False)


def _token_keys(rules: InlineSet, text: Column, low: Column) -> list[Column]:
    """Keys told by tokens. ``low`` is the text in lower case: what cannot stand there is not looked for among the tokens."""
    surface, lemma = rules.wants("surface"), rules.wants("lemma")
    surface_pos, lemma_pos = rules.wants("surface_pos"), rules.wants("lemma_pos")
    stem, stem_pos = rules.wants("stem"), rules.wants("stem_pos")
    patterns = rules.wants("pattern")
    if not (surface or lemma or stem or surface_pos or lemma_pos or stem_pos or patterns):
        return []
    heads = set(surface) | set(surface_pos) | lang.lemma_heads([*lemma, *lemma_pos]) | _stem_heads([*stem, *stem_pos])

    def found(tokens: Column, lows: Column) -> Column:
        parts = []
        if surface and _are_few(set(surface)):
            there = F.filter(F.lit(surface), lambda term: F.contains(low, term))
            parts.append(_labelled("surface", F.filter(there, lambda term: F.exists(lows, lambda t: t == term))))
        elif surface:
            parts.append(_labelled("surface", F.array_intersect(lows, F.lit(surface))))
        if lemma:
            begun = lang.lemma_heads(lemma)
            near = F.filter(lows, lambda t: _begins(t, begun)) if _are_few(begun) else F.array_distinct(lows)
            parts.append(_where_held(low, begun, _labelled("lemma", F.array_intersect(F.transform(near, lang.lemma_of), F.lit(lemma)))))
        if stem:  # the few terms that can have one of the stems are reduced, here in the row
            near = F.array_distinct(F.filter(lows, lambda t: _may_have_stem(t, stem)))
            parts.append(_where_held(low, _stem_heads(stem), _labelled("stem", F.array_intersect(
                F.transform(near, lang.porter_stem), F.lit(stem)))))
        for part, terms, begun, reduce in (("surface_pos", surface_pos, set(surface_pos), F.lower),
                                           ("lemma_pos", lemma_pos, lang.lemma_heads(lemma_pos), lang.lemma_of)):
            if terms:
                named = F.filter(F.array_distinct(tokens), lambda s: reduce(s).isin(terms))
                parts.append(_where_held(low, begun, F.transform(named, lambda s: F.concat(
                    F.lit(part + ":"), reduce(s), F.lit(" "), lang.pos_of(s)))))
        if stem_pos:
            near = F.filter(F.array_distinct(tokens), lambda s: _may_have_stem(F.lower(s), stem_pos))
            parts.append(_where_held(low, _stem_heads(stem_pos), F.transform(near, lambda s: F.concat(
                F.lit("stem_pos:"), lang.porter_stem(F.lower(s)), F.lit(" "), lang.pos_of(s)))))
        if patterns and len(patterns) <= FEW:
            parts.append(F.array_compact(F.array(*[F.when(_spelt(p, tokens, lows), F.lit("pattern:" + p)) for p in patterns])))
        elif patterns:
            # Labels hold no spaces, so a run of them is a substring of the joined labels.
            joined = F.concat(F.lit(" "), F.array_join(F.transform(tokens, lang.pos_of), " "), F.lit(" "))
            parts.append(_labelled("pattern", let(joined, lambda labels: F.filter(
                F.lit(patterns), lambda p: F.contains(labels, F.concat(F.lit(" "), p, F.lit(" ")))))))
        return F.concat(*parts)

    keys = let(lang.token_surfaces(text), lambda tokens: let(F.transform(tokens, F.lower), lambda lows: found(tokens, lows)))
    return [keys if patterns else _where_held(low, heads, keys)]


def document_keys(rules: InlineSet, text: Column, types: Column) -> Column:
    """The rule keys a text with these entity types has: ``part:term``."""
    def listed(low: Column) -> Column:
        parts = _token_keys(rules, text, low)
        if rules.wants("literal"):
            parts.append(_labelled("literal", F.filter(F.lit(rules.wants("literal")), lambda p: F.contains(low, p))))
        if rules.wants("entity"):
            parts.append(_labelled("entity", F.array_intersect(
                types, F.lit(rules.wants("entity")))))
        return F.concat(*parts) if parts else no_strings()

    return let(F.lower(text), listed)


def inline_hits(rules: InlineSet, text: Column, extra: Column | None = None) -> Column:
    """The rules that hit, in rule order, as structs with ``no``, ``id`` and ``tags``.

    ``extra`` is an array of rule numbers already known to hit by other means, worked out once per row.
    """
    if extra is not None:
        return let(extra, lambda known: _inline_hits(rules, text, known))
    return _inline_hits(rules, text, None)


def _inline_hits(rules: InlineSet, text: Column, extra: Column | None) -> Column:
    needed = sorted({t for spec in rules.specs for t in spec["need"]})
    types = lang.entity_types_among(text, [*needed, *rules.wants("entity")]) if needed or rules.wants("entity") else no_strings()

    def by_types(held: Column) -> Column:
        def by_keys(keys: Column) -> Column:
            def is_hit(rule: Column) -> Column:
                own = F.arrays_overlap(rule["keys"], keys) & (
                    (F.size(rule["need"]) == 0) | F.arrays_overlap(rule["need"], held))
                return own if extra is None else own | F.array_contains(extra, rule["no"])
            return F.filter(rules.constant(), is_hit)
        return let(document_keys(rules, text, held), by_keys)

    return let(types, by_types)


# --- Rules judged by sentiment, within the row -------------------------------------

def bounds_of(row: Row) -> tuple:
    mood = row["filters"]["sentiment"]
    return mood["min"], mood["max"]


def scored_in_row(rows: Sequence[Row], entity_scope: str = "document") -> list[Row]:
    """The rules whose matches are tokens judged by the sentiment of their sentence or document.

    A document's tokens tell all about them. Literals and entities, whose matches may begin between tokens, paragraphs
    and scoped entities are left to the match tables.
    """
    numbers = [r["rule_no"] for r in rows]
    return [
        r for r in rows
        if _is_positional(r, entity_scope) and r["type"] in ("keyword", "pattern") and r["match"] is not None
        and r["filters"]["sentiment"] is not None and r["filters"]["sentiment"]["scope"] != "paragraph"
        and all(v is None or isinstance(v, (int, float)) for v in bounds_of(r))
        and not (entity_scope == "honor" and need_of(r)) and numbers.count(r["rule_no"]) == 1 and r["rule_no"] is not None]


def _token_test(row: Row) -> Callable[[Column], Column]:
    """M2's test of a surface form for a keyword rule, with its part-of-speech filter."""
    term, pos = row["lowered"], list(row["filters"]["pos"] or [])

    def test(surface: Column) -> Column:
        if row["lemma"]:
            same = lang.lemma_of(surface) == term
        elif row["stem"]:
            low = F.lower(surface)
            same = _may_have_stem(low, [term]) & (lang.porter_stem(low) == term)
        else:
            same = F.lower(surface) == term
        return same & lang.pos_of(surface).isin(pos) if pos else same
    return test


def scored_hits(rows: Sequence[Row], valences: dict[str, list[float]], pieces: Column, types: Column) -> Column:
    """The numbers of the rules of ``scored_in_row`` that hit a document with these pieces and entity types.

    Sentences are slices of the document's pieces, as in ``annotate.sentences``; each is scored once, and a rule looks for
    its tokens in those whose score lies in its range. ``valences`` holds the opinion words, lower-cased.
    """
    ws = F.lit(lang.ASCII_WS)
    table = F.create_map(*[x for t, v in sorted(valences.items()) for x in (F.lit(t), F.lit(v))])

    def score(lows: Column) -> Column:
        found = F.flatten(F.transform(F.filter(lows, lambda w: w.isin(sorted(valences))), lambda w: F.try_element_at(table, w)))
        return let(found, lambda v: F.when(F.size(v) > 0, F.round(
            F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v) / 5.0, 6)).otherwise(0.0))

    def passes(row: Row, value: Column) -> Column:
        low, high = bounds_of(row)
        test = F.lit(True)
        if low is not None:
            test = test & (value >= low)
        if high is not None:
            test = test & (value <= high)
        return test

    patterns = {r["rule_no"]: re.split(LABEL_GAP, r["match"]) for r in rows if r["type"] == "pattern"}

    def holds(row: Row, words: Column, labels: Column, first: Column, n: Column) -> Column:
        """Whether a match begins among the ``n`` tokens from ``first`` on, which counts from 1."""
        if row["type"] == "keyword":
            return F.exists(F.slice(words, first, n), _token_test(row))
        wanted, pos = patterns[row["rule_no"]], list(row["filters"]["pos"] or [])
        if pos and not set(wanted) & set(pos):
            return F.lit(False)

        def spelt(i: Column) -> Column:
            test = F.lit(True)
            for k, label in enumerate(wanted):
                test = test & F.coalesce(F.get(labels, i - 1 + k) == label, F.lit(False))
            return test
        return F.exists(F.sequence(first, first + n - 1), spelt)

    def judged(row: Row, words: Column, labels: Column, scored: Column, whole: Column) -> Column:
        if row["filters"]["sentiment"]["scope"] == "document":
            hit = (F.size(words) > 0) & passes(row, whole) & holds(row, words, labels, F.lit(1), F.size(words))
        else:
            hit = F.exists(scored, lambda s: passes(row, s["score"]) & holds(row, words, labels, s["first"], s["n"]))
        need = need_of(row)
        if need:
            hit = hit & F.arrays_overlap(types, F.lit(need))
        return F.when(hit, F.lit(row["rule_no"]).cast("bigint"))

    def by_pieces(pieces: Column) -> Column:
        ends = F.transform(pieces, lambda p, i: F.when(
            F.btrim(p, ws).isin(".", "!", "?") | F.contains(F.ltrim(p, ws), F.lit("\n")) | (i + 1 == F.size(pieces)), i + 1))

        def by_words(words: Column) -> Column:
            def by_lows(lows: Column) -> Column:
                def by_last(last: Column) -> Column:
                    first = F.transform(last, lambda _, i: F.when(i == 0, 1).otherwise(F.get(last, i - 1) + 1))
                    spans = F.zip_with(first, last, lambda a, z: F.struct(a.alias("first"), (z - a + 1).alias("n")))
                    scored = F.transform(spans, lambda s: F.struct(
                        s["first"].alias("first"), s["n"].alias("n"), score(F.slice(lows, s["first"], s["n"])).alias("score")))
                    return let(scored, lambda scored: let(labels, lambda labels: let(whole, lambda whole: F.array_compact(F.array(
                        *[judged(row, words, labels, scored, whole) for row in rows])))))
                by_document = any(r["filters"]["sentiment"]["scope"] == "document" for r in rows)
                whole = score(lows) if by_document else F.lit(0.0)
                labels = F.transform(words, lang.pos_of) if patterns else no_strings()
                return let(F.filter(ends, lambda n: n.isNotNull()), by_last)
            return let(F.transform(words, F.lower), by_lows)
        return let(F.transform(pieces, lambda p: F.btrim(p, ws)), by_words)

    return let(pieces, by_pieces)


# --- Rule sets too large to fold into the plan ------------------------------------

def _keys_of_rules(docs: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rule_no, need, label, key)`` of keyword rules and ``(rule_no, need, key)`` of the others, as in ``document_keys``.

    A keyword rule with part-of-speech filters has a row per ``label`` allowed, else a null one.
    """
    allowed, need = F.col("filters.pos"), F.coalesce(required_types(), no_strings())
    restricted = F.coalesce(F.size(allowed) > 0, F.lit(False))
    details = rules.select("rule_no", F.when(restricted, allowed).alias("allowed"), need.alias("need"))
    keyword = lookup_join(keyword_keys(rules, stem_candidates(docs, rules)), details, ["rule_no"]).select(
        "rule_no", "need", F.explode_outer("allowed").alias("label"), F.concat_ws(":", "kind", "key").alias("key"))
    pattern = lookup_join(pattern_rules(rules), details, ["rule_no"]).where(
        F.col("allowed").isNull() | F.arrays_overlap(F.split("gram", " "), "allowed")).select(
        "rule_no", "need", F.concat(F.lit("pattern:"), "gram").alias("key"))
    entity = of_type(rules, "entity").where(~restricted).select(
        "rule_no", need.alias("need"), F.concat(F.lit("entity:"), "match").alias("key"))
    return keyword, pattern.unionByName(entity)


def _gram_keys(labels: Column, n: int) -> Column:
    starts = F.when(F.size(labels) >= n, F.sequence(F.lit(1), F.size(labels) - n + 1)).otherwise(
        F.array().cast("array<int>"))
    return _labelled("pattern", F.array_distinct(F.transform(
        starts, lambda i: F.array_join(F.slice(labels, i, F.lit(n)), " "))))


def _unformed(keys: Column) -> Column:
    """Keys that no surface form stands behind."""
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("form")))


def _form_keys(rules: DataFrame, keyword_rules: DataFrame) -> Callable[[Column, Column], Column]:
    """Keys of a document's distinct surface forms, with the form; of forms that meet a rule, if the rules' keys are bounded."""
    as_lemma = True in values_of(of_type(rules, "keyword"), F.coalesce("lemma", F.lit(False)))
    known = bounded_rows(keyword_rules.select("key").where("key is not null").distinct(), INLINE_RULES)
    split = {kind: sorted({r["key"].split(":", 1)[1] for r in known or [] if r["key"].startswith(kind + ":")}) for kind in ("surface", "lemma")}

    def listed(tokens: Column, lows: Column) -> Column:
        def wanted(form: Column) -> Column:
            low = F.lower(form)
            test = low.isin(split["surface"]) if split["surface"] else F.lit(False)
            return test | lang.has_lemma(form, low, split["lemma"]) if split["lemma"] else test

        def keys(form: Column) -> Column:
            kinds = [F.concat(F.lit("surface:"), F.lower(form))] + [F.concat(F.lit("lemma:"), lang.lemma_of(form))] * as_lemma
            return F.array(*[F.struct(k.alias("key"), form.alias("form")) for k in kinds])
        return F.flatten(F.transform(F.array_distinct(tokens if known is None else F.filter(tokens, wanted)), keys))
    return listed


def _pattern_keys(rules: DataFrame) -> Callable[[Column, Column], Column]:
    """Keys of the patterns a document's tokens spell; of all runs of the patterns' lengths, if there are many patterns."""
    patterns = pattern_rules(rules)
    known = bounded_rows(patterns.select("gram").where("gram is not null").distinct(), INLINE_RULES)
    grams = None if known is None else sorted(r["gram"] for r in known)
    lengths = values_of(patterns, "n")

    def listed(tokens: Column, lows: Column) -> Column:
        if grams is not None and are_telling(grams):
            keys = F.array_compact(F.array(*[F.when(_spelt(g, tokens, lows), F.lit("pattern:" + g)) for g in grams])) if grams else no_strings()
        else:
            keys = let(F.transform(tokens, lang.pos_of), lambda labels: F.array_distinct(F.concat(*[_gram_keys(labels, n) for n in lengths])))
        return _unformed(keys)
    return listed


def joined_hits(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``(doc_id, rule_no)`` for rules without sentiment or scoped filters.

    Each document is reduced to its distinct keys in the row, the keys are joined with
    the rules' keys, and required entity types are checked on the joined rows.
    """
    rules = settled(rules)
    present = set(values_of(rules, "type"))
    profile = filter_profile(rules)

    text = F.col("text")
    needed = values_of(rules.select(F.explode(required_types()).alias("type")), "type") if profile["entity"] else []
    types = (lang.entity_types_among(text, needed) if needed else no_strings()).alias("types")
    passes = (F.size("need") == 0) | F.arrays_overlap("need", "types")
    keyword_rules, other_rules = _keys_of_rules(docs, rules)
    tables, by_tokens = [], []
    if "keyword" in present:
        by_tokens.append(_form_keys(rules, keyword_rules))
        tables.append(keyword_rules)
    if "pattern" in present:
        by_tokens.append(_pattern_keys(rules))
    if present & {"pattern", "entity"}:
        tables.append(other_rules.select("rule_no", "need", F.lit(None).cast("string").alias("label"), "key"))
    found = []
    if tables:
        columns = []
        if by_tokens:
            columns.append(let(lang.token_surfaces(text), lambda tokens: let(F.transform(tokens, F.lower), lambda lows: F.concat(
                *[keys(tokens, lows) for keys in by_tokens]))))
        if "entity" in present:
            wanted = values_of(of_type(rules, "entity"), "match")
            columns.append(_unformed(_labelled("entity", F.array_intersect(lang.entity_types_among(text, wanted), F.lit(wanted)) if wanted else no_strings())))
        # Two steps: what stands beside explode() is evaluated once per exploded row.
        keyed = docs.select("doc_id", types, F.concat(*columns).alias("keys"))
        exposed = one_by_one(keyed, ["doc_id", "types"], F.col("keys"), "key", "form")
        met = lookup_join(exposed, reduce(DataFrame.unionByName, tables), ["key"]).where(passes)
        # Only forms that meet a rule are labelled.
        found.append(met.where(F.col("label").isNull() | (lang.pos_of(F.col("form")) == F.col("label"))))
    if "literal" in present:
        need = F.coalesce(required_types(), no_strings())
        open_rules = rules.where(F.coalesce(F.size("filters.pos"), F.lit(0)) <= 0)
        pairs = phrase_pairs(docs, phrase_rules(open_rules)).select("doc_id", "rule_no", types)
        found.append(lookup_join(pairs, open_rules.select("rule_no", need.alias("need")), ["rule_no"]).where(passes))
    if not found:
        return docs.where("false").select("doc_id", F.lit(0).alias("rule_no"))
    out = found[0].select("doc_id", "rule_no")
    for more in found[1:]:
        out = out.unionByName(more.select("doc_id", "rule_no"))
    return out.distinct()
