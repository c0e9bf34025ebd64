"""Matchers with positions: every hit of every rule, as joins of rules and annotations.

Each matcher returns ``MATCH_COLUMNS``. Rules and lexicons are broadcast only after a
size check (``lookup_join``); beyond it the join is salted. Hit/no-hit questions are
answered without positions, and without a shuffle, in ``operators.hits``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import language as lang
from ..functions import markdown as md
from ..functions.text import let, regex_escape
from ..schema import MATCH_COLUMNS
from . import annotate
from .scale import BROADCAST_ROWS, INLINE_RULES, bounded_rows, is_small, lookup_join, one_by_one, settled, values_of


def _no_labels() -> Column:
    return F.lit(None).cast("array<string>").alias("pos_tags")



def of_type(rules: DataFrame, kind: str) -> DataFrame:
    return rules.where(F.col("type") == kind)


# --- M1 ---------------------------------------------------------------------------

#: So many terms or patterns at most are looked for one by one.
FEW = 16

#: What separates the labels of a pattern, for both plans.
LABEL_GAP = r"[ \t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def pattern_rules(rules: DataFrame) -> DataFrame:
    """Pattern rules with their label sequence as one ``gram``."""
    labels = F.split("match", LABEL_GAP, -1)
    return of_type(rules, "pattern").select(
        "rule_no", F.col("id").alias("rule_id"), F.array_join(labels, " ").alias("gram"),
        F.size(labels).alias("n"))


def match_patterns(toks: DataFrame, rules: DataFrame) -> DataFrame:
    """M1: runs of tokens whose parts of speech spell the pattern; overlaps are kept."""
    patterns = pattern_rules(settled(rules))
    lengths = values_of(patterns, "n") or [1]
    known = bounded_rows(patterns.select("gram"), INLINE_RULES)
    grams = None if known is None else sorted({r["gram"] for r in known})
    whole = annotate.in_rows(toks)
    found = _runs_of_tokens(toks, lengths, grams) if whole is None else _runs_in_rows(whole, lengths, grams)
    return lookup_join(found, patterns, ["n", "gram"]).select(
        "doc_id", "rule_no", "rule_id", "text", "begin", "end", F.split("gram", " ").alias("pos_tags"))


def are_telling(grams: list[str]) -> bool:
    """Whether patterns are worth a search one by one: few, and each with a label that cheap tests tell."""
    return len(grams) <= FEW and all(min(map(lang.pos_breadth, g.split(" "))) < 2 for g in grams)


def places_spelt(pattern: str, tokens: Column, lows: Column) -> Column:
    """Where, counted from 0, a run of tokens has the pattern's labels. Cheap tests come first, the most telling at the front."""
    n = pattern.count(" ") + 1
    places = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: spelt_at(i, pattern, tokens, lows))


def spelt_at(i: Column, pattern: str, tokens: Column, lows: Column) -> Column:
    """Whether the tokens from ``i`` on have the pattern's labels."""
    labels = pattern.split(" ")
    test = F.lit(True)
    for k in sorted(range(len(labels)), key=lambda k: lang.pos_breadth(labels[k])):
        test = test & lang.may_be(F.get(lows, i + k), labels[k])
    return test & (F.transform(F.slice(tokens, i + 1, F.lit(len(labels))), lang.pos_of) == F.lit(labels))


def _words_of(whole: DataFrame) -> DataFrame:
    """Documents with all their pieces in the row, and the tokens' surfaces, as they are and in lower case."""
    ws = F.lit(lang.ASCII_WS)
    words = whole.select("doc_id", "pieces", "starts", F.transform("pieces", lambda p: F.btrim(p, ws)).alias("words"))
    return words.select("*", F.transform("words", F.lower).alias("lows"))


def _begin_of(i: Column) -> Column:
    piece = F.get("pieces", i)
    return (F.get("starts", i) + F.length(piece) - F.length(F.ltrim(piece, F.lit(lang.ASCII_WS)))).cast("int")


def _run_at(i: Column, n: int) -> list[Column]:
    """Text and bounds of the ``n`` tokens from ``i`` on."""
    return [F.array_join(F.slice("words", i + 1, F.lit(n)), " ").alias("text"), _begin_of(i).alias("begin"),
            (_begin_of(i + n - 1) + F.length(F.get("words", i + n - 1))).cast("int").alias("end")]


def _runs_in_rows(whole: DataFrame, lengths: list[int], grams: list[str] | None) -> DataFrame:
    """Runs of labels of documents with all their pieces in the row; those of ``grams``, if given."""
    if grams and are_telling(grams):
        def spelt_out(gram: str) -> Column:
            n = gram.count(" ") + 1
            return F.transform(places_spelt(gram, F.col("words"), F.col("lows")), lambda i: F.struct(
                F.lit(n).alias("n"), F.lit(gram).alias("gram"), *_run_at(i, n)))
        return one_by_one(_words_of(whole), ["doc_id"], F.concat(*[spelt_out(g) for g in grams]), "n", "gram", "text", "begin", "end")
    labelled = _words_of(whole).select("*", F.transform("words", lang.pos_of).alias("labels"))

    def runs(n: int) -> Column:
        own = None if grams is None else [g for g in grams if g.count(" ") == n - 1]
        def gram(i: Column) -> Column:
            return F.concat_ws(" ", *[F.get("labels", i + k) for k in range(n)])
        starts = F.when(F.size("labels") >= n, F.sequence(F.lit(0), F.size("labels") - n)).otherwise(F.array().cast("array<int>"))
        if own is not None:
            starts = F.filter(starts, lambda i: gram(i).isin(own))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), gram(i).alias("gram"), *_run_at(i, n)))

    return one_by_one(labelled, ["doc_id"], F.concat(*[runs(n) for n in lengths]), "n", "gram", "text", "begin", "end")


def _runs_of_tokens(toks: DataFrame, lengths: list[int], known: list[str] | None) -> DataFrame:
    """The same of a token table of any annotator."""
    w = Window.partitionBy("doc_id").orderBy("tok_no")

    def ahead(column: str, n: int) -> list[Column]:
        return [F.col(column) if i == 0 else F.lead(column, i).over(w) for i in range(n)]

    longest = lengths[-1]
    wide = toks.select(
        "doc_id", "tok_no", "begin",
        *[c.alias(f"_pos{i}") for i, c in enumerate(ahead("pos", longest))],
        *[c.alias(f"_surface{i}") for i, c in enumerate(ahead("surface", longest))],
        *[c.alias(f"_end{i}") for i, c in enumerate(ahead("end", longest))],
    )
    # A gram that runs over the document's end is null and joins nothing.
    grams = F.array(*[F.struct(
        F.lit(n).alias("n"),
        F.when(F.col(f"_pos{n - 1}").isNotNull(),
               F.concat_ws(" ", *[F.col(f"_pos{i}") for i in range(n)])).alias("gram"),
        F.col(f"_end{n - 1}").alias("end"),
    ) for n in lengths])
    surfaces = F.array(*[F.col(f"_surface{i}") for i in range(longest)])
    exploded = wide.select("doc_id", "begin", surfaces.alias("_surfaces"), F.explode(grams).alias("g"))
    exploded = exploded.select("doc_id", "begin", "_surfaces", "g.*").where("gram is not null")
    if known is not None:
        exploded = exploded.where(F.col("gram").isin(known))
    return exploded.select("doc_id", "n", "gram", "begin", "end", F.array_join(F.slice("_surfaces", F.lit(1), F.col("n")), " ").alias("text"))


# --- M2 ---------------------------------------------------------------------------

def keyword_keys(rules: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Keyword rules as ``(rule_no, rule_id, kind, key)`` to compare tokens with.

    A lemma rule keeps its term as a lemma key. A stem rule is turned round: the
    vocabulary's terms with that stem become plain surface keys, so the running text
    is never stemmed. The rule's own term is not reduced.
    """
    terms = of_type(rules, "keyword").select(
        "rule_no", F.col("id").alias("rule_id"), F.lower("match").alias("key"),
        F.when(F.coalesce("lemma", F.lit(False)), "lemma")
        .when(F.coalesce("stem", F.lit(False)), "stem").otherwise("surface").alias("kind"))
    plain = terms.where("kind <> 'stem'").select("rule_no", "rule_id", "kind", "key")
    if vocab is None:
        return plain
    wanted = terms.where("kind = 'stem'").select("rule_no", "rule_id", F.col("key").alias("stem"))
    heads = _stem_heads(wanted)
    near = vocab if heads is None else vocab.where(F.exists(F.lit(heads), lambda h: F.startswith(F.col("term"), h)) if heads else F.lit(False))
    stemmed = lookup_join(annotate.stems(near), wanted, ["stem"]).select(
        "rule_no", "rule_id", F.lit("surface").alias("kind"), F.col("term").alias("key"))
    # Few terms share the wanted stems: keep them, so that later uses do not stem again.
    return settled(plain.unionByName(settled(stemmed, BROADCAST_ROWS)), BROADCAST_ROWS)


def _stem_heads(wanted: DataFrame) -> list[str] | None:
    """What every term with one of the wanted stems begins with: a stem less its last character. None if that cuts nothing down."""
    rows = bounded_rows(wanted.select("stem"), INLINE_RULES)
    heads = None if rows is None else sorted({r["stem"][:-1] for r in rows})
    return None if heads is None or "" in heads else heads


def stem_candidates(docs: DataFrame, rules: DataFrame) -> DataFrame | None:
    """The vocabulary that can matter to the stem rules; None if there are none.

    A stem less its last character begins every term it stems from. Documents are
    tested for those beginnings as plain substrings before they are tokenized.
    """
    stem_rules = of_type(rules, "keyword").where("coalesce(stem, false) and not coalesce(lemma, false)")
    rows = bounded_rows(stem_rules.select(F.lower("match").alias("stem")), INLINE_RULES)
    if rows is None:
        return annotate.vocabulary(docs)
    heads = sorted({r["stem"][:-1] for r in rows})
    if not heads:
        return None
    if "" in heads:
        return annotate.vocabulary(docs)
    heads = F.lit(heads)
    holding = docs.where(let(F.lower("text"), lambda low: F.exists(heads, lambda h: F.contains(low, h))))
    return annotate.vocabulary(holding).where(
        F.exists(heads, lambda h: F.startswith(F.col("term"), h)))


def match_keywords(toks: DataFrame, rules: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """M2: whole tokens equal to a rule term, by surface, lemma or stem."""
    rules = settled(rules)
    keys = keyword_keys(rules, vocab)
    lemma_rules = values_of(of_type(rules, "keyword"), F.coalesce("lemma", F.lit(False)))
    kinds = ["lemma" if is_lemma else "surface" for is_lemma in lemma_rules]
    whole = annotate.in_rows(toks)
    known = None if whole is None else bounded_rows(keys.select("kind", "key").where("key is not null"), INLINE_RULES)
    if known is not None:
        toks = _tokens_of_keys(whole, {r["key"] for r in known if r["kind"] == "surface"}, {r["key"] for r in known if r["kind"] == "lemma"})
    columns = {"surface": F.lower("surface"), "lemma": F.lower("lemma")}
    exposed = one_by_one(
        toks, ["doc_id", "begin", "end", F.col("surface").alias("text"), "pos"],
        F.array(*[F.struct(F.lit(kind).alias("kind"), columns[kind].alias("key")) for kind in (kinds or ["surface"])]), "k")
    hits = lookup_join(exposed.select("doc_id", "begin", "end", "text", "pos", "k.*"), keys, ["kind", "key"])
    return hits.select(
        "doc_id", "rule_no", "rule_id", "text", "begin", "end", F.array("pos").alias("pos_tags"))


def _places_of_keys(terms: set[str], lemmas: set[str]) -> Column:
    """Where the tokens with one of the terms or lemmas stand, in ``_words_of`` documents."""
    def wanted(low: Column, i: Column) -> Column:
        test = low.isin(sorted(terms)) if terms else F.lit(False)
        return test | lang.has_lemma(F.get("words", i), low, lemmas) if lemmas else test
    return F.filter(F.transform("lows", lambda low, i: F.when(wanted(low, i), i)), lambda i: i.isNotNull())


def _tokens_of_keys(whole: DataFrame, terms: set[str], lemmas: set[str]) -> DataFrame:
    """The tokens with one of the terms or lemmas, of documents with all their pieces in the row; only these are labelled."""
    found = one_by_one(_words_of(whole), ["doc_id"], F.transform(_places_of_keys(terms, lemmas), lambda i: F.struct(*_run_at(i, 1))),
                       "surface", "begin", "end")
    return found.select("*", lang.pos_of(F.col("surface")).alias("pos"), lang.lemma_of(F.col("surface")).alias("lemma"))


def _match_tokens(toks: DataFrame, rules: DataFrame, vocab: DataFrame | None) -> DataFrame | None:
    """M1 and M2 together, in one pass over the tokens; None for a token table of one's own, and for many keys or patterns."""
    whole = annotate.in_rows(toks)
    keys = None if whole is None else keyword_keys(rules, vocab).where("key is not null")
    patterns = pattern_rules(rules).where("gram is not null")
    known = None if keys is None else bounded_rows(keys.select("kind", "key").distinct(), INLINE_RULES)
    grams = None if known is None else bounded_rows(patterns.select("gram").distinct(), INLINE_RULES)
    grams = None if grams is None else sorted(r["gram"] for r in grams)
    if not grams or not are_telling(grams):
        return None
    by_kind = {kind: {r["key"] for r in known if r["kind"] == kind} for kind in ("surface", "lemma")}

    def element(kind: str, key: Column, i: Column, n: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), *_run_at(i, n))

    def spelt_out(gram: str) -> Column:
        return F.transform(places_spelt(gram, F.col("words"), F.col("lows")), lambda i: element("pattern", F.lit(gram), i, gram.count(" ") + 1))

    tests = {"surface": lambda i: F.get("lows", i), "lemma": lambda i: lang.lemma_of(F.get("words", i))}
    kinds = [kind for kind in tests if by_kind[kind]]
    listed = [spelt_out(g) for g in grams]
    if kinds:
        listed.append(F.flatten(F.transform(_places_of_keys(by_kind["surface"], by_kind["lemma"]), lambda i: F.array(
            *[element(kind, tests[kind](i), i, 1) for kind in kinds]))))
    found = one_by_one(_words_of(whole), ["doc_id"], F.concat(*listed), "kind", "key", "text", "begin", "end")
    table = keys.select("rule_no", "rule_id", "kind", "key").unionByName(
        patterns.select("rule_no", "rule_id", F.lit("pattern").alias("kind"), F.col("gram").alias("key")))
    return lookup_join(found, settled(table), ["kind", "key"]).select(
        "doc_id", "rule_no", "rule_id", "text", "begin", "end",
        F.when(F.col("kind") == "pattern", F.split("key", " ")).otherwise(F.array(lang.pos_of(F.col("text")))).alias("pos_tags"))


# --- M3 ---------------------------------------------------------------------------

def phrase_rules(rules: DataFrame) -> DataFrame:
    return of_type(rules, "literal").select(
        "rule_no", F.col("id").alias("rule_id"), F.lower("match").alias("phrase")
    ).where("phrase <> ''")


def _trigrams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def phrase_pairs(docs: DataFrame, phrases: DataFrame, inline_limit: int = INLINE_RULES) -> DataFrame:
    """M3 as existence: ``(doc_id, text, rule_no, rule_id, phrase)`` where the phrase occurs.

    Few phrases are tested inside the row, so nothing is joined or shuffled. More are
    blocked on one trigram each (the one fewest phrases share), joined on equality and
    then verified; phrases under three characters always take the first way.
    """
    rows = bounded_rows(phrases, inline_limit)
    if rows is not None:
        return _phrase_pairs_inline(docs, phrases, rows)
    short = phrases.where(F.length("phrase") < 3)
    short_rows = bounded_rows(short.groupBy("phrase").agg(F.count("*").alias("n")), inline_limit)
    long = phrases.where(F.length("phrase") >= 3)
    grams = long.select("rule_no", "rule_id", "phrase", F.explode(_trigrams(F.col("phrase"))).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("_n"))
    anchors = grams.join(shared, "gram").groupBy("rule_no", "rule_id", "phrase").agg(
        F.min(F.struct("_n", "gram"))["gram"].alias("gram"))
    by_gram = docs.select("doc_id", "text", F.explode(_trigrams(F.lower("text"))).alias("gram"))
    if is_small(anchors, BROADCAST_ROWS):
        pairs = lookup_join(by_gram, anchors, ["gram"])
        pairs = pairs.where(F.contains(F.lower("text"), F.col("phrase"))).drop("gram")
    else:
        # Shuffle ids and grams only; the text joins in again for the candidates.
        candidates = lookup_join(by_gram.drop("text"), anchors, ["gram"]).drop("gram")
        pairs = candidates.join(docs.select("doc_id", "text"), "doc_id").where(
            F.contains(F.lower("text"), F.col("phrase")))
    columns = ["doc_id", "text", "rule_no", "rule_id", "phrase"]
    if short_rows is None:
        tiny = _short_phrase_pairs(docs, short)
    else:
        tiny = _phrase_pairs_inline(docs, short, short_rows)
    return pairs.select(*columns).unionByName(tiny.select(*columns))


def _phrase_pairs_inline(docs: DataFrame, phrases: DataFrame, rows: list) -> DataFrame:
    distinct = sorted({r["phrase"] for r in rows})
    if not distinct:
        distinct = [""]
    # let() binds the lower-cased text, so it is computed once per row, not per phrase.
    present = let(F.lower("text"), lambda low: F.filter(
        F.lit(distinct), lambda p: F.contains(low, p) & (p != "")))
    found = one_by_one(docs, ["doc_id", "text"], present, "phrase")
    return lookup_join(found, phrases, ["phrase"])


def _short_phrase_pairs(docs: DataFrame, short: DataFrame) -> DataFrame:
    """Many one- and two-character phrases: equal to a character or character pair."""
    lowered = F.lower("text")
    singles = F.regexp_extract_all(lowered, F.lit("(?s)."), F.lit(0))
    doubles = F.regexp_extract_all(lowered, F.lit("(?s)(?=(..))"), F.lit(1))
    found = docs.select("doc_id", "text", F.explode(
        F.array_distinct(F.concat(singles, doubles))).alias("phrase"))
    return lookup_join(found, short, ["phrase"])


def count_phrases(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """M3 counts only: ``(doc_id, rule_no, rule_id, n)``, computed within the row."""
    pairs = phrase_pairs(docs, phrase_rules(rules))
    lowered = F.lower("text")
    gone = F.length(F.replace(lowered, F.col("phrase"), F.lit("")))
    n = (F.length(lowered) - gone) / F.length("phrase")
    return pairs.select("doc_id", "rule_no", "rule_id", n.cast("long").alias("n"))


def match_literals(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """M3: case-insensitive substrings, left to right without overlap.

    The lower-cased text is split at the phrase; a running sum of part lengths gives
    the offsets. Only lengths and matched text are exploded, never the document.
    """
    pairs = phrase_pairs(docs, phrase_rules(rules))
    quoted = regex_escape(F.col("phrase"))
    parts = F.transform(F.split(F.lower("text"), quoted, F.lit(-1)), lambda p: F.length(p))
    surfaces = F.regexp_extract_all("text", F.concat(F.lit("(?iu)"), quoted), F.lit(0))
    cut = pairs.select(
        "doc_id", "rule_no", "rule_id", "text", F.length("phrase").alias("_len"),
        parts.alias("_parts"), surfaces.alias("_surfaces"))
    # Rare case mappings can make the two scans disagree; then cut at the offsets.
    offsets = F.aggregate(
        "_parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, p: F.struct(
            (acc["at"] + p + F.col("_len")).alias("at"),
            F.array_append(acc["all"], acc["at"] + p).alias("all")))["all"]
    sliced = F.transform(offsets, lambda at: F.substring(F.col("text"), at + 1, F.col("_len")))
    same = F.size("_surfaces") == F.size("_parts") - 1
    listed = cut.select(
        "doc_id", "rule_no", "rule_id", "_len",
        F.posexplode_outer(F.slice(F.arrays_zip(
            F.col("_parts").alias("part"), F.when(same, F.col("_surfaces")).otherwise(sliced).alias("surface"),
        ), F.lit(1), F.size("_parts") - 1)).alias("_i", "_hit")).where("_i is not null")
    w = Window.partitionBy("doc_id", "rule_no").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    placed = listed.withColumn(
        "begin", (F.sum("_hit.part").over(w) + F.col("_i") * F.col("_len")).cast("int"))
    return placed.select(
        "doc_id", "rule_no", "rule_id", F.col("_hit.surface").alias("text"), "begin",
        (F.col("begin") + F.col("_len")).cast("int").alias("end"), _no_labels())


# --- M4, M5, M6 -------------------------------------------------------------------

def match_entities(ents: DataFrame, rules: DataFrame) -> DataFrame:
    """M4: entities whose type is the rule's text, case and all."""
    wanted = of_type(rules, "entity").select(
        "rule_no", F.col("id").alias("rule_id"), F.col("match").alias("type"))
    return lookup_join(ents, wanted, ["type"]).select(
        "doc_id", "rule_no", "rule_id", F.col("surface").alias("text"), "begin", "end",
        _no_labels())


def match_rules(
    docs: DataFrame, rules: DataFrame, toks: DataFrame | None = None, ents: DataFrame | None = None,
    partitioned: bool = False,
) -> DataFrame:
    """M6 before filters: all matches of the given rules, whatever their types.

    ``toks`` and ``ents`` default to this library's annotators; pass tables to use
    other ones. Types without a rule cost nothing.
    """
    rules = settled(rules)
    present = set(values_of(rules, "type"))
    parts = []
    own_tokens = toks is None
    if present & {"pattern", "keyword"} and own_tokens:
        toks = annotate.tokens(docs, partitioned=partitioned)
    vocab = stem_candidates(docs, rules) if "keyword" in present else None
    if vocab is not None and not own_tokens:
        vocab = toks.select(F.lower("surface").alias("term")).distinct()
    both = _match_tokens(toks, rules, vocab) if present >= {"pattern", "keyword"} and own_tokens else None
    if both is not None:
        parts.append(both)
    if "pattern" in present and both is None:
        parts.append(match_patterns(toks, rules))
    if "keyword" in present and both is None:
        parts.append(match_keywords(toks, rules, vocab))
    if "literal" in present:
        parts.append(match_literals(docs, rules))
    if "entity" in present:
        parts.append(match_entities(
            annotate.entities(docs, partitioned, values_of(of_type(rules, "entity"), "match")) if ents is None else ents, rules))
    if not parts:
        empty = docs.where("false").select("doc_id")
        return empty.select(
            "doc_id", F.lit(0).alias("rule_no"), F.lit("").alias("rule_id"), F.lit("").alias("text"),
            F.lit(0).alias("begin"), F.lit(0).alias("end"), _no_labels())
    out = parts[0].select(*MATCH_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*MATCH_COLUMNS))
    if own_tokens and ents is None:
        out._anew = docs, lambda fewer: match_rules(fewer, rules, partitioned=True)
    return out


def made_anew(matches: DataFrame, docs: DataFrame) -> Callable[[DataFrame], DataFrame] | None:
    """What gives the matches of some of the documents, by id, of a table that ``match_rules`` made of ``docs``; None for other tables."""
    made_of, anew = getattr(matches, "_anew", (None, None))
    return anew if made_of is docs else None


def keyword_pattern(term: Column, case_sensitive: Column) -> Column:
    """M5's pattern: the term between ASCII word boundaries."""
    word = "[A-Za-z0-9_]"
    left = F.when(term.rlike(f"^{word}"), F.lit(f"(?<!{word})")).otherwise(F.lit(f"(?<={word})"))
    right = F.when(term.rlike(rf"{word}\z"), F.lit(f"(?!{word})")).otherwise(F.lit(f"(?={word})"))
    fold = F.when(case_sensitive, F.lit("")).otherwise(F.lit("(?iu)"))
    return F.concat(fold, left, regex_escape(term), right)


def prose_only(text: Column) -> Column:
    """The text M5 looks at: no front matter, no fenced blocks.

    Fences pair up from the top of the file, so one left open by the front matter is
    re-opened ahead of the body before the body's blocks are cut.
    """
    def cut(lines: Column) -> Column:
        def after(n: Column) -> Column:
            body = F.array_join(F.slice(lines, n + 1, F.size(lines)), "\n")
            fences = F.size(F.filter(F.slice(lines, F.lit(1), n), lambda line: line.startswith("```")))
            return md.strip_fences(F.when(fences % 2 == 1, F.concat(F.lit("```\n"), body)).otherwise(body))
        return let(md.front_matter_line_count(lines), after)

    return let(F.split(text, "\n", -1), cut)


def match_legacy_keywords(docs: DataFrame, keywords: DataFrame, inline_limit: int = INLINE_RULES) -> DataFrame:
    """M5: distinct ``(doc_id, keyword_no, keyword)`` with a hit outside front matter and fences.

    ``keywords`` has ``keyword_no, keyword, variations, caseSensitive, tags``.
    """
    terms = keywords.select("keyword_no", "keyword", F.coalesce("caseSensitive", F.lit(False)).alias("_cs"), F.explode(
        F.concat(F.array("keyword"), F.coalesce("variations", F.array().cast("array<string>")))).alias("term"))
    table = terms.where("term <> ''").select(
        "keyword_no", "keyword", keyword_pattern(F.col("term"), F.col("_cs")).alias("_pattern"),
        F.when(F.col("_cs"), F.col("term")).otherwise(F.lower("term")).alias("phrase"), "_cs")
    prose = docs.select("doc_id", prose_only(F.col("text")).alias("text"))
    # A term with word boundaries is first of all a substring: block on that.
    pairs = phrase_pairs(prose, table.select(
        F.col("keyword_no").alias("rule_no"), F.col("_pattern").alias("rule_id"),
        F.lower("phrase").alias("phrase")).distinct(), inline_limit)
    hits = pairs.where(F.rlike("text", "rule_id")).select(
        "doc_id", F.col("rule_no").alias("keyword_no")).distinct()
    return lookup_join(hits, keywords.select("keyword_no", "keyword"), ["keyword_no"])
