"""Annotation tables: tokens, sentences, paragraphs, entities, sentiment, stems.

``docs`` is any frame with ``doc_id`` and ``text``. Position-bearing tables shuffle
the *documents* once by ``doc_id``, before they are exploded; offsets, sentences and
paragraphs are worked out within the document's row, so no token is sorted or spilled. Jobs that need no positions should use
the in-row array expressions of ``functions.language`` and do not shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import language as lang
from ..functions.running import running, unit_at
from ..functions.text import WS, no_strings, trim_ws
from .scale import INLINE_RULES, bounded_rows, held, keep_where, lookup_join, one_by_one, where_or_shared

# Any callable docs -> tokens can stand in for ``tokens``.
Annotator = Callable[[DataFrame], DataFrame]


def by_document(docs: DataFrame) -> DataFrame:
    """Documents hash-partitioned by id: the one shuffle of the positional jobs."""
    return docs.select("doc_id", "text").repartition("doc_id")


def _pieces_in_rows(docs: DataFrame, cut: Callable[[Column], Column], partitioned: bool) -> DataFrame:
    """``(doc_id, nos, pieces, starts)``: per document its pieces, their numbers, and the lengths before each.

    One row per ``doc_id``: offsets are running sums within the row, and no piece is sorted. Of texts that share
    an id the pieces of one number stand together.
    """
    source = docs.select("doc_id", "text") if partitioned else by_document(docs)
    lists = source.groupBy("doc_id").agg(F.collect_list("text").alias("_texts")).select(
        "doc_id", F.transform("_texts", cut).alias("_lists"))

    def beside(lists: Column) -> Column:
        turns = F.sequence(F.lit(0), F.array_max(F.transform(lists, F.size)) - 1)
        return F.flatten(F.transform(turns, lambda i: F.transform(
            F.filter(lists, lambda own: F.size(own) > i), lambda own: F.struct(i.alias("no"), own[i].alias("piece")))))

    several = (F.size("_lists") > 1) & F.exists("_lists", lambda own: F.size(own) > 0)
    numbered = lists.select("doc_id", "_lists", F.when(several, beside(F.col("_lists"))).alias("_numbered"))
    one = F.coalesce(F.get("_lists", F.lit(0)), no_strings())
    listed = numbered.select(
        "doc_id", F.coalesce(F.col("_numbered.piece"), one).alias("pieces"),
        F.coalesce(F.col("_numbered.no"), F.transform(one, lambda _, i: i)).alias("nos"))
    return listed.select("doc_id", "nos", "pieces", running(F.transform("pieces", F.length)).alias("starts"))


def _tail(piece: Column) -> Column:
    return F.ltrim(piece, F.lit(lang.ASCII_WS))


def _surface(piece: Column) -> Column:
    return F.btrim(piece, F.lit(lang.ASCII_WS))


def _begin(start: Column, piece: Column) -> Column:
    return (start + F.length(piece) - F.length(_tail(piece))).cast("int")


def _ends_sentence(piece: Column) -> Column:
    return _surface(piece).isin(".", "!", "?") | F.contains(_tail(piece), F.lit("\n"))


def in_rows(toks: DataFrame) -> DataFrame | None:
    """What a token table of ``tokens`` was exploded from, ``(doc_id, nos, pieces, starts)``; None for other tables."""
    return getattr(toks, "_in_rows", None)


def tokens(docs: DataFrame, lexicon: DataFrame | None = None, partitioned: bool = False) -> DataFrame:
    """One row per token with offsets, sentence, part of speech, lemma.

    Each piece carries its surrounding whitespace, so a running sum of piece lengths
    gives the offsets. ``lexicon(term, pos, lemma)`` replaces the default one.
    """
    whole = _pieces_in_rows(docs, lang.token_pieces, partitioned)
    ends = running(F.transform("pieces", lambda p: _ends_sentence(p).cast("int")))
    listed = whole.select("doc_id", "nos", "pieces", "starts", ends.alias("sents"))
    placed = one_by_one(
        listed, ["doc_id"], F.arrays_zip("nos", "pieces", "starts", "sents"), "tok_no", "piece", "_start", "sent_no",
    ).select("doc_id", "tok_no", "piece", "sent_no", _surface(F.col("piece")).alias("surface"),
             _begin(F.col("_start"), F.col("piece")).alias("begin")
             ).withColumn("end", (F.col("begin") + F.length("surface")).cast("int"))
    surface = F.col("surface")
    if lexicon is None:
        pos, lemma = lang.pos_of(surface), lang.lemma_of(surface)
    else:
        known = lexicon.select(
            F.lower("term").alias("_term"), F.col("pos").alias("_pos"), F.col("lemma").alias("_lemma"))
        placed = lookup_join(placed.withColumn("_term", F.lower("surface")), known, ["_term"], "left")
        pos, lemma = lang.pos_given(surface, F.col("_pos")), lang.lemma_given(surface, F.col("_lemma"))
    out = placed.select(
        "doc_id", "sent_no", "tok_no", "begin", "end", "surface",
        pos.alias("pos"), lemma.alias("lemma"), "piece")
    if lexicon is None:
        out._in_rows = whole
    return out


def _sentences_in_rows(whole: DataFrame, text: bool) -> DataFrame:
    """Sentences of ``in_rows``: a sentence is a slice of its document's pieces."""
    size = F.size("pieces")
    closing = F.filter(F.transform("pieces", lambda p, i: F.when(_ends_sentence(p) | (i + 1 == size), i + 1)), lambda n: n.isNotNull())
    bounds = whole.select("doc_id", "pieces", "starts", closing.alias("_last"))

    def unit(last: Column, i: Column) -> Column:
        first = F.when(i == 0, 1).otherwise(F.get("_last", i - 1) + 1)
        head, tail = F.get("pieces", first - 1), F.get("pieces", last - 1)
        fields = [
            i.alias("sent_no"), _begin(F.get("starts", first - 1), head).alias("begin"),
            (_begin(F.get("starts", last - 1), tail) + F.length(_surface(tail))).cast("int").alias("end")]
        if text:
            fields.append(_surface(F.array_join(F.slice("pieces", first, last - first + 1), "")).alias("text"))
        return F.struct(*fields)

    names = ["sent_no", "begin", "end"] + (["text"] if text else [])
    return one_by_one(bounds, ["doc_id"], F.transform("_last", unit), *names)


def sentences(toks: DataFrame) -> DataFrame:
    """Sentence bounds and text, from a token table."""
    if in_rows(toks) is not None:
        return _sentences_in_rows(in_rows(toks), True)
    parts = F.sort_array(F.collect_list(F.struct("tok_no", "piece")))
    return toks.groupBy("doc_id", "sent_no").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"),
        F.btrim(F.array_join(F.transform(parts, lambda p: p["piece"]), ""),
                F.lit(lang.ASCII_WS)).alias("text"))


def sentence_bounds(toks: DataFrame) -> DataFrame:
    """N2 without the text: what scope lookups need."""
    if in_rows(toks) is not None:
        return _sentences_in_rows(in_rows(toks), False)
    return toks.groupBy("doc_id", "sent_no").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"))


_SEPARATOR = rf"\n{WS}*\n"


def _body(piece: Column) -> Column:
    return F.regexp_replace(piece, _SEPARATOR + r"\z", "")


def _paragraphs_in_rows(docs: DataFrame, partitioned: bool) -> DataFrame:
    """``(doc_id, pieces, starts, kept, nos)``: per document its blocks, which of them are not blank, and their numbers."""
    whole = _pieces_in_rows(docs, lambda text: F.regexp_extract_all(
        text, F.lit(rf"(?s).*?(?:{_SEPARATOR}|\z)"), F.lit(0)), partitioned)
    kept = F.transform("pieces", lambda p: (trim_ws(_body(p)) != "").cast("int"))
    flagged = whole.select("doc_id", "pieces", "starts", kept.alias("kept"))
    return flagged.select("doc_id", "pieces", "starts", "kept", running(F.col("kept")).alias("nos"))


def paragraph_units(docs: DataFrame, partitioned: bool = False) -> DataFrame:
    """``(doc_id, nos, begins, ends)``: the bounds of ``paragraphs``, a row per document."""
    blocks = F.filter(F.arrays_zip("pieces", "starts", "kept", "nos"), lambda b: b["kept"] == 1)
    units = F.transform(blocks, lambda b: F.struct(
        b["nos"].alias("no"), b["starts"].alias("begin"), (b["starts"] + F.length(_body(b["pieces"]))).alias("end")))
    listed = _paragraphs_in_rows(docs, partitioned).select("doc_id", units.alias("_units"))
    return listed.select("doc_id", F.col("_units.no").alias("nos"), F.col("_units.begin").alias("begins"), F.col("_units.end").alias("ends"))


def paragraphs(docs: DataFrame, partitioned: bool = False) -> DataFrame:
    """Blocks between blank lines, blank ones dropped, with true bounds."""
    listed = _paragraphs_in_rows(docs, partitioned)
    placed = one_by_one(listed, ["doc_id"], F.arrays_zip("pieces", "starts", "kept", "nos"), "_piece", "begin", "_kept", "para_no")
    return placed.where("_kept = 1").select("doc_id", "para_no", "begin", _body(F.col("_piece")).alias("text")).select(
        "doc_id", "para_no", "begin",
        (F.col("begin") + F.length("text")).cast("int").alias("end"), "text")


def entities(docs: DataFrame, partitioned: bool = False, wanted: list[str] | None = None) -> DataFrame:
    """Typed entities with offsets. Texts that can hold none are skipped early, those that can hold none of the types ``wanted``, if given, too."""
    source = docs.select("doc_id", "text")
    if wanted is not None and not partitioned:
        signs = lang.entity_signs(wanted)
        source = where_or_shared(source, "doc_id", F.col("text").rlike(signs) if signs else F.lit(False))
    source = source.where(lang.may_hold_entity(F.col("text")))
    whole = _pieces_in_rows(source, lang.entity_pieces, partitioned)
    # Ordinary words stay in the row.
    told = F.filter(F.transform("pieces", lambda p, i: F.when(lang.may_be_entity(_surface(p)), i)), lambda i: i.isNotNull())
    pieces = one_by_one(whole, ["doc_id"], F.transform(told, lambda i: F.struct(
        i.alias("i"), F.get("pieces", i).alias("piece"), F.get("starts", i).alias("start"))), "_i", "_piece", "_start")
    shaped = pieces.withColumn("surface", _surface(F.col("_piece"))).withColumn(
        "type", lang.entity_type_of(F.col("surface")))
    # Entities alone are numbered, so that ordinary words are not sorted.
    found = keep_where(shaped, F.col("type").isNotNull()).withColumn("ent_no", (F.row_number().over(
        Window.partitionBy("doc_id").orderBy("_i")) - 1).cast("int"))
    return found.select(
        "doc_id", "ent_no", "type", "surface", _begin(F.col("_start"), F.col("_piece")).alias("begin")).select(
        "doc_id", "ent_no", "type", "surface", "begin",
        (F.col("begin") + F.length("surface")).cast("int").alias("end"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """Distinct lower-cased terms of the corpus; deduplicated in-row before the shuffle."""
    terms = F.array_distinct(lang.token_surfaces(F.lower("text")))
    return one_by_one(docs, [], terms, "term").distinct()


def stems(vocab: DataFrame) -> DataFrame:
    """A stem per vocabulary term."""
    return vocab.select("term", lang.porter_stem(F.col("term")).alias("stem"))


def _mean_valence() -> Column:
    return F.round(F.avg("valence") / 5.0, 6)


def valence_hits(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens that carry an opinion, with their valence."""
    table = lexicon.select(F.lower("term").alias("term"), "valence")
    keyed = toks.select("doc_id", "sent_no", "begin", F.lower("surface").alias("term"))
    return lookup_join(keyed, table, ["term"])


def sentence_sentiment(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """N8 per sentence: mean valence / 5. Sentences without opinion words are absent (0)."""
    return valence_hits(toks, lexicon).groupBy("doc_id", "sent_no").agg(
        _mean_valence().alias("score"))


def opinions(toks: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The tokens that can carry an opinion, and ``(doc_id, nos, begins, ends)``, the documents' sentences, a row each.

    All tokens, and None, for a token table of one's own or a large lexicon.
    """
    whole = in_rows(toks)
    rows = None if whole is None else bounded_rows(lexicon.select(F.lower("term").alias("term")), INLINE_RULES)
    terms = sorted({r["term"] for r in rows or [] if r["term"] is not None})
    if not terms:
        return toks, None
    ending = whole.select("doc_id", "pieces", "starts", F.transform("pieces", _ends_sentence).alias("ending"))
    numbered = ending.select("*", running(F.transform("ending", lambda e: e.cast("int"))).alias("sents"))
    size = F.size("pieces")
    told = F.filter(F.transform("pieces", lambda p, i: F.when(F.lower(_surface(p)).isin(terms), i)), lambda i: i.isNotNull())
    hits = F.transform(told, lambda i: F.struct(
        F.get("sents", i).alias("sent_no"), _begin(F.get("starts", i), F.get("pieces", i)).alias("begin"), _surface(F.get("pieces", i)).alias("surface")))
    last = F.filter(F.transform("ending", lambda e, i: F.when(e | (i + 1 == size), i)), lambda i: i.isNotNull())
    bounded = numbered.select("doc_id", "pieces", "starts", last.alias("last"), hits.alias("hits"))
    begins = F.transform("last", lambda _, i: F.when(i == 0, 0).otherwise(F.get("last", i - 1) + 1))
    told_once = held(bounded.select(
        "doc_id", "hits", F.transform("last", lambda _, i: i).alias("nos"),
        F.transform(begins, lambda i: _begin(F.get("starts", i), F.get("pieces", i))).alias("begins"),
        F.transform("last", lambda i: (_begin(F.get("starts", i), F.get("pieces", i)) + F.length(_surface(F.get("pieces", i)))).cast("int")).alias("ends")))
    return one_by_one(told_once, ["doc_id"], F.col("hits"), "sent_no", "begin", "surface"), told_once.select("doc_id", "nos", "begins", "ends")


def document_sentiment(
    toks: DataFrame, lexicon: DataFrame, scope: str = "sentence", units: DataFrame | None = None,
) -> DataFrame:
    """N8 per document; absent documents score 0. ``units`` are the sentences, if ``toks`` is not all tokens (``opinions``).

    ``sentence`` scope is the unweighted mean over the document's sentences, any other
    scope scores the whole text at once.
    """
    if scope != "sentence":
        return valence_hits(toks, lexicon).groupBy("doc_id").agg(_mean_valence().alias("score"))
    scored = sentence_sentiment(toks, lexicon).groupBy("doc_id").agg(F.sum("score").alias("_sum"))
    counts = toks.groupBy("doc_id").agg((F.max("sent_no") + 1).alias("_n")) if units is None else units.select("doc_id", F.size("nos").alias("_n"))
    return scored.join(counts, "doc_id").select(
        "doc_id", F.round(F.col("_sum") / F.col("_n"), 6).alias("score"))


def locate_in_rows(points: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """``locate`` for units that stand in a row per document, ``(doc_id, nos, begins, ends)``: nothing is sorted."""
    own = [c for c in points.columns if c != "doc_id"]
    listed = points.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("_points")).join(units, "doc_id", "left")
    found = listed.select("doc_id", "_points", "nos", unit_at(F.col("_points.begin"), F.col("begins"), F.col("ends")).alias("_at"))
    placed = one_by_one(found.select("doc_id", "_points", F.transform("_at", lambda i: F.when(i >= 0, F.get("nos", i))).alias("_no")),
                        ["doc_id"], F.arrays_zip("_points", "_no"), "_point", unit)
    return placed.select("doc_id", "_point.*", unit).select(*points.columns, unit)


def locate(points: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """The scope unit each point's ``begin`` lies in, as column ``unit`` (or null).

    An as-of lookup: units and points are sorted together per document and each point
    takes the last unit begun, so no (point, unit) pairs are formed.
    """
    payload = F.struct(*[F.col(c) for c in points.columns])
    opened = units.select(
        "doc_id", F.col("begin").alias("_at"), F.lit(0).alias("_side"),
        F.struct(F.col(unit).alias("no"), F.col("end").alias("end")).alias("_unit"),
        F.lit(None).cast(points.select(payload.alias("p")).schema["p"].dataType).alias("_point"))
    asked = points.select(
        "doc_id", F.col("begin").alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(opened.schema["_unit"].dataType).alias("_unit"), payload.alias("_point"))
    w = Window.partitionBy("doc_id").orderBy("_at", "_side").rowsBetween(
        Window.unboundedPreceding, 0)
    found = opened.unionByName(asked).withColumn(
        "_unit", F.last("_unit", ignorenulls=True).over(w)).where("_side = 1")
    inside = F.when(F.col("_at") < F.col("_unit.end"), F.col("_unit.no"))
    return found.select("_point.*", inside.alias(unit))
