"""Token, part-of-speech, lemma and entity expressions, and the stemmer.

These are this library's own deterministic annotators. They see one surface form
at a time, so they hold for a table of tokens and inside an array lambda alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon
from .text import let

# Token and entity shapes. The first alternative that fits wins. The
# possessive loops (*+, ++) stop Java recursing once per repetition on inputs such
# as a 100,000-number list without spaces; they never change what matches.
URL = r"https?://[^\s<>\"]+"
EMAIL = r"[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)++"
HASHTAG = r"#[A-Za-z0-9][A-Za-z0-9_\-/]*"
MENTION = r"@[A-Za-z0-9_]+"
WORD = r"\p{L}[\p{L}\p{M}]*(?:['’]\p{L}+)?"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*+"

TOKEN = "|".join([URL, EMAIL, HASHTAG, MENTION, WORD, NUMBER + "%?", r"[^\s]"])
# The same tokens for a text without an at sign, where every word is tried once less.
TOKEN_NO_AT = "|".join([URL, HASHTAG, WORD, NUMBER + "%?", r"[^\s]"])

_MONTH = ("(?:January|February|March|April|May|June|July|August|September|October|"
          "November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)")
_UNIT = "(?:second|minute|hour|day|week|month|year)s?"

DATE = "|".join([
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}",
    _MONTH + r"\.? [0-9]{1,2}(?:, [0-9]{4})?",
])
TIME = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: ?[AaPp][Mm]\b)?|[0-9]{1,2} ?[AaPp][Mm]\b"
DURATION = rf"[0-9]+ {_UNIT}\b"
ORDINAL = r"[0-9]+(?:st|nd|rd|th)\b"
MONEY = rf"[$€£¥] ?{NUMBER}"
PERCENT = NUMBER + "%"
EMOTICON = r"[:;]-?[()]|<3"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"

# Alternation order of the entity scan; WORD keeps digits inside words apart.
ENTITY_SHAPES = [
    ("URL", URL), ("EMAIL", EMAIL), ("HASHTAG", HASHTAG), ("MENTION", MENTION),
    ("DATE", DATE), ("TIME", TIME), ("DURATION", DURATION), ("ORDINAL", ORDINAL),
    ("MONEY", MONEY), ("PERCENT", PERCENT), ("CARDINAL", NUMBER),
    ("EMOTICON", EMOTICON), ("EMOJI", EMOJI),
]
ENTITY_OR_WORD = "|".join([shape for _, shape in ENTITY_SHAPES] + [WORD])
# There a word from a to z that is no URL is told first, as no other shape begins with one.
ENTITY_OR_WORD_NO_AT = "|".join(
    [rf"(?!https?://)(?=[a-z]){WORD}"] + [shape for name, shape in ENTITY_SHAPES if name not in ("EMAIL", "MENTION")] + [WORD])

# What a text with an entity of a type holds, by type: one of some characters, or a shape.
_SIGNS = {
    "EMAIL": "@", "HASHTAG": "#", "MENTION": "@", "DATE": "0-9", "TIME": "0-9", "DURATION": "0-9", "ORDINAL": "0-9",
    "MONEY": "0-9", "PERCENT": "0-9", "CARDINAL": "0-9", "EMOJI": EMOJI[1:-1],
}
_SIGN_SHAPES = {
    "URL": "https?://", "EMOTICON": r"[:;]-?[()]|<3",
    "DATE": "(?i:" + "|".join(lexicon.DATE_WORDS) + ")", "ORDINAL": "(?i:" + "|".join(lexicon.ORDINAL_WORDS) + ")",
}

# Endings that tell a part of speech, and the parts told by shape or by nothing else; all others are the lexicon's alone.
_ENDINGS = {"VERB": ("ing", "ed"), "ADV": ("ly",), "ADJ": ("ble", "ful", "ous")}
_BY_SHAPE = ("NOUN", "PROPN", "NUM", "X", "PUNCT", "SYM")

# Characters of Java's and RE2's ASCII \s, for trimming pieces without a regex.
ASCII_WS = " \t\n\x0b\f\r"


def _extract(text: Column, pattern: str, pattern_no_at: str) -> Column:
    """All matches; texts without an at sign take the shorter, equivalent pattern."""
    return F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit(pattern_no_at), F.lit(0)))


def token_surfaces(text: Column) -> Column:
    """All token surfaces of a text, in order."""
    return _extract(text, TOKEN, TOKEN_NO_AT)


def token_pieces(text: Column) -> Column:
    """Tokens with the whitespace around them; joined, the pieces give the text back."""
    return _extract(text, rf"\s*(?:{TOKEN})\s*", rf"\s*(?:{TOKEN_NO_AT})\s*")


def entity_pieces(text: Column) -> Column:
    """Entities, words and other characters with the whitespace around them."""
    return _extract(text, rf"\s*(?:{ENTITY_OR_WORD}|[^\s])\s*", rf"\s*(?:{ENTITY_OR_WORD_NO_AT}|[^\s])\s*")


def _ends(term: Column, least: int, *suffixes: str) -> Column:
    """Whether a term of at least ``least`` characters ends in one of the suffixes."""
    test = F.endswith(term, F.lit(suffixes[0]))
    for suffix in suffixes[1:]:
        test = test | F.endswith(term, F.lit(suffix))
    return test & (F.length(term) >= least)


def _cut(term: Column, n: int) -> Column:
    return F.substring(term, F.lit(1), F.length(term) - n)


def default_pos_lookup(term: Column) -> Column:
    """Part of speech of a lower-cased term in the default lexicon, else null."""
    found = F.when(~term.isin(sorted(lexicon.pos_by_term())), F.lit(None).cast("string"))
    for pos, terms in lexicon.POS_TERMS.items():
        found = found.when(term.isin(terms), F.lit(pos))
    return found


def pos_of(surface: Column) -> Column:
    """N4 with the default lexicon. One argument, so it can be a lambda itself."""
    return pos_given(surface, default_pos_lookup(F.lower(surface)))


def pos_given(surface: Column, known: Column) -> Column:
    """The lexicon's answer first, then shape, then suffix, then NOUN."""
    term = F.lower(surface)
    by_suffix = (
        F.when(~F.substring(term, -2, 2).isin("ng", "ed", "ly", "le", "ul", "us"), F.lit("NOUN"))  # most words end here
        .when(_ends(term, 5, "ing") | _ends(term, 4, "ed"), F.lit("VERB"))
        .when(_ends(term, 4, "ly"), F.lit("ADV"))
        .when(_ends(term, 5, "ble", "ful", "ous"), F.lit("ADJ"))
        .otherwise(F.lit("NOUN"))
    )
    word = F.when(surface.rlike(r"^\p{Lu}"), F.lit("PROPN")).otherwise(by_suffix)
    other = (
        F.when(surface.rlike(r"^[0-9]"), F.lit("NUM"))
        .when(surface.rlike(rf"^(?:{URL}|{EMAIL}|[#@][A-Za-z0-9_])"), F.lit("X"))
        .when(surface.rlike(r"^\p{P}"), F.lit("PUNCT"))
        .when(~surface.rlike(r"^\p{L}"), F.lit("SYM"))
        .otherwise(word)
    )
    # What begins with a to z and is no URL or e-mail is a word, told without a regex.
    plain = (surface >= "a") & (surface < "{") & ~F.contains(surface, F.lit("@")) & ~F.contains(surface, F.lit(":"))
    shape = F.when(plain, by_suffix).when(surface.rlike(r"^\p{L}[\p{L}\p{M}]*\z"), word).otherwise(other)
    return F.coalesce(known, shape)


def pos_breadth(pos: str) -> int:
    """How much ``may_be`` lets through: 0 for words of the lexicon, 1 for endings too, 2 for everything."""
    return 2 if pos in _BY_SHAPE else 1 if pos in _ENDINGS else 0


def may_be(term: Column, pos: str) -> Column:
    """A cheap test that every lower-cased term passes whose part of speech by ``pos_of`` is this one."""
    if pos in _BY_SHAPE:
        return F.lit(True)
    tests = [term.isin(lexicon.POS_TERMS[pos])] if pos in lexicon.POS_TERMS else []
    tests += [F.endswith(term, F.lit(e)) for e in _ENDINGS.get(pos, ())]
    return reduce(Column.__or__, tests, F.lit(False))


def lemma_heads(lemmas: Iterable[str]) -> set[str]:
    """Beginnings, one of which every lower-cased term has whose lemma is among these: a lemma less its last character, or an irregular form."""
    return {lemma[:-1] for lemma in lemmas} | {form for form, lemma in lexicon.IRREGULAR_LEMMAS.items() if lemma in lemmas}


def has_lemma(surface: Column, low: Column, lemmas: Iterable[str]) -> Column:
    """Whether the lemma of a surface form, ``low`` in lower case, is among these; forms that begin otherwise are not reduced."""
    heads = lemma_heads(lemmas)
    same = lemma_of(surface).isin(sorted(lemmas))
    return same if "" in heads or len(heads) > 64 else reduce(Column.__or__, [F.startswith(low, F.lit(h)) for h in sorted(heads)]) & same


def default_lemma_lookup(term: Column) -> Column:
    found = F.when(~term.isin(sorted(lexicon.IRREGULAR_LEMMAS)), F.lit(None).cast("string"))
    for lemma in sorted(set(lexicon.IRREGULAR_LEMMAS.values())):
        forms = [w for w, l in lexicon.IRREGULAR_LEMMAS.items() if l == lemma]
        found = found.when(term.isin(forms), F.lit(lemma))
    return found


def lemma_of(surface: Column) -> Column:
    """N5 with the default lexicon. One argument, so it can be a lambda itself."""
    return lemma_given(surface, default_lemma_lookup(F.lower(surface)))


def lemma_given(surface: Column, known: Column) -> Column:
    """The lexicon's irregular form first, then one inflection suffix off."""
    term = F.lower(surface)
    inflected = (
        F.when(~F.substring(term, -1, 1).isin("s", "g", "d"), term)  # most words end here
        .when(_ends(term, 6, "ies"), F.concat(_cut(term, 3), F.lit("y")))
        .when(_ends(term, 6, "sses", "shes", "ches") | _ends(term, 5, "xes", "zes"), _cut(term, 2))
        .when(_ends(term, 2, "ss", "us", "is"), term)
        .when(_ends(term, 4, "s"), _cut(term, 1))
        .when(_ends(term, 7, "ing"), _cut(term, 3))
        .when(_ends(term, 6, "ed"), _cut(term, 2))
        .otherwise(term)
    )
    return F.coalesce(known, inflected)


def may_hold_entity(text: Column) -> Column:
    """A cheap test that every text with an entity passes: signs are looked for one kind after the other, words without an expression."""
    words = F.lit(sorted(lexicon.DATE_WORDS + lexicon.ORDINAL_WORDS))
    signs = [text.rlike("[0-9@#]"), F.contains(text, F.lit("http")), F.contains(text, F.lit("<3")), text.rlike(r"[:;]-?[()]"), text.rlike(EMOJI)]
    return reduce(Column.__or__, signs) | let(F.lower(text), lambda low: F.exists(words, lambda w: F.contains(low, w)))


def _is_plain(piece: Column) -> Column:
    """A scanned piece that begins with a to z and is no URL or e-mail is a word, told without a regex."""
    return (piece >= "a") & (piece < "{") & ~F.contains(piece, F.lit("@")) & ~F.contains(piece, F.lit(":"))


def may_be_entity(piece: Column) -> Column:
    """A cheap test that every scanned piece with a type by ``entity_type_of`` passes."""
    return ~_is_plain(piece) | F.lower(piece).isin(lexicon.DATE_WORDS + lexicon.ORDINAL_WORDS)


def holds_word(low: Column, words: Sequence[str]) -> Column:
    """A cheap test that every lower-cased text passes of whose tokens one is among these lower-cased words.

    Before and after a token of letters a to z stands none of them.
    """
    held = F.exists(F.lit(sorted(words)), lambda w: F.contains(low, w))
    if not words or not all(re.fullmatch("[a-z]+", w) for w in words):
        return held
    return held & low.rlike("(?<![a-z])(?:" + "|".join(sorted(words)) + ")(?![a-z])")


def entity_type_of(piece: Column) -> Column:
    """The type of one scanned piece; null for an ordinary word."""
    term = F.lower(piece)
    plain = _is_plain(piece)
    kind = F.when(plain | piece.rlike(rf"^(?:{WORD})$"), F.when(
        term.isin(lexicon.DATE_WORDS), F.lit("DATE")).when(
        term.isin(lexicon.ORDINAL_WORDS), F.lit("ORDINAL")))
    for name, shape in ENTITY_SHAPES:
        kind = kind.when(piece.rlike(rf"^(?:{shape})$"), F.lit(name))
    return kind


def entity_types(text: Column) -> Column:
    """The distinct entity types of a text, computed within the row."""
    pieces = F.array_distinct(_extract(text, ENTITY_OR_WORD, ENTITY_OR_WORD_NO_AT))
    types = F.array_compact(F.array_distinct(F.transform(pieces, entity_type_of)))
    return F.when(may_hold_entity(text), types).otherwise(F.array().cast("array<string>"))


def entity_signs(wanted: Iterable[str]) -> str:
    """An expression that is found in every text with an entity of a wanted type; empty if there is no such type."""
    chars = "".join(sorted({_SIGNS[t] for t in wanted if t in _SIGNS}))
    return "|".join([f"[{chars}]"] * bool(chars) + sorted({_SIGN_SHAPES[t] for t in wanted if t in _SIGN_SHAPES}))


def entity_types_among(text: Column, wanted: Sequence[str]) -> Column:
    """As ``entity_types``, but of types other than those ``wanted`` some may be missing.

    No entity goes past its line, so only lines with a sign of a wanted type are scanned.
    """
    signs = entity_signs(wanted)
    none = F.array().cast("array<string>")
    if not signs:
        return none
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(signs))
    return F.when(text.rlike(signs), let(F.array_join(lines, "\n"), entity_types)).otherwise(none)


# --- Stemming (Porter 1980) -----------------------------------------------------

# The published suffix tables of steps 2, 3 and 4.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
          "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
          "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _shape(word: Column) -> Column:
    """The consonant/vowel string of a word; y is a vowel after a consonant.

    A word begins as after a vowel. Each turn settles the first y of every run of them.
    """
    classes = "".join("v" if ch in "aeiou" else "y" if ch == "y" else "c" for ch in _LETTERS)
    ys = F.length(word) - F.length(F.replace(word, F.lit("y"), F.lit("")))
    settle = lambda s, _: F.replace(F.replace(s, F.lit("cy"), F.lit("cv")), F.lit("vy"), F.lit("vc"))
    marked = F.concat(F.lit("v"), F.translate(word, _LETTERS, classes))
    return F.right(F.aggregate(F.sequence(F.lit(0), ys), marked, settle), F.length(word))


def _cut(word: Column, n: Column | int) -> Column:
    return F.left(word, F.length(word) - n)


def _measure(shape: Column) -> Column:
    return F.regexp_count(shape, F.lit("v+c+"))


def _ends_cvc(word: Column, shape: Column) -> Column:
    return shape.endswith("cvc") & ~word.rlike("[wxy]$")


def _tidied(word: Column, shape: Column) -> Column:
    """A word that has lost its -ed or -ing."""
    doubled = (F.substring(word, -1, 1) == F.substring(word, -2, 1)) & shape.endswith("c")
    return (F.when(word.rlike("(?:at|bl|iz)$"), F.concat(word, F.lit("e")))
            .when(doubled & ~word.rlike("[lsz]$"), _cut(word, 1))
            .when((_measure(shape) == 1) & _ends_cvc(word, shape), F.concat(word, F.lit("e")))
            .otherwise(word))


def _without_plural(word: Column) -> Column:
    return F.when(word.rlike("(?:sses|ies)$"), _cut(word, 2)).when(word.rlike("(?:^|[^s])s$"), _cut(word, 1)).otherwise(word)


def _without_past(word: Column, shape: Column) -> Column:
    tidy = lambda n: let(_cut(word, n), lambda w: _tidied(w, F.left(shape, F.length(w))))
    return (F.when(word.endswith("eed"), F.when(_measure(_cut(shape, 3)) > 0, _cut(word, 1)).otherwise(word))
            .when(word.endswith("ed"), F.when(_cut(shape, 2).contains("v"), tidy(2)).otherwise(word))
            .when(word.endswith("ing"), F.when(_cut(shape, 3).contains("v"), tidy(3)).otherwise(word))
            .otherwise(word))


def _with_i(word: Column, shape: Column) -> Column:
    return F.when(word.endswith("y") & _cut(shape, 1).contains("v"), F.concat(_cut(word, 1), F.lit("i"))).otherwise(word)


def _longest(word: Column, suffixes: Iterable[str]) -> Column:
    """The longest of ``suffixes`` that a word ends in, or an empty string."""
    return F.regexp_extract(word, "(?:" + "|".join(suffixes) + ")$", 0)


def _replaced(table: dict[str, str]) -> Callable[[Column, Column], Column]:
    endings = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def step(word: Column, shape: Column) -> Column:
        return let(_longest(word, table), lambda end: F.when(
            (end != "") & (_measure(_cut(shape, F.length(end))) > 0),
            F.concat(_cut(word, F.length(end)), F.element_at(endings, end))).otherwise(word))
    return step


def _without_suffix(word: Column, shape: Column) -> Column:
    return let(_longest(word, _STEP4), lambda end: F.when(
        (end != "") & (_measure(_cut(shape, F.length(end))) > 1) & ((end != "ion") | word.rlike("[st]ion$")),
        _cut(word, F.length(end))).otherwise(word))


def _without_e(word: Column, shape: Column) -> Column:
    m = _measure(_cut(shape, 1))
    goes = (m > 1) | ((m == 1) & ~_ends_cvc(_cut(word, 1), _cut(shape, 1)))
    return F.when(word.endswith("e") & goes, _cut(word, 1)).otherwise(word)


def _without_double_l(word: Column, shape: Column) -> Column:
    return F.when(word.endswith("ll") & (_measure(shape) > 1), _cut(word, 1)).otherwise(word)


def _applied(step: Callable[[Column, Column], Column], word: Column) -> Column:
    return let(word, lambda w: let(_shape(w), lambda s: step(w, s)))


def porter_stem(term: Column) -> Column:
    """The stem of a lower-cased term; terms other than three letters a-z or more are left as they are."""
    word = _without_plural(term)
    for step in (_without_past, _with_i, _replaced(_STEP2), _replaced(_STEP3), _without_suffix, _without_e, _without_double_l):
        word = _applied(step, word)
    return F.when(term.rlike(r"^[a-z]{3,}\z"), word).otherwise(term)
