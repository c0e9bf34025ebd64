"""Scalar text expressions: trimming, slugs, titles, rule ids, hashes.

Everything here is a Catalyst column expression; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a note editor's trim() drops. Java's \s knows only
# the ASCII ones, so the set is spelled out (the notation also suits RE2).
WS_CHARS = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WS = f"[{WS_CHARS}]"
# The same set as a plain string, for trimming without a regular expression.
WS_TEXT = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def no_strings() -> Column:
    """An empty array of strings."""
    return F.array().cast("array<string>")


def trim_ws(text: Column) -> Column:
    """Drop leading and trailing whitespace, newlines and Unicode spaces included."""
    return F.btrim(text, F.lit(WS_TEXT))


def regex_escape(text: Column) -> Column:
    """Quote every character that is special in a regular expression."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\/#&~<>=!:-])", r"\\$1")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def title(text: Column) -> Column:
    """the first line, trimmed."""
    return trim_ws(first_line(text))


def slug(text: Column) -> Column:
    """up to five words of the first line, joined by hyphens; ``note`` if none."""
    kept = F.regexp_replace(F.lower(first_line(text)), rf"[^a-z0-9{WS_CHARS}]", "")
    words = F.slice(F.split(trim_ws(kept), f"{WS}+", -1), 1, 5)
    joined = F.array_join(words, "-")
    return F.when(joined == "", F.lit("note")).otherwise(joined)


def rule_id(rule_type: Column, match: Column) -> Column:
    """``<type>-<slugged match>``; cut to 50 characters after hyphen trimming."""
    dashed = F.regexp_replace(F.lower(match), "[^a-z0-9]+", "-")
    body = F.substring(F.regexp_replace(dashed, r"^-|-\z", ""), 1, 50)
    return F.concat(rule_type, F.lit("-"), body)


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hexadecimal."""
    return F.sha2(text, 256)
