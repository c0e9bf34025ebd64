"""Markdown expressions: front matter, fences, and reading or editing tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, WS_CHARS, WS_TEXT, let, regex_escape, trim_ws

# The tag alphabet and the shapes built from it.
TAG_CHARS = r"a-zA-Z0-9\-_/"
TAG = rf"#([{TAG_CHARS}]+)"
TAG_LINE = rf"^#[{TAG_CHARS}]+(?:{WS}+#[{TAG_CHARS}]+)*+{WS}*\z"
FENCE = r"(?msd)^```.*?\n```[^\n]*"
NO_TAG_CHAR_AHEAD = rf"(?![{TAG_CHARS}])"

# Whitespace other than the newline, for the clean-up patterns.
_BLANK = rf"[{WS_CHARS}&&[^\n]]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def front_matter_line_count(lines: Column) -> Column:
    closing = F.array_position(F.slice(lines, F.lit(2), F.size(lines)), "---")
    is_open = (lines[0] == "---") & (closing > 0)
    return F.when(is_open, closing + 1).otherwise(0).cast("int")


def front_matter_lines(text: Column) -> Column:
    """how many lines the front matter takes, both fences included; 0 if none."""
    return let(_lines(text), front_matter_line_count)


def strip_front_matter(text: Column) -> Column:
    """The text after the front matter's closing line."""
    return let(
        _lines(text),
        lambda lines: F.array_join(
            F.slice(lines, front_matter_line_count(lines) + 1, F.size(lines)), "\n"
        ),
    )


def strip_fences(text: Column) -> Column:
    """the text without its closed fenced blocks."""
    return F.when(F.contains(text, F.lit("```")), F.regexp_replace(text, FENCE, "")).otherwise(text)


def existing_tags(text: Column) -> Column:
    """distinct tags outside fenced blocks, in order of first appearance."""
    found = F.regexp_extract_all(strip_fences(text), F.lit(TAG), F.lit(1))
    return F.when(F.contains(text, F.lit("#")), F.array_distinct(found)).otherwise(
        F.array().cast("array<string>")
    )


def insert_tags(text: Column, tags: Column) -> Column:
    """add tags to the last tag line, or open a new one before trailing blanks."""
    tag_text = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " ")

    def edited(lines: Column) -> Column:
        def last(fits: Callable[[Column, Column], Column]) -> Column:
            """1 + the index of the last trimmed line that fits; 0 if none does."""
            return F.array_max(F.transform(
                lines, lambda line, i: F.when(fits(trim_ws(line), i), i + 1).otherwise(0)))

        def appended(n: Column) -> Column:
            return F.transform(lines, lambda line, i: F.when(
                i + 1 == n, F.concat(trim_ws(line), F.lit(" "), tag_text)).otherwise(line))

        def opened(n: Column) -> Column:
            return F.concat(F.slice(lines, F.lit(1), n), F.array(F.lit(""), tag_text),
                            F.slice(lines, n + 1, F.size(lines)))

        tag_line = let(front_matter_line_count(lines), lambda start: last(
            lambda line, i: (i >= start) & line.rlike(TAG_LINE)))
        return F.array_join(let(tag_line, lambda n: F.when(n > 0, appended(n)).otherwise(
            let(last(lambda line, i: line != ""), opened))), "\n")

    return F.when(F.size(tags) > 0, let(_lines(text), edited)).otherwise(text)


def _delete_compat(text: Column, tags: Column) -> Column:
    """Delete tags one after the other, each up to an ASCII word boundary."""
    def pattern(tag: Column) -> Column:
        boundary = F.when(tag.rlike(r"[A-Za-z0-9_]\z"), F.lit("(?![A-Za-z0-9_])")).otherwise(
            F.lit("(?=[A-Za-z0-9_])"))
        return F.concat(F.lit("#"), regex_escape(tag), boundary)

    return F.aggregate(tags, text, lambda acc, tag: F.regexp_replace(acc, pattern(tag), F.lit("")))


def delete_tags(text: Column, tags: Column, compat: bool = False) -> Column:
    """Cut the tags out of the text, with no clean-up of what is left."""
    if compat:
        return _delete_compat(text, tags)
    names = F.array_join(F.transform(tags, regex_escape), "|")
    pattern = F.concat(F.lit("#(?:"), names, F.lit(")" + NO_TAG_CHAR_AHEAD))
    return F.when(F.size(tags) > 0, F.regexp_replace(text, pattern, F.lit(""))).otherwise(text)


def squeeze_line_ends(text: Column) -> Column:
    """Whitespace before a newline becomes that newline (blank lines collapse).

    Line by line: all but the last lose the blanks at their end, and empty ones between the first and the last go.
    """
    def squeezed(lines: Column) -> Column:
        last = F.size(lines) - 1
        trimmed = F.transform(lines, lambda line, i: F.when(i == last, line).otherwise(F.rtrim(line, F.lit(WS_TEXT))))
        return F.array_join(F.filter(trimmed, lambda line, i: (i == 0) | (i == last) | (line != "")), "\n")

    return let(_lines(text), squeezed)


def remove_tags(text: Column, tags: Column, compat: bool = False) -> Column:
    """delete tags, then collapse blank lines and trailing newlines.

    By default ``#work`` leaves ``#work/x`` and ``#work-life`` alone; ``compat``
    cuts at the next ASCII word boundary instead.
    """
    return F.when(F.size(tags) > 0, squeeze_line_ends(delete_tags(text, tags, compat))).otherwise(text)


def bulk_remove_tags(text: Column, tags: Column, compat: bool = False) -> Column:
    """G9's text: delete tags, shorten the blank tail, collapse blank lines."""
    tail = rf"(?<!{WS})({_BLANK}*+)\n{_BLANK}*+\n{WS}*+\z"
    return squeeze_line_ends(
        F.regexp_replace(delete_tags(text, tags, compat), tail, "$1\n"))


