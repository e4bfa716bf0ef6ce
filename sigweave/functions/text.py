"""Text helpers shared by the feature columns and the matchers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it (trimming) and as RE2 does (\s).
UNICODE_SPACE = (
    "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
)
RE2_SPACE = "\\t\\n\\f\\r "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def extract(text: Column, pattern: Column, group: Column | int) -> Column:
    """``regexp_extract`` with a pattern column."""
    return F.call_function("regexp_extract", text, pattern, group if isinstance(group, Column) else F.lit(group))


def quoted(text: str) -> str:
    """A Java pattern that matches ``text`` literally."""
    return "".join(ch if ch.isalnum() else f"\\x{{{ord(ch):x}}}" for ch in text)


def lower_text(text: Column) -> Column:
    """Lower case by single characters: no final-sigma rule, dotted I becomes i."""
    return F.lower(F.replace(F.replace(text, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"\\A[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+\\z", "")


def clip(text: Column, size: int) -> Column:
    """First ``size`` characters."""
    return F.substring(text, 1, size)


def clip_with_mark(text: Column, size: int) -> Column:
    """First ``size`` characters, an ellipsis showing that something was cut."""
    return F.when(F.length(text) > size, F.concat(clip(text, size), F.lit("…"))).otherwise(text)


def map_text(pairs: Column) -> Column:
    """``key: value`` lines in key order; the empty map gives the empty text."""
    lines = F.transform(
        F.array_sort(F.map_keys(pairs)), lambda k: F.concat(k, F.lit(": "), F.coalesce(F.try_element_at(pairs, k), F.lit("")), F.lit("\n"))
    )
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def slug(name: Column) -> Column:
    """Identifier from a name: a-z, 0-9 and Han stay, other runs become one dash."""
    dashed = F.regexp_replace(F.lower(trim_space(name)), "[^a-z0-9\\p{IsHan}]+", "-")
    return F.regexp_replace(dashed, "\\A-+|-+\\z", "")


def may_match(literals: tuple[str, ...], lowered: Column) -> Column:
    """Cheap test before a pattern is run: whether the lower-case text holds one
    of the literals every match contains. The long s may stand for an s."""
    if not literals or len(literals) > 4:
        return F.lit(True)
    held = [F.contains(lowered, F.lit(text)) for text in literals]
    if any("s" in text for text in literals):
        held.append(F.contains(lowered, F.lit("ſ")))
    return reduce(Column.__or__, held)
