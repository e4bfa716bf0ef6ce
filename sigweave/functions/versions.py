"""Version templates as Column expressions.

A template mixes text with ``\\N`` (text of group N) and ``\\N?yes:no`` (rest of
the template, chosen by whether group N is empty). Templates belong to rules and
are known when rules load, so each one becomes an expression over the array of
captured groups instead of code that runs per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigweave.functions.text import clip, trim_space

VERSION_CHARS = 120
_REFERENCE = re.compile(r"\\(\d+)")


def group_numbers(template: str) -> list[int]:
    return [int(n) for n in _REFERENCE.findall(template)]


def _expand(template: str, groups: Column) -> Column:
    ref = _REFERENCE.search(template)
    if not ref:
        return F.lit(template)
    captured = F.coalesce(F.try_element_at(groups, F.lit(int(ref.group(1)) + 1)), F.lit("")) \
        if int(ref.group(1)) < 1000 else F.lit("")
    before, after = template[: ref.start()], template[ref.end():]
    choice = re.match(r"\?([^:]*):(.*)\Z", after, re.S)
    if choice:
        tail = F.when(captured != "", _expand(choice.group(1), groups)).otherwise(_expand(choice.group(2), groups))
        return F.concat(F.lit(before), tail)
    return F.concat(F.lit(before), captured, _expand(after, groups))


def expand(template: str, groups: Column) -> Column:
    """Version text for one template; control characters removed, 120 kept."""
    if not template:
        return F.lit("")
    return clip(F.regexp_replace(trim_space(_expand(template, groups)), "\\p{Cc}", ""), VERSION_CHARS)


def expand_column(template: Column, groups: Column, known: Iterable[str]) -> Column:
    """Version for a template column whose distinct values are ``known``."""
    out = F.lit("")
    for text in sorted({t for t in known if t}):
        out = F.when(template == text, expand(text, groups)).otherwise(out)
    return out
