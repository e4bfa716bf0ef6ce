"""HTML features as Column expressions.

Everything here is a projection: one pass over the body, no shuffle. Attribute
lists stay arrays of structs, so no session-wide duplicate-key policy is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.functions.text import RE2_SPACE, UNICODE_SPACE, clip, trim_space

# The patterns that define the feature columns.
TITLE = "(?is)<title[^>]*>(.*?)</title>"
ATTRIBUTE = f"(?is)([\\w-]+)[{RE2_SPACE}]*=[{RE2_SPACE}]*(?:\"([^\"]*)\"|'([^']*)'|([^{RE2_SPACE}>]+))"
FEATURE_TAGS = ("meta", "script", "link", "a")

# What readable text drops, breaks on, and decodes.
HIDDEN_BLOCKS = "(?is)<(script|style|noscript|svg)\\b[\\s\\S]*?</\\1>"
BLOCK_ENDS = "(?i)</(?:p|div|section|article|main|header|footer|li|h[1-6]|tr)>|<br\\s*/?>"
ENTITIES = [
    ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"),
    ("(?i)&quot;", "\""), ("(?i)&#(?:39|x27);", "'"),
]
READABLE_CHARS = 30_000


def title(html: Column) -> Column:
    found = F.regexp_extract(html, TITLE, 1)
    return trim_space(F.regexp_replace(found, f"[{RE2_SPACE}]+", " "))


def title_or_extracted(given: Column, html: Column) -> Column:
    """A title that came with the capture wins over the one in the HTML."""
    return F.coalesce(F.nullif(given, F.lit("")), title(html))


def tags(html: Column, name: str) -> Column:
    """Opening tags of one kind that carry at least one blank, in page order."""
    return F.regexp_extract_all(html, F.lit(f"(?is)<{name}[{RE2_SPACE}][^>]*>"), F.lit(0))


def attributes(tag: Column) -> Column:
    """Attributes of one tag as ``array<struct<name,value>>`` in text order."""
    pick = lambda group: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(group))
    return F.transform(
        F.arrays_zip(pick(1).alias("n"), pick(2).alias("d"), pick(3).alias("s"), pick(4).alias("b")),
        lambda a: F.struct(
            F.lower(a["n"]).alias("name"),
            F.when(a["d"] != "", a["d"]).when(a["s"] != "", a["s"]).otherwise(a["b"]).alias("value"),
        ),
    )


def last_per_name(pairs: Column) -> Column:
    """Keep the last pair of each name, so the list can become a map."""
    return F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda later: later["name"] == p["name"]
        ),
    )


def attribute(pairs: Column, name: str) -> Column:
    """Value of one attribute, later duplicates winning, empty when missing."""
    held = F.filter(pairs, lambda p: p["name"] == name)
    return F.coalesce(F.try_element_at(held, F.lit(-1))["value"], F.lit(""))


def tag_rows(captures: DataFrame, html: str = "body", kinds: tuple[str, ...] = FEATURE_TAGS) -> DataFrame:
    """``(capture_id, tag, ord, pairs)``: one row per opening tag."""
    lists = F.array(*[
        F.struct(F.lit(kind).alias("tag"), tags(F.col(html), kind).alias("found")) for kind in kinds
    ])
    kinds_out = captures.select("capture_id", F.explode(lists).alias("k"))
    rows = kinds_out.select("capture_id", F.col("k.tag").alias("tag"), F.posexplode("k.found").alias("ord", "text"))
    return rows.select("capture_id", "tag", "ord", attributes(F.col("text")).alias("pairs"))


def meta_pairs(html: Column) -> Column:
    """Named meta tags as ``array<struct<name,value>>``, last one per name."""
    named = F.transform(
        F.transform(tags(html, "meta"), attributes),
        lambda a: F.struct(
            F.lower(F.coalesce(F.nullif(attribute(a, "name"), F.lit("")), attribute(a, "property"))).alias("name"),
            attribute(a, "content").alias("value"),
        ),
    )
    return last_per_name(F.filter(named, lambda p: (p["name"] != "") & (p["value"] != "")))


def meta(html: Column) -> Column:
    return F.map_from_entries(meta_pairs(html))


def scripts(html: Column) -> Column:
    found = F.transform(tags(html, "script"), lambda t: attribute(attributes(t), "src"))
    return F.filter(found, lambda v: v != "")


def links(html: Column) -> Column:
    found = F.transform(tags(html, "a"), lambda t: attribute(attributes(t), "href"))
    return F.filter(found, lambda v: v != "")


def favicons(html: Column) -> Column:
    """``href`` of every link tag whose ``rel`` contains ``icon``."""
    found = F.transform(
        F.transform(tags(html, "link"), attributes),
        lambda a: F.when(F.contains(attribute(a, "rel"), F.lit("icon")), attribute(a, "href")).otherwise(""),
    )
    return F.filter(found, lambda v: v != "")


def _numeric_entities(text: Column) -> Column:
    """Decode ``&#N;``: the text around each reference is split off and rejoined."""
    codes = F.regexp_extract_all(text, F.lit("&#(\\d+);"), F.lit(1))
    pieces = F.split(text, "&#\\d+;")
    chars = F.transform(
        codes,
        lambda c: F.decode(
            F.unhex(F.lpad(F.hex(F.coalesce(F.try_to_number(c, F.lit("9999999999")).cast("bigint"), F.lit(0xFFFD))), 8, "0")),
            "UTF-32",
        ),
    )
    joined = F.array_join(
        F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), chars.alias("c")),
                              lambda z: F.array(F.coalesce(z["p"], F.lit("")), F.coalesce(z["c"], F.lit(""))))), "")
    return F.when(text.rlike("&#\\d+;"), joined).otherwise(text)


def readable_text(html: Column) -> Column:
    """Text a reader would see, blanks folded, at most 30,000 characters."""
    text = F.regexp_replace(html, HIDDEN_BLOCKS, " ")
    text = F.regexp_replace(text, BLOCK_ENDS, "\n")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for pattern, char in ENTITIES:
        text = F.regexp_replace(text, pattern, char)
    text = _numeric_entities(text)
    text = F.regexp_replace(text, "[ \\t]+", " ")
    text = F.regexp_replace(text, f"\\n[{UNICODE_SPACE}]+", "\n")
    return clip(trim_space(text), READABLE_CHARS)

