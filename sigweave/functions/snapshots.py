"""Reduced forms of a capture: for sharing and for storage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigweave.functions.text import clip

INT32 = (-2_147_483_648, 2_147_483_647)


def limited_map(pairs: Column, count: int, key_chars: int, value_chars: int, drop: tuple[str, ...] = ()) -> Column:
    """First ``count`` pairs by key, keys and values cut; ``drop`` names left out."""
    keys = F.array_sort(F.map_keys(pairs))
    if drop:
        keys = F.filter(keys, lambda k: ~F.lower(k).isin(*drop))
    kept = F.slice(keys, 1, count)
    cut = F.transform(kept, lambda k: clip(k, key_chars))
    # When cutting makes two keys equal, the later one has the value.
    last = F.filter(
        F.transform(kept, lambda k, i: F.struct(clip(k, key_chars).alias("name"), i.alias("ix"), k.alias("key"))),
        lambda e: ~F.array_contains(F.slice(cut, e["ix"] + 2, count), e["name"]),
    )
    return F.map_from_entries(F.transform(
        last, lambda e: F.struct(e["name"], clip(F.coalesce(F.try_element_at(pairs, e["key"]).cast("string"), F.lit("")), value_chars))))


def limited_list(values: Column, count: int, chars: int) -> Column:
    return F.transform(F.slice(F.coalesce(values, F.array()), 1, count), lambda v: clip(v, chars))


def redacted() -> list[Column]:
    """Columns that may leave the system: no cookies, everything bounded."""
    return [
        F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.col("status"),
        limited_map(F.col("headers"), 50, 200, 500, ("set-cookie",)).alias("headers"),
        limited_map(F.col("meta"), 100, 200, 500).alias("meta"),
        limited_list(F.col("scripts"), 100, 500).alias("scripts"),
        F.slice("favicon_hashes", 1, 20).alias("favicon_hashes"),
        limited_map(F.col("js"), 100, 200, 500).alias("js"),
        limited_map(F.col("dom_hits"), 100, 200, 20).alias("dom_hits"),
    ]


def repair_hashes(values: Column) -> Column:
    """Whole numbers in the 32-bit range; numeric text is accepted."""
    numbers = F.transform(F.slice(values, 1, 64), lambda v: F.when(v.cast("string").rlike("\\A-?\\d+\\z"), v.try_cast("bigint")))
    return F.transform(F.filter(numbers, lambda n: n.between(*INT32)), lambda n: n.cast("int"))


def repair_flags(values: Column) -> Column:
    """Booleans, also where they were stored as text; anything else is dropped."""
    kept = F.map_filter(values, lambda _k, v: F.lower(v.cast("string")).isin("true", "false"))
    short = F.map_from_entries(F.slice(F.array_sort(F.map_entries(kept)), 1, 200))
    return F.transform_values(short, lambda _k, v: v.cast("string") == "true")


def compact() -> list[Column]:
    """Columns of a stored capture, every field bounded."""
    return [
        clip(F.coalesce("url", F.lit("")), 4_000).alias("url"), clip(F.coalesce("title", F.lit("")), 2_000).alias("title"),
        clip(F.coalesce("body", F.lit("")), 80_000).alias("body"), F.col("status"),
        limited_map(F.col("headers"), 50, 200, 1_000).alias("headers"),
        limited_map(F.col("meta"), 100, 200, 1_000).alias("meta"),
        limited_list(F.col("scripts"), 100, 2_000).alias("scripts"),
        repair_hashes(F.col("favicon_hashes")).alias("favicon_hashes"),
        limited_map(F.col("js"), 200, 300, 1_000).alias("js"),
        repair_flags(F.col("dom_hits")).alias("dom_hits"),
    ]
