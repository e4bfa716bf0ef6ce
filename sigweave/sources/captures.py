"""Page captures: load, complete, bound, and prepare the texts to match on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.functions import html
from sigweave.functions.text import clip, lower_text, map_text
from sigweave.schema import CAPTURE_FIELDS, PARTS

# Fixed value: where a capturing client cuts a body. Stored bodies are read whole.
BODY_CHARS = 200_000


def bounded_body(body: Column) -> Column:
    return clip(F.coalesce(body, F.lit("")), BODY_CHARS)


def _empty(kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.lit(0).cast(kind)


def complete(pages: DataFrame, bounded: bool = False) -> DataFrame:
    """Give a page table every capture column with its fixed type.

    Bodies stay whole unless ``bounded`` asks for the cut of a capturing client.

    ``page_id`` and ``html`` are read as ``capture_id`` and ``body``. Columns the
    table lacks become empty values; other columns are kept at the end.
    """
    renamed = pages
    for old, new in (("page_id", "capture_id"), ("html", "body")):
        if old in renamed.columns and new not in renamed.columns:
            renamed = renamed.withColumnRenamed(old, new)
    have = set(renamed.columns)
    columns = []
    for name, kind in CAPTURE_FIELDS.items():
        given = F.coalesce(F.col(name).cast(kind), _empty(kind)) if name in have else _empty(kind)
        if name == "body" and bounded:
            given = bounded_body(given)
        columns.append(given.alias(name))
    rest = [F.col(c) for c in renamed.columns if c not in CAPTURE_FIELDS]
    return renamed.select(*columns, *rest)


def load_captures(spark: SparkSession, path: str, bounded: bool = False) -> DataFrame:
    return complete(spark.read.parquet(path), bounded)


def enrich(captures: DataFrame) -> DataFrame:
    """Fill title, meta and scripts from the HTML of the capture itself."""
    body = F.col("body")
    return captures.withColumns({
        "title": html.title_or_extracted(F.col("title"), body),
        "meta": html.meta(body),
        "scripts": html.scripts(body),
        "links": html.links(body),
    })


def merge_headers(header_rows: DataFrame) -> DataFrame:
    """``(capture_id, ord, name, value)`` rows to one map per capture.

    A header that repeats keeps every occurrence as a ``name: value`` line of its
    own, so a line-anchored pattern can meet any of them.
    """
    named = header_rows.withColumn("name", F.lower("name"))
    per_name = named.groupBy("capture_id", "name").agg(
        F.sort_array(F.collect_list(F.struct("ord", "value"))).alias("held")
    )
    text = F.array_join(
        F.transform("held", lambda h, i: F.when(i == 0, h["value"]).otherwise(F.concat(F.col("name"), F.lit(": "), h["value"]))),
        "\n",
    )
    return per_name.groupBy("capture_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("name"), text))).alias("headers")
    )


def part_text(part: str) -> Column:
    body = F.coalesce(F.col("body"), F.lit(""))
    if part == "header":
        return map_text(F.col("headers"))
    if part == "meta":
        return map_text(F.col("meta"))
    if part == "script":
        return F.coalesce(F.array_join("scripts", "\n"), F.lit(""))
    if part == "raw":
        return F.concat(map_text(F.col("headers")), body)
    return F.coalesce(F.col(part), F.lit("")) if part in ("title", "url") else body


def parts(captures: DataFrame, wanted: Sequence[str] = PARTS, key: str = "capture_id") -> DataFrame:
    """``(capture_id, part, text, lower_text)``, only for parts some rule needs.

    The rows come out of a projection, so nothing is shuffled and columns that no
    wanted part uses are not read.
    """
    rows = F.array(*[
        F.struct(F.lit(p).alias("part"), part_text(p).alias("text")) for p in PARTS if p in wanted
    ])
    return captures.select(key, F.inline(rows)).withColumn("lower_text", lower_text(F.col("text")))


def runtime_values(paths: Sequence[str]) -> Column:
    """Keep the requested runtime paths: at most 200, values cut at 120."""
    asked = list(dict.fromkeys(p for p in paths if 0 < len(p) <= 200))[:200]
    kept = F.map_filter("js", lambda k, v: k.isin(*asked) & v.isNotNull()) if asked else F.create_map().cast("map<string,string>")
    return F.transform_values(kept, lambda _k, v: clip(v, 120))
