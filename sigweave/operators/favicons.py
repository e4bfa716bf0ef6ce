"""Favicon hashes against the icon dictionary, and hashes from icon bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.functions.hashing import favicon_hash
from sigweave.session import listing
from sigweave.sources.favicons import is_small

ICON_LEVEL = 1_000_000
#: Parts that the captures of one hash are dealt into.
SHARES = 16


def icon_names(captures: DataFrame, dictionary: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """``(capture_id, hash_ix, hash, name)`` of the hashes with a known name.

    Zeros and repeats are dropped first; a custom name wins over a built-in one.

    Dictionaries of any size are joined by hash with the distinct hashes asked for. Some hashes
    are those of very many captures, so names go back to these by hash and share. Only
    dictionaries known to be small are broadcast.
    """
    hashes = captures.select(
        "capture_id", F.posexplode(F.array_distinct(F.filter("favicon_hashes", lambda h: h != 0))).alias("hash_ix", "hash"),
        F.pmod(F.xxhash64("capture_id"), F.lit(SHARES)).cast("int").alias("share"))
    small = is_small(dictionary) and (custom is None or is_small(custom))
    names = (hashes if small else hashes.select("hash", "share").distinct()).join(_names(dictionary, "built_in"), "hash", "left")
    if custom is None:
        name = F.col("built_in")
    else:
        names = names.join(_names(custom, "own"), "hash", "left")
        name = F.coalesce(F.nullif(F.col("own"), F.lit("")), F.col("built_in"))
    names = names.withColumn("name", name).drop("built_in", "own").where(F.coalesce("name", F.lit("")) != "")
    if not small:
        names = hashes.join(names.hint("merge"), ["hash", "share"])
    return names.select("capture_id", "hash_ix", "hash", "name")


def _names(dictionary: DataFrame, column: str) -> DataFrame:
    return dictionary.select("hash", F.col("name").alias(column)).hint("broadcast" if is_small(dictionary) else "merge")


def add_icons(hits: DataFrame, captures: DataFrame, dictionary: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Append dictionary hits after the rule hits, one per name not yet present."""
    named = icon_names(captures, dictionary, custom)
    evidence = F.array(F.struct(
        F.lit(0).alias("matcher_ix"), F.lit(0).alias("pattern_ix"), F.lit("icon_hash").alias("type"), F.lit("").alias("part"),
        F.concat(F.lit("mmh3 "), F.col("hash").cast("string"), F.lit(" (dictionary)")).alias("detail"), F.lit("").alias("pattern"),
        F.lit("").alias("version")))
    icons = named.select(
        "capture_id", F.lit(None).cast("int").alias("rule_ord"), F.concat(F.lit("icon-"), F.col("hash").cast("string")).alias("rule_id"),
        "name", F.lit(None).cast("int").alias("confidence"), evidence.alias("evidence"), F.lit("").alias("version"),
        F.lit(ICON_LEVEL).alias("level"), F.array("hash_ix").alias("way"))
    columns = [c for c in hits.columns if c not in ("capture_id", "name")]
    both = hits.unionByName(icons).groupBy("capture_id", "name").agg(
        F.collect_list(F.when(F.col("level") < ICON_LEVEL, F.struct(*columns))).alias("own"),
        F.min_by(F.struct(*columns), F.struct("level", "way")).alias("first"),
    )
    kept = F.when(F.size("own") > 0, F.col("own")).otherwise(F.array("first"))
    return both.select("capture_id", "name", F.inline(kept)).select(*hits.columns)


def icon_files(spark: SparkSession, path: str) -> DataFrame:
    """``(capture_id, content)`` of icon files below folders ``capture_id=<id>``; files without
    a byte give no row, as they give no hash.

    Every file costs a listing, so this is for folders of loose icons; ``icon_lines`` reads
    any number.
    """
    with listing(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "/capture_id=([0-9]+)/", 1).try_cast("bigint").alias("capture_id"), "content").where("capture_id IS NOT NULL")


def write_icon_lines(icons: DataFrame, path: str) -> None:
    """``(capture_id, content)`` as lines of id and base64, many icons a file."""
    flat = F.regexp_replace(F.base64("content"), "[\\r\\n]", "")
    icons.select(F.concat(F.col("capture_id").cast("string"), F.lit(" "), flat).alias("value")).where("value IS NOT NULL").write.text(path)


def icon_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(capture_id, content)`` of files that hold an id and base64 in each line; other lines
    and icons without a byte give no row."""
    line = F.split("value", " ", 2)
    rows = spark.read.text(path).select(F.try_element_at(line, F.lit(1)).try_cast("bigint").alias("capture_id"),
                                        F.try_to_binary(F.try_element_at(line, F.lit(2)), F.lit("base64")).alias("content"))
    return rows.where(F.col("capture_id").isNotNull() & (F.octet_length("content") > 0))


def hash_icons(icons: DataFrame) -> DataFrame:
    """``(capture_id, content)`` icon files to distinct non-zero hashes per capture."""
    hashed = icons.select("capture_id", favicon_hash(F.col("content")).alias("hash")).where("hash != 0")
    return hashed.groupBy("capture_id").agg(F.sort_array(F.collect_set("hash")).alias("favicon_hashes"))
