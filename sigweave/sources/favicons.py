"""Icon dictionaries: hash to product name."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.session import listing

# A dictionary within both is small: as a broadcast it takes some 20 MB of the driver.
SMALL_ROWS = 100_000
SMALL_BYTES = 4 << 20

_small: WeakKeyDictionary[DataFrame, bool] = WeakKeyDictionary()


def is_small(dictionary: DataFrame) -> bool:
    """Whether a dictionary may be broadcast. Its rows are counted, up to the bound and once
    per table: Spark knows but the size of its compressed files, which may hold many times that."""
    if dictionary not in _small:
        held = dictionary.limit(SMALL_ROWS + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).alias("bytes")).first()
        _small[dictionary] = held["rows"] <= SMALL_ROWS and held["bytes"] <= SMALL_BYTES
    return _small[dictionary]


def from_json_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``{"hash": "name"}`` files to ``(hash, name)``, and ``(source, error)`` of files that
    hold no such object."""
    with listing(spark):
        texts = spark.read.text(path, wholetext=True)
    files = texts.select(F.input_file_name().alias("source"), "value")
    bad = F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{")
    return from_json_text(files.where(~bad), "value"), files.where(bad).select("source", F.lit("no object").alias("error"))


def from_json_text(rows: DataFrame, column: str) -> DataFrame:
    pairs = rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "name"))
    return pairs.where(F.col("key").rlike("\\A-?\\d+\\z") & (F.coalesce("name", F.lit("")) != "")).select(
        F.col("key").try_cast("int").alias("hash"), "name").where("hash IS NOT NULL")


def from_lines(rows: DataFrame, column: str) -> DataFrame:
    """``hash name`` lines to ``(hash, name)``; other lines are skipped."""
    line = F.trim(column)
    form = "\\A(-?\\d+)\\s+(.+)\\z"
    return rows.where(line.rlike(form)).select(
        F.regexp_extract(line, form, 1).try_cast("int").alias("hash"), F.trim(F.regexp_extract(line, form, 2)).alias("name")
    ).where("hash IS NOT NULL")
