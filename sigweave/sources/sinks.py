"""Report layouts and their writers.

Layouts are DataFrames, so a caller may write them anywhere; the writers only add
the format options.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Report columns.
HISTORY_CSV = (
    "time", "source", "url", "title", "status", "favicon_hash", "fingerprint_id", "fingerprint_name", "version",
    "confidence", "matcher", "location", "matched", "expression",
)
BATCH_CSV = (
    "requested_url", "final_url", "title", "status", "total_hits", "fingerprint_id", "fingerprint_name", "version",
    "confidence", "error",
)


def iso_time(at: Column) -> Column:
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def history_report(history: DataFrame) -> DataFrame:
    """Nested report rows: timestamp, source, target, detections."""
    return history.select(
        iso_time(F.col("at")).alias("timestamp"), "source",
        F.struct("url", "title", "status", F.col("favicon_hashes").alias("faviconHashes")).alias("target"),
        F.col("hits").alias("detections"))


def history_table(history: DataFrame) -> DataFrame:
    """Flat report: one row per evidence; scans and hits without any still show."""
    none = F.lit("")
    base = history.select(
        iso_time(F.col("at")).alias("time"), "source", "url", "title", F.col("status").cast("string").alias("status"),
        F.array_join(F.transform("favicon_hashes", lambda h: h.cast("string")), " ").alias("favicon_hash"),
        F.explode_outer("hits").alias("hit"))
    rows = base.select("*", F.explode_outer("hit.evidence").alias("e"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), none)
    return rows.select(
        "time", "source", "url", "title", "status", "favicon_hash",
        text("hit.id").alias("fingerprint_id"), text("hit.name").alias("fingerprint_name"), text("hit.version").alias("version"),
        text("hit.confidence").alias("confidence"), text("e.matcher").alias("matcher"), text("e.location").alias("location"),
        text("e.matched").alias("matched"), text("e.expression").alias("expression"))


def batch_table(results: DataFrame, failures: DataFrame) -> DataFrame:
    """Flat batch report: results by hit, then failures ``(url, error)``."""
    none = F.lit("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), none)
    done = results.select("requested_url", "final_url", "title", F.col("status").cast("string").alias("status"),
                          F.col("total_hits").cast("string").alias("total_hits"), F.explode_outer("hits").alias("hit"))
    rows = done.select(
        "requested_url", "final_url", "title", "status", "total_hits", text("hit.id").alias("fingerprint_id"),
        text("hit.name").alias("fingerprint_name"), text("hit.version").alias("version"), text("hit.confidence").alias("confidence"),
        none.alias("error"))
    failed = failures.select(
        F.col("url").alias("requested_url"), *[none.alias(c) for c in BATCH_CSV[1:-1]], F.substring("error", 1, 300).alias("error"))
    return rows.unionByName(failed)


def batch_report(counters: DataFrame, results: DataFrame, failures: DataFrame) -> DataFrame:
    """Batch report as JSON lines of three kinds: counters, result, failure.

    Results stay rows of their own, because a batch may be far larger than what
    one document, and so one task, can hold.
    """
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("value"))
    named = results.select(
        F.col("requested_url").alias("requestedUrl"), F.col("final_url").alias("finalUrl"), "title", "status",
        F.col("total_hits").alias("totalHits"), F.col("hits").alias("detections"))
    return line(counters, "counters").unionByName(line(named, "result")).unionByName(line(failures, "failure"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "lineSep", "\r\n").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A written report as text columns; empty fields are empty texts."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema(
        ", ".join(f"{c} string" for c in columns)).csv(path)
    return rows.fillna("")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """A ``value`` column as text lines: reports of JSON lines, exported rules."""
    rows.select("value").write.mode("overwrite").text(path)
