"""Streams of captures and of the events around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.operators.reports import HISTORY_MAX, hits_per_capture, newest
from sigweave.plans.detect import detect
from sigweave.session import spread
from sigweave.sources.pack import RulePack
from sigweave.streaming.runtime import each_batch
from sigweave.streaming.tables import KeyedTable, RuleVersions, read_table

# Fixed value: quiet time after which rule changes count.
RULE_GAP = "500 milliseconds"


def match_stream(captures: DataFrame, pack: RulePack, out: str, state: str, dictionary: DataFrame | None = None, custom: DataFrame | None = None) -> None:
    """Detect on every new capture; hits are appended under their batch number,
    so a batch that is repeated after a failure replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        detect(spread(batch), pack, dictionary, custom).write.mode("overwrite").parquet(f"{out}/batch={number}")

    each_batch(captures, write, state)


def latest_captures(out: str) -> KeyedTable:
    """Newest capture per tab. The table is the only state, so a capture may come as late
    as it likes and a stream may start over."""
    return KeyedTable(out, ["tab_id"], ["at", "capture_id"])


def current_responses(out: str) -> KeyedTable:
    """Response of the newest navigation per tab; a late answer to an older
    navigation changes nothing, a later answer of the same one replaces it."""
    return KeyedTable(out, ["tab_id"], ["nav_seq", "at", "status"])


def keep_newest(rows: DataFrame, table: KeyedTable, state: str) -> None:
    """Merge a stream into a table of current rows."""
    each_batch(rows, table.writer(state), state)


def history_table(out: str) -> KeyedTable:
    """Newest scan per address; no bucket holds more than a history may show."""
    return KeyedTable(out, ["url"], ["at", "capture_id"], keep=HISTORY_MAX)


def history_stream(scans: DataFrame, table: KeyedTable, state: str) -> None:
    """Latest scan per address."""
    keep_newest(scans.where("url <> ''"), table, state)


def read_history(table: KeyedTable, spark, limit: int | None = None) -> DataFrame:
    return newest(table.read(spark), limit)


def rematch_stream(settled: DataFrame, captures: DataFrame, pack: RulePack, table: KeyedTable, state: str,
                   dictionary: DataFrame | None = None, custom: DataFrame | None = None) -> None:
    """Match the page of a tab again with the icons the tab has gathered (the rows of
    ``settled_icons``), and keep the hits of each tab's newest match.

    Only captures named by a micro-batch are read and matched. A page that comes to rest
    twice within one is matched once, with all icons.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("tab_id").agg(F.max_by(F.struct("capture_id", "closed_us", "favicon_hashes"), "closed_us").alias("l"))
        last = last.select("tab_id", "l.*").persist()
        if last.isEmpty():
            return
        pages = captures.drop("favicon_hashes", "tab_id").join(last.select("capture_id", "favicon_hashes"), "capture_id")
        hits = hits_per_capture(detect(pages, pack, dictionary, custom))
        rows = last.join(hits, "capture_id", "left").withColumn("hits", F.coalesce("hits", F.array()))
        merge(rows, number)
        last.unpersist()

    merge = table.writer(state)
    each_batch(settled, write, state)


def rematch_table(out: str) -> KeyedTable:
    return KeyedTable(out, ["tab_id"], ["closed_us"])


def settled_changes(changes: DataFrame, late: str = "10 seconds", gap: str = RULE_GAP) -> DataFrame:
    """``(scope, ts, version)``: changes of one scope (rules, dictionary) merged until a quiet
    gap, with the highest version among them. The window's end bounds its state."""
    held = changes.withWatermark("ts", late).groupBy("scope", F.session_window("ts", gap).alias("w"))
    return held.agg(F.count(F.lit(1)).alias("n_changes"), F.max("version").alias("version")).select(
        "scope", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n_changes", "version")


def rescan_stream(settled: DataFrame, captures: Callable[[], DataFrame], rules: RuleVersions, out: str, state: str,
                  dictionary: DataFrame | None = None) -> None:
    """Match all stored captures again once rule changes have come to rest.

    The changes that come to rest in one micro-batch share one match, with the rules of
    the newest version among them, read from the rule table at that time. Hits are kept
    by version of the rules; a match with a version that was matched before replaces its
    hits, so captures that came in between are there too. Nothing is written while no
    change comes to rest; ``read_rescans`` reads that too.
    """

    def write(batch: DataFrame, number: int) -> None:
        version = batch.agg(F.max("version").alias("v")).first()["v"]
        if version is None:
            return
        pack = RulePack.from_table(rules.read(batch.sparkSession, version))
        found = detect(captures(), pack, dictionary).withColumn("version_of_rules", F.lit(version))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_of_rules").parquet(out)

    each_batch(settled, write, state)


def read_rescans(spark: SparkSession, out: str) -> DataFrame:
    """``(version_of_rules, capture_id, rule_id, name, version)`` of the matches written so
    far; no rows where no change has come to rest yet."""
    kind = "capture_id long, rule_id string, name string, version string"
    found = read_table(spark, out, kind + ", version_of_rules int")
    if found is None:
        found = spark.createDataFrame([], kind + ", version_of_rules int")
    return found.select("version_of_rules", "capture_id", "rule_id", "name", "version")
