"""Rollups over hits and scans: counters, groups, rankings, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.functions import urls
from sigweave.functions.text import clip

# How much of a result is shown or kept.
DISPLAY_HITS, DISPLAY_EVIDENCE, DISPLAY_DETAIL = 100, 6, 240
BATCH_HITS = 20
HISTORY_DEFAULT, HISTORY_MIN, HISTORY_MAX = 300, 50, 5000
RULE_LIST_ROWS = 300

HIT_ORDER = ("level", "way", "rule_id")


def hits_per_capture(hits: DataFrame) -> DataFrame:
    """``(capture_id, hits)`` with hits in order. A capture has at most one hit
    per rule, implied name and icon, so the list is bounded by the pack."""
    row = F.struct(*HIT_ORDER, "name", "version", "confidence", "evidence")
    return hits.groupBy("capture_id").agg(F.array_sort(F.collect_list(row)).alias("hits"))


def hit_counts(captures: DataFrame, hits: DataFrame) -> DataFrame:
    counted = hits.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return captures.select("capture_id").join(counted, "capture_id", "left").select(
        "capture_id", F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"))


def tech_prevalence(hits: DataFrame) -> DataFrame:
    """Captures per technology; repeats within a capture are merged first, so no
    group ever holds more than partial counts."""
    return hits.select("name", "capture_id").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_captures"))


def first_hits(hits: DataFrame) -> DataFrame:
    """The first hit of each capture."""
    return hits.groupBy("capture_id").agg(F.min(F.struct(*HIT_ORDER, "name", "version")).alias("h")).select(
        "capture_id", F.col("h.rule_id").alias("rule_id"), F.col("h.name").alias("name"), F.col("h.version").alias("version"))


def chosen_bookmarks(bookmarks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Web bookmarks, of those only the ids that ``only`` lists."""
    chosen = bookmarks.where(urls.is_web(F.col("url")))
    return chosen if only is None else chosen.join(only, "bookmark_id", "left_semi")


def bookmark_groups(chosen: DataFrame, hits: DataFrame) -> DataFrame:
    """``(bookmark_id, url, name)``: bookmarks with the name of their first hit."""
    named = first_hits(hits).select(F.col("capture_id"), "name")
    return chosen.join(named, "capture_id", "left").select("bookmark_id", "url", "name")


def confidence_stats(hits: DataFrame, threshold: int) -> DataFrame:
    annotated = F.col("confidence").isNotNull()
    hidden = annotated & (F.col("confidence") < threshold) if threshold > 0 else F.lit(False)
    return hits.groupBy("capture_id").agg(
        F.count_if(annotated).alias("annotated"), F.count_if(hidden).alias("hidden"), F.count_if(~hidden).alias("visible"))


def visible_hits(hits: DataFrame, threshold: int) -> DataFrame:
    """Hits at or above the threshold, unannotated ones always, with their place:
    by confidence, then as found; unannotated last."""
    kept = hits.where(F.col("confidence").isNull() | (F.col("confidence") >= threshold))
    per_capture = kept.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("confidence").isNull().alias("last"), (-F.coalesce("confidence", F.lit(0))).alias("rank"), *HIT_ORDER, "name", "confidence",
    ))).alias("h"))
    return per_capture.select("capture_id", F.posexplode("h").alias("pos", "h")).select(
        "capture_id", (F.col("pos") + 1).alias("place"), F.col("h.rule_id").alias("rule_id"), F.col("h.name").alias("name"),
        F.col("h.confidence").alias("confidence"))


def display_hits(hits: DataFrame) -> DataFrame:
    """The first hits of a capture, each with a few short pieces of evidence, and
    the total."""
    shown = F.slice("hits", 1, DISPLAY_HITS)
    return hits_per_capture(hits).select("capture_id", F.size("hits").alias("total_hits"), F.posexplode(shown).alias("pos", "h")).select(
        "capture_id", "total_hits", (F.col("pos") + 1).alias("hit_ord"), F.col("h.rule_id").alias("rule_id"), F.col("h.name").alias("name"),
        clip(F.col("h.version"), 120).alias("version"), F.col("h.confidence").alias("confidence"),
        F.transform(F.slice("h.evidence", 1, DISPLAY_EVIDENCE), lambda e: F.struct(
            e["type"].alias("type"), e["part"].alias("part"), clip(e["detail"], DISPLAY_DETAIL).alias("detail"))).alias("evidence"))


def batch_results(scans: DataFrame, hits: DataFrame) -> DataFrame:
    """One compact row per scanned target: total and all hits.

    ``scans`` is ``(capture_id, requested_url, url, title, status)``.
    """
    return scans.join(hits_per_capture(hits), "capture_id", "left").select(
        "capture_id", clip(F.col("requested_url"), 2_048).alias("requested_url"),
        clip(F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("requested_url")), 2_048).alias("final_url"),
        clip(F.coalesce("title", F.lit("")), 300).alias("title"), F.coalesce("status", F.lit(0)).alias("status"),
        F.coalesce(F.size("hits"), F.lit(0)).alias("total_hits"),
        F.transform(F.coalesce("hits", F.array()), lambda h: F.struct(
            clip(h["rule_id"], 160).alias("id"), clip(h["name"], 160).alias("name"), h["confidence"].alias("confidence"),
            clip(h["version"], 120).alias("version"))).alias("hits"))


def batch_display(results: DataFrame) -> DataFrame:
    """The same rows as a list shows them, with the first twenty hits."""
    return results.withColumn("hits", F.slice("hits", 1, BATCH_HITS))


def batch_counters(targets: DataFrame, results: DataFrame) -> DataFrame:
    """total, completed, failed, invalid, duplicate in one row.

    ``targets`` is the output of ``classify_targets``; a kept target without a
    result row has failed.
    """
    judged = targets.select("verdict", "target").join(
        results.select(F.col("requested_url").alias("target"), F.lit(True).alias("done")).distinct(), "target", "left")
    kept = F.col("verdict") == "kept"
    return judged.agg(
        F.count_if(kept).alias("total"), F.count_if(kept & F.col("done")).alias("completed"),
        F.count_if(kept & F.col("done").isNull()).alias("failed"),
        F.count_if(F.col("verdict") == "invalid").alias("invalid"), F.count_if(F.col("verdict") == "duplicate").alias("duplicate"))


def classify_targets(inputs: DataFrame, url: str = "url", order: str = "ord") -> DataFrame:
    """Mark each input address as kept, duplicate or invalid.

    The first input of an address is found by a grouping with partial minima. Inputs meet
    these minima by address and position, which no two inputs share, so neither an
    address that makes up much of the input nor the invalid ones gather in one task.
    """
    marked = inputs.withColumn("target", urls.target(F.col(url)))
    first = marked.where("target IS NOT NULL").groupBy("target").agg(F.min(order).alias(order)).withColumn("_first", F.lit(True))
    verdict = F.when(F.col("target").isNull(), "invalid").when(F.col("_first"), "kept").otherwise("duplicate")
    return marked.join(first, ["target", order], "left").withColumn("verdict", verdict).drop("_first").select(*marked.columns, "verdict")


def scan_history(captures: DataFrame, hits: DataFrame, source: Column, at: Column) -> DataFrame:
    """One history entry per scan: where, when, what was found and why."""
    scans = captures.select(
        "capture_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("status", F.lit(0)).alias("status"),
        F.transform("favicon_hashes", lambda h: F.coalesce(h, F.lit(0))).alias("favicon_hashes"), source.alias("source"), at.alias("at"))
    detections = F.transform("hits", lambda h: F.struct(
        h["rule_id"].alias("id"), h["name"].alias("name"), clip(h["version"], 120).alias("version"), h["confidence"].alias("confidence"),
        F.transform(h["evidence"], lambda e: F.struct(
            e["type"].alias("matcher"), e["part"].alias("location"), e["detail"].alias("matched"), e["pattern"].alias("expression"),
        )).alias("evidence")))
    return scans.join(hits_per_capture(hits), "capture_id", "left").withColumn("hits", F.coalesce(detections, F.array()))


def latest_per_url(history: DataFrame) -> DataFrame:
    """Newest scan of each address (ties: the higher capture id)."""
    columns = [c for c in history.columns if c != "url"]
    return history.where("url <> ''").groupBy("url").agg(
        F.max_by(F.struct(*columns), F.struct("at", "capture_id")).alias("s")).select("url", "s.*").select(*history.columns)


def history_limit(value: int | None) -> int:
    return HISTORY_DEFAULT if value is None else min(HISTORY_MAX, max(HISTORY_MIN, int(value)))


def newest(history: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest scans; at most 5,000, so every task keeps that many at most."""
    return history.orderBy(F.col("at").desc(), F.col("capture_id").desc()).limit(history_limit(limit))


def find_rules(rules: DataFrame, needle: str, limit: int = RULE_LIST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rules whose id or name contains the text: (the first ones, the total)."""
    text = F.lower(F.concat(F.coalesce("rule_id", F.lit("")), F.lit("\n"), F.coalesce("name", F.lit(""))))
    found = rules.where(F.contains(text, F.lit(needle.strip().lower())))
    return found.orderBy("rule_ord").limit(limit), found.agg(F.count(F.lit(1)).alias("total"))
