"""Whole jobs: a batch of addresses, a crawl, bookmarks, a feed refresh."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.operators import crawl, reports, rulesets
from sigweave.plans.detect import detect
from sigweave.session import stored
from sigweave.sources.pack import RulePack


@dataclass(frozen=True)
class BatchScan:
    targets: DataFrame
    results: DataFrame
    failures: DataFrame
    counters: DataFrame


def batch_scan(inputs: DataFrame, captures: DataFrame, hits: DataFrame) -> BatchScan:
    """Scan a list of addresses ``(ord, url)`` against stored captures.

    The address without its fragment finds the capture; of several captures of
    one address the first answers. An address without a capture is a failure.
    """
    targets = reports.classify_targets(inputs)
    kept = targets.where("verdict = 'kept'").select("target")
    stored = captures.select("capture_id", F.regexp_replace("url", "#.*\\z", "").alias("target"), "url", "title", "status")
    answers = stored.groupBy("target").agg(F.min_by(F.struct("capture_id", "url", "title", "status"), "capture_id").alias("c")).select("target", "c.*")
    answered = kept.join(answers, "target", "left")
    results = reports.batch_results(answered.where("capture_id IS NOT NULL").withColumnRenamed("target", "requested_url"), hits)
    failures = answered.where("capture_id IS NULL").select(F.col("target").alias("url"), F.lit("not stored").alias("error"))
    return BatchScan(targets, results, failures, reports.batch_counters(targets, results))


def crawl_scan(captures: DataFrame, seeds: DataFrame, pack: RulePack, max_pages: int = 0, dictionary: DataFrame | None = None) -> DataFrame:
    """Crawl stored pages from the seeds and detect on every page visited, and on no other."""
    reached = crawl.frontier(crawl.edges(captures), seeds, max_pages)
    visited = stored(crawl.visited_captures(reached, captures), "visited")
    return crawl.scan(reached, captures, detect(captures.join(visited, "capture_id", "left_semi"), pack, dictionary))


def bookmark_scan(bookmarks: DataFrame, captures: DataFrame, pack: RulePack, only: DataFrame | None = None,
                  dictionary: DataFrame | None = None, custom: DataFrame | None = None) -> DataFrame:
    """Bookmarks with the name of their first hit; only their own pages are matched."""
    chosen = reports.chosen_bookmarks(bookmarks, only)
    pages = captures.join(stored(chosen.select("capture_id").distinct(), "bookmarked"), "capture_id", "left_semi")
    return reports.bookmark_groups(chosen, detect(pages, pack, dictionary, custom))


@dataclass(frozen=True)
class FeedRefresh:
    unchanged: bool
    rule_sets: DataFrame
    versions: DataFrame
    summary: DataFrame


def refresh_feed(rule_sets: DataFrame, versions: DataFrame, set_id: str, set_name: str, converted: DataFrame) -> FeedRefresh:
    """Put the converted rules ``(rule_id, rule_ord, rule)`` of a feed in place.

    Equal content is left alone. Otherwise the set is replaced, the rules become
    the next version, and the one before stays for a rollback.
    """
    current = rule_sets.where(F.col("set_id") == set_id)
    place = current.agg(F.max("set_ord").alias("own")).collect()[0]["own"]
    if place is None:
        place = (rule_sets.agg(F.max("set_ord").alias("last")).collect()[0]["last"] or 0) + 1
    fresh = converted.select(F.lit(set_id).alias("set_id"), F.lit(set_name).alias("set_name"), F.lit(place).cast("int").alias("set_ord"), "rule_ord", "rule_id", "rule")
    hashes = [[r["content_hash"] for r in rulesets.content_hash(df).collect()] for df in (current, fresh)]
    summary = rulesets.update_summary(current, fresh)
    if hashes[0] == hashes[1]:
        return FeedRefresh(True, rule_sets, versions, summary)
    number = versions.where(F.col("set_id") == set_id).agg(F.max("version").alias("v")).collect()[0]["v"]
    added = fresh.select("set_id", "rule_id", "rule", F.lit((number or 0) + 1).cast("int").alias("version"))
    return FeedRefresh(False, rulesets.replace_set(rule_sets, set_id, fresh), versions.unionByName(added), summary)
