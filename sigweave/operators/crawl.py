"""Link graph of stored pages: edges, and a breadth-first frontier over them.

The place of a page in the crawl order is its level and its way: the positions of
the links that lead to it, compared element by element. Both come out of minima
over partial groups, so no level is ever sorted or numbered in one task.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigweave.functions import html, urls
from sigweave.operators.reports import hits_per_capture
from sigweave.session import cut_lineage

SALTS = 64
#: Levels after which the pages known so far become one table.
LEVELS_APART = 16


def edges(captures: DataFrame) -> DataFrame:
    """``(src, dst, dst_host, pos)``: normalised web links to pages, each pair of
    addresses once at its first position."""
    found = captures.select("url", F.posexplode_outer(html.links(F.col("body"))).alias("pos", "link")).where("pos IS NOT NULL")
    absolute = found.select("url", "pos", urls.resolve(F.col("url"), F.col("link")).alias("dst"))
    kept = absolute.where(urls.is_web(F.col("dst")) & ~urls.is_static(urls.path(F.col("dst"))))
    named = kept.select(urls.normalize(F.col("url")).alias("src"), urls.normalize(F.col("dst")).alias("dst"), "pos")
    once = named.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    return once.withColumn("dst_host", urls.host(F.col("dst")))


def seed_rows(seeds: DataFrame) -> DataFrame:
    """``(seed_id, url, base)``: web seeds with the site they stay on."""
    web = seeds.where(urls.is_web(F.col("url")))
    return web.select("seed_id", urls.normalize(F.col("url")).alias("url"), urls.site(urls.host(F.col("url"))).alias("base"))


def _first_of_level(found: DataFrame, budget: DataFrame) -> DataFrame:
    """Flag the first pages of a level, as many per seed as its budget allows.

    Seeds are cut in two rounds, first by salt and then as a whole, so the second
    round sees at most ``SALTS`` times the budget of a seed.
    """
    rows = found.join(budget, "seed_id").withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)))
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("seed_id", "_salt").orderBy("way", "url")))
    near = first.where(F.col("_rn") <= F.col("budget")).withColumn("_rn", F.row_number().over(Window.partitionBy("seed_id").orderBy("way", "url")))
    kept = near.where(F.col("_rn") <= F.col("budget")).select("seed_id", "url", F.lit(True).alias("_in"))
    return found.join(kept, ["seed_id", "url"], "left").withColumn("visited", F.coalesce("_in", F.lit(False))).drop("_in")


def frontier(links: DataFrame, seeds: DataFrame, max_pages: int = 0) -> DataFrame:
    """``(seed_id, url, base, level, way, visited)`` of a crawl from each seed.

    ``max_pages`` bounds the pages visited per seed (0: no bound); pages found but
    not visited stay in the result as queued. Each level is written to the shared
    checkpoint folder, so a lost executor costs one level, not the whole crawl. The
    crawl ends when a level brings nothing new, however deep that is.
    """
    links = cut_lineage(links)
    current = cut_lineage(seed_rows(seeds).groupBy("seed_id", "url", "base").agg(F.first(F.lit(0)).alias("level")).select(
        "seed_id", "url", "base", "level", F.array().cast("array<int>").alias("way"), F.lit(True).alias("visited")))
    known = current
    for level in count(1):
        step = current.where("visited").select("seed_id", F.col("url").alias("src"), "base", "way").join(links, "src")
        reached = step.where(urls.same_site(F.col("dst_host"), F.col("base"))).groupBy("seed_id", "base", F.col("dst").alias("url")).agg(
            F.min(F.array_append("way", F.col("pos"))).alias("way"))
        fresh = reached.join(known.select("seed_id", "url"), ["seed_id", "url"], "left_anti").withColumn("level", F.lit(level))
        if max_pages:
            budget = known.groupBy("seed_id").agg((F.lit(max_pages) - F.count_if("visited")).alias("budget"))
            fresh = _first_of_level(fresh, budget)
        else:
            fresh = fresh.withColumn("visited", F.lit(True))
        current = cut_lineage(fresh.select(*known.columns))
        if current.isEmpty():
            break
        known = known.unionByName(current)
        if level % LEVELS_APART == 0:
            known = cut_lineage(known)
    return known


def status(reached: DataFrame) -> DataFrame:
    return reached.groupBy("seed_id").agg(F.count_if("visited").alias("visited"), F.count_if(~F.col("visited")).alias("queued"))


def _stored_pages(captures: DataFrame) -> DataFrame:
    """The first capture of each address."""
    return captures.select("capture_id", urls.normalize(F.col("url")).alias("url"), "title", "status").groupBy("url").agg(
        F.min(F.struct("capture_id", "title", "status")).alias("c")).select("url", "c.*")


def visited_captures(reached: DataFrame, captures: DataFrame) -> DataFrame:
    """Ids of the captures a crawl has visited."""
    return _stored_pages(captures).join(reached.where("visited").select("url").distinct(), "url", "left_semi").select("capture_id")


def scan(reached: DataFrame, captures: DataFrame, hits: DataFrame) -> DataFrame:
    """Visited pages with their hits; a page that is not stored has failed."""
    return reached.where("visited").join(_stored_pages(captures), "url", "left").join(hits_per_capture(hits), "capture_id", "left").select(
        "seed_id", "url", "level", "way", "capture_id", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), "status",
        "hits", F.col("capture_id").isNull().alias("failed"))
