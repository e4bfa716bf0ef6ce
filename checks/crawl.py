"""Crawls over a link graph derived from the page table.

Page k belongs to site k % 4 and is node k // 4 of that site's tree: it links to
its two children, its parent, itself and some addresses that must be left out, and
keeps the anchors of its stored HTML.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import core_pack, query, table
from sigweave.functions import html, urls
from sigweave.operators import crawl
from sigweave.plans import jobs
from sigweave.sources.captures import complete

NODE_URL = "'https://www.s' || (page_id % 4) || '.example.com/n/' || (page_id // 4)"
LINKS_SQL = """'<a href="/n/' || (j * 2 + 1) || '/">a</a><a href="' || (j * 2 + 2) || '#x">b</a><a href="../n/' || ((j - 1) // 2) || '">p</a><a href="//s' || site || '.example.com/about">s</a><a href="/style.CSS">c</a><a href="http://fakes' || site || '.example.org/">o</a><a href="mailto:x@y.z">m</a>'"""
GRAPH_SQL = f"""
nodes AS (SELECT page_id, page_id % 4 AS site, page_id // 4 AS j, {NODE_URL} AS url, html FROM pages),
found AS (
  SELECT page_id, site, j, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM (
    SELECT page_id, site, j, url, regexp_extract_all({LINKS_SQL} || html, '(?is)<a\\s[^>]*?href="([^"]*)"', 1) AS hrefs FROM nodes)),
resolved AS (
  SELECT url AS src, pos, root || CASE WHEN regexp_matches(p, '[^\\x00-\\x7F]') THEN
      replace(replace(replace(replace(url_encode(p), '%2F', '/'), '%2C', ','), '%3A', ':'), '%3B', ';') ELSE p END AS dst FROM (
    SELECT *, CASE WHEN href LIKE '//%' THEN 'https:' || regexp_extract(href, '^(//[^/]*)', 1) ELSE 'https://www.s' || site || '.example.com' END AS root,
      CASE WHEN href LIKE '//%' THEN regexp_extract(href, '^//[^/]*(.*)', 1) WHEN href LIKE '/n/%' THEN rtrim(href, '/') WHEN href LIKE '/%' THEN href
        WHEN href LIKE '../%' THEN substr(href, 3) ELSE '/n/' || split_part(href, '#', 1) END AS p
    FROM found WHERE href NOT LIKE 'mailto:%' AND href NOT LIKE '%.CSS' AND href NOT LIKE 'http%')
  UNION ALL SELECT url, pos, href FROM found WHERE href LIKE 'http%'),
edges AS (SELECT src, dst, min(pos)::INTEGER AS pos, regexp_extract(dst, '^[a-z]+://([^/]*)', 1) AS dst_host FROM resolved GROUP BY src, dst)"""


def site_pages(spark, sf):
    k = F.col("page_id")
    j, site = F.floor(k / 4), (k % 4).cast("string")
    text = lambda x: x.cast("bigint").cast("string")
    head = F.concat(
        F.lit('<a href="/n/'), text(j * 2 + 1), F.lit('/">a</a><a href="'), text(j * 2 + 2), F.lit('#x">b</a><a href="../n/'), text(F.when(j == 0, 0).otherwise(F.floor((j - 1) / 2))),
        F.lit('">p</a><a href="//s'), site, F.lit('.example.com/about">s</a><a href="/style.CSS">c</a><a href="http://fakes'), site, F.lit('.example.org/">o</a><a href="mailto:x@y.z">m</a>'))
    return complete(table(spark, sf, "pages").select(
        k.alias("capture_id"), F.concat(F.lit("https://www.s"), site, F.lit(".example.com/n/"), text(j)).alias("url"),
        html.title(F.col("html")).alias("title"), F.concat(head, F.col("html")).alias("body"), F.lit(200).alias("status")))


def seeds(pages):
    """The first node of each site."""
    root = F.regexp_replace("url", "/n/[0-9]+\\z", "/n/0")
    return pages.select(F.regexp_extract("url", "www\\.s([0-9])", 1).cast("int").alias("seed_id"), root.alias("url")).distinct()


@query("crawl_edges", "WITH " + GRAPH_SQL + " SELECT * FROM edges")
def crawl_edges(spark, sf):
    return crawl.edges(site_pages(spark, sf))


@query("crawl_site_filter", """
SELECT page_id, url FROM pages WHERE (SELECT regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '(^|\\.)example\\.com$'))""")
def crawl_site_filter(spark, sf):
    base = urls.site(F.lit("shop.example.com"))
    pages = table(spark, sf, "pages")
    return pages.where(urls.same_site(urls.host(F.col("url")), base)).select("page_id", "url")


@query("crawl_static_filter", r"""
WITH made AS (SELECT page_id, url || unnest(['', '.PNG', '/a.css', '.tar.gz', '/x.html', '.mp4/', '?f=a.png']) AS link FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages))
SELECT page_id, link FROM made WHERE NOT regexp_matches(split_part(link, '?', 1), '(?i)\.(png|css|gz|mp4)$')""")
def crawl_static_filter(spark, sf):
    made = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*\\z", "").alias("u"), F.explode(F.array(*map(F.lit, [
        "", ".PNG", "/a.css", ".tar.gz", "/x.html", ".mp4/", "?f=a.png"]))).alias("end"))
    links = made.select("page_id", F.concat("u", "end").alias("link"))
    return links.where(~urls.is_static(urls.path(F.col("link"))))


def _bfs_sql(limit: int) -> str:
    """Whole breadth-first order by recursion, then the first pages per seed."""
    return "WITH RECURSIVE " + GRAPH_SQL + f""",
walk AS (
  SELECT site::INTEGER AS seed_id, 'https://www.s' || site || '.example.com/n/0' AS url, 0 AS level, []::INTEGER[] AS way FROM (SELECT DISTINCT site FROM nodes)
  UNION
  SELECT w.seed_id, e.dst, w.level + 1, list_append(w.way, e.pos) FROM walk w JOIN edges e ON e.src = w.url
  WHERE (e.dst_host = 'example.com' OR e.dst_host LIKE '%.example.com') AND e.dst NOT IN (SELECT src FROM edges WHERE src = w.url)
    AND (NOT e.dst LIKE '%/n/%' OR regexp_extract(e.dst, '/n/([0-9]+)$', 1)::BIGINT > coalesce(try_cast(regexp_extract(w.url, '/n/([0-9]+)$', 1) AS BIGINT), 0))),
placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, url ORDER BY level, way) AS rn FROM walk) WHERE rn = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY level, way, url) AS ord FROM placed),
visited AS (SELECT * FROM ranked WHERE {limit} = 0 OR ord <= {limit})"""


@query("crawl_frontier", _bfs_sql(0) + " SELECT seed_id, url, level, array_to_string(way, '.') AS way FROM visited")
def crawl_frontier(spark, sf):
    pages = site_pages(spark, sf)
    reached = crawl.frontier(crawl.edges(pages), seeds(pages))
    return reached.select("seed_id", "url", "level", F.array_join(F.transform("way", lambda n: n.cast("string")), ".").alias("way"))


@query("crawl_limit", _bfs_sql(40) + " SELECT seed_id, url, level FROM visited")
def crawl_limit(spark, sf):
    pages = site_pages(spark, sf)
    return crawl.frontier(crawl.edges(pages), seeds(pages), max_pages=40).where("visited").select("seed_id", "url", "level")


@query("crawl_status", _bfs_sql(40) + """,
seen AS (SELECT DISTINCT v.seed_id, e.dst FROM visited v JOIN edges e ON e.src = v.url WHERE e.dst_host LIKE '%.example.com')
SELECT seed_id, 40::BIGINT AS visited, (SELECT count(*) FROM seen s WHERE s.seed_id = t.seed_id AND s.dst NOT IN (SELECT url FROM visited v WHERE v.seed_id = t.seed_id)) AS queued
FROM (SELECT DISTINCT seed_id FROM visited) t""")
def crawl_status(spark, sf):
    pages = site_pages(spark, sf)
    return crawl.status(crawl.frontier(crawl.edges(pages), seeds(pages), max_pages=40))


@query("crawl_scan", _bfs_sql(0) + """
SELECT v.seed_id, v.url, n.page_id AS capture_id, n.page_id IS NULL AS failed, coalesce(contains(n.html, '<article>'), false) AS has_article FROM visited v LEFT JOIN nodes n ON n.url = v.url""")
def crawl_scan(spark, sf):
    pages = site_pages(spark, sf)
    scanned = jobs.crawl_scan(pages, seeds(pages), core_pack())
    found = F.exists(F.coalesce("hits", F.array().cast(scanned.schema["hits"].dataType)), lambda h: h["name"] == "Broken or hit")
    return scanned.select("seed_id", "url", "capture_id", "failed", found.alias("has_article"))
