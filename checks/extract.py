"""Sources and feature extraction over the page table.

``rich_pages`` adds a head with meta, script and link tags to each stored page,
so that the extraction operators meet every tag and quoting style.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import TITLE_SQL, captures, query, table, with_captures
from sigweave.functions import html, snapshots, urls
from sigweave.functions.text import slug
from sigweave.sources import captures as sources

HEAD = (
    "<head><META Name=\"Description\" content='Page §'><meta property=og:title content=\"T§\"><meta name=\"empty\" content=\"\">"
    "<meta charset=utf-8><meta name=description content=again§><script  src=\"/js/app§.js\" async></script>"
    "<script src='../lib/x.js'></script><script src=\"\"></script><link rel=\"shortcut icon\" href=\"/favicon.ico\">"
    "<link rel=icon href=icons/§.png><link rel=stylesheet href=/s.css><link href=\"//cdn.example.com/a/./b/../i.svg\" rel='apple-touch-icon'>"
    "<a class=x href='?q=§#f' href=\"last/§\">l</a><a name=top>t</a><a HREF=#frag>f</a></head>"
)


def rich_pages(spark, sf):
    head = F.replace(F.lit(HEAD), F.lit("§"), (F.col("page_id") % 17).cast("string"))
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("capture_id"), "url", F.concat(head, F.col("html")).alias("body"), F.lit("").alias("title"))


RICH = "rich AS (SELECT page_id AS capture_id, url, replace('" + HEAD.replace("'", "''") + "', '§', (page_id % 17)::VARCHAR) || html AS body FROM pages)"
ATTR = r"""(?is)([\w-]+)\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>]+))"""


def _tags_sql(kinds: str = "meta script link a") -> str:
    return RICH + ", raw_tags AS (" + " UNION ALL ".join(
        f"SELECT capture_id, url, '{k}' AS tag, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS ord FROM (SELECT capture_id, url, regexp_extract_all(body, '(?is)<{k}\\s[^>]*>') AS x FROM rich)"
        for k in kinds.split()) + f"""),
attrs AS (
  SELECT capture_id, tag, ord, lower(n) AS name, coalesce(nullif(d, ''), nullif(s, ''), b, '') AS value, ix FROM (
    SELECT capture_id, tag, ord, unnest(regexp_extract_all(text, '{ATTR}', 1)) AS n, unnest(regexp_extract_all(text, '{ATTR}', 2)) AS d,
      unnest(regexp_extract_all(text, '{ATTR}', 3)) AS s, unnest(regexp_extract_all(text, '{ATTR}', 4)) AS b,
      generate_subscripts(regexp_extract_all(text, '{ATTR}', 1), 1) AS ix FROM raw_tags)),
pairs AS (SELECT capture_id, tag, ord, name, arg_max(value, ix) AS value FROM attrs GROUP BY ALL),
metas AS (
  SELECT capture_id, lower(coalesce(nullif(max(value) FILTER (name = 'name'), ''), max(value) FILTER (name = 'property'))) AS name,
    max(value) FILTER (name = 'content') AS content, ord FROM pairs WHERE tag = 'meta' GROUP BY capture_id, ord),
hrefs AS (SELECT p.capture_id, p.tag, p.ord, p.value, url, row_number() OVER (PARTITION BY p.capture_id, p.tag ORDER BY p.ord) - 1 AS pos
  FROM pairs p JOIN rich USING (capture_id) WHERE value <> '' AND (
    (tag = 'script' AND name = 'src') OR (tag = 'a' AND name = 'href') OR (tag = 'link' AND name = 'href' AND EXISTS (
      SELECT 1 FROM pairs r WHERE r.capture_id = p.capture_id AND r.tag = 'link' AND r.ord = p.ord AND r.name = 'rel' AND contains(r.value, 'icon')))))"""


TAGS = "WITH " + _tags_sql()


@query("src_captures", f"""
SELECT page_id AS capture_id, url, '' AS title, length(html) AS body_chars, 0 AS status, 0 AS n_headers, 0 AS n_icons FROM pages""")
def src_captures(spark, sf):
    loaded = sources.load_captures(spark, f"{sf}/pages.parquet")
    return loaded.select("capture_id", "url", "title", F.length("body").cast("bigint").alias("body_chars"), "status",
                         F.size("headers").alias("n_headers"), F.size("favicon_hashes").alias("n_icons"))


@query("src_bounded_body", """
SELECT doc_id, length(t) AS chars, right(t, 20) AS tail FROM (SELECT doc_id, repeat(text, 4)[:200000] AS t FROM documents)""")
def src_bounded_body(spark, sf):
    body = sources.bounded_body(F.repeat("text", 4))
    return table(spark, sf, "documents").select("doc_id", F.length(body).cast("bigint").alias("chars"), F.right(body, F.lit(20)).alias("tail"))


@query("ext_title", f"SELECT page_id AS capture_id, {TITLE_SQL} AS title FROM pages")
def ext_title(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("capture_id"), html.title(F.col("html")).alias("title"))


@query("ext_title_fallback", f"""
SELECT page_id AS capture_id, CASE WHEN page_id % 3 = 0 THEN 'Given ' || page_id ELSE {TITLE_SQL} END AS title FROM pages""")
def ext_title_fallback(spark, sf):
    p = F.col("page_id")
    given = F.when(p % 3 == 0, F.concat(F.lit("Given "), p.cast("string"))).when(p % 3 == 1, "")
    return table(spark, sf, "pages").select(p.alias("capture_id"), html.title_or_extracted(given, F.col("html")).alias("title"))


@query("ext_tags", TAGS + """
SELECT r.capture_id, r.tag, r.ord, coalesce(string_agg(name || '=' || value, ';' ORDER BY name), '') AS attrs
FROM raw_tags r LEFT JOIN pairs p USING (capture_id, tag, ord) GROUP BY ALL""")
def ext_tags(spark, sf):
    pairs = html.last_per_name(F.col("pairs"))
    text = F.array_join(F.transform(F.array_sort(pairs), lambda a: F.concat(a["name"], F.lit("="), a["value"])), ";")
    return html.tag_rows(rich_pages(spark, sf)).select("capture_id", "tag", F.col("ord").cast("bigint").alias("ord"), text.alias("attrs"))


@query("ext_meta", TAGS + """
SELECT capture_id, name, arg_max(content, ord) AS content FROM metas WHERE name <> '' AND content <> '' GROUP BY capture_id, name""")
def ext_meta(spark, sf):
    return rich_pages(spark, sf).select("capture_id", F.inline_outer(html.meta_pairs(F.col("body")))).where("name IS NOT NULL") \
        .withColumnRenamed("value", "content")


def _listed(spark, sf, column):
    return rich_pages(spark, sf).select("capture_id", F.posexplode_outer(column(F.col("body"))).alias("pos", "value")) \
        .where("pos IS NOT NULL").withColumn("pos", F.col("pos").cast("bigint"))


@query("ext_scripts", TAGS + " SELECT capture_id, pos, value FROM hrefs WHERE tag = 'script'")
def ext_scripts(spark, sf):
    return _listed(spark, sf, html.scripts)


@query("ext_favicons", TAGS + " SELECT capture_id, pos, value FROM hrefs WHERE tag = 'link'")
def ext_favicons(spark, sf):
    return _listed(spark, sf, html.favicons)


@query("ext_links", TAGS + " SELECT capture_id, pos, value FROM hrefs WHERE tag = 'a'")
def ext_links(spark, sf):
    return _listed(spark, sf, html.links)


URL_PARTS = r"regexp_extract({u}, '^([a-z]+)://', 1) || '://' || regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1)"
ROOT = URL_PARTS.format(u="url")
FOLDER = r"regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '')"


@query("ext_favicon_urls", TAGS + f"""
SELECT capture_id, pos, CASE WHEN value LIKE '//%' THEN regexp_extract(url, '^([a-z]+):', 1) || '://cdn.example.com/a/i.svg'
  WHEN value LIKE '/%' THEN {ROOT} || value ELSE {ROOT} || {FOLDER} || value END AS icon_url, pos = 0 AS is_primary
FROM hrefs WHERE tag = 'link'""")
def ext_favicon_urls(spark, sf):
    """Absolute icon addresses, distinct, the first one marked."""
    found = rich_pages(spark, sf).select("capture_id", "url", html.favicons(F.col("body")).alias("icons"))
    absolute = F.array_distinct(F.filter(F.transform("icons", lambda i: urls.resolve(F.col("url"), i)), lambda u: u.isNotNull()))
    return found.select("capture_id", F.posexplode(absolute).alias("pos", "icon_url")).select(
        "capture_id", F.col("pos").cast("bigint").alias("pos"), "icon_url", (F.col("pos") == 0).alias("is_primary"))


def _text_query(name, part, column):
    @query(name, with_captures("") + f" SELECT capture_id, {column} AS text FROM texts")
    def run(spark, sf):
        return captures(spark, sf).select("capture_id", sources.part_text(part).alias("text"))


_text_query("ext_header_text", "header", "header_text")
_text_query("ext_meta_text", "meta", "meta_text")
_text_query("ext_script_text", "script", "script_text")
_text_query("ext_raw_text", "raw", "header_text || body")


@query("ext_parts", with_captures("") + " SELECT capture_id, part, text, lower(text) AS lower_text FROM parts")
def ext_parts(spark, sf):
    return sources.parts(captures(spark, sf))


@query("ext_header_merge", """
WITH rows AS (
  SELECT page_id AS capture_id, unnest(['Server', 'Set-Cookie', 'set-cookie', 'X-Cache']) AS name, unnest(['a' || page_id % 3, 's=1', 't=' || page_id, 'HIT']) AS value,
    unnest([0, 1, 2, 3]) AS ord FROM pages),
merged AS (SELECT capture_id, lower(name) AS name, string_agg(CASE WHEN rn = 1 THEN value ELSE lower(name) || ': ' || value END, chr(10) ORDER BY ord) AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, lower(name) ORDER BY ord) AS rn FROM rows) GROUP BY ALL)
SELECT capture_id, string_agg(name || ': ' || value || chr(10), '' ORDER BY name) AS text FROM merged GROUP BY ALL""")
def ext_header_merge(spark, sf):
    from sigweave.functions.text import map_text

    p = F.col("page_id").cast("string")
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("capture_id"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), v.alias("value")) for i, (n, v) in enumerate([
            ("Server", F.concat(F.lit("a"), (F.col("page_id") % 3).cast("string"))), ("Set-Cookie", F.lit("s=1")),
            ("set-cookie", F.concat(F.lit("t="), p)), ("X-Cache", F.lit("HIT"))])])))
    return sources.merge_headers(rows).select("capture_id", map_text(F.col("headers")).alias("text"))


SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query("ext_readable_text", rf"""
WITH source AS (SELECT page_id AS capture_id, html || '<p>R&amp;D&nbsp;&#65;&#8364; ok</p>' AS h FROM pages),
a AS (SELECT capture_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\b[\s\S]*?</script>', ' ', 'g'), '(?is)<style\b[\s\S]*?</style>', ' ', 'g'), '(?is)<noscript\b[\s\S]*?</noscript>', ' ', 'g'), '(?is)<svg\b[\s\S]*?</svg>', ' ', 'g') AS h FROM source),
b AS (SELECT capture_id, regexp_replace(regexp_replace(h, '(?i)</(?:p|div|section|article|main|header|footer|li|h[1-6]|tr)>|<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS h FROM a),
c AS (SELECT capture_id, replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&quot;', '"', 'g'), '&#65;', 'A'), '&#8364;', '€') AS h FROM b)
SELECT capture_id, regexp_replace(regexp_replace(regexp_replace(h, '[ \t]+', ' ', 'g'), '\n{SPACES}+', chr(10), 'g'), '^{SPACES}+|{SPACES}+$', '', 'g')[:30000] AS text FROM c""")
def ext_readable_text(spark, sf):
    source = F.concat("html", F.lit("<p>R&amp;D&nbsp;&#65;&#8364; ok</p>"))
    return table(spark, sf, "pages").select(F.col("page_id").alias("capture_id"), html.readable_text(source).alias("text"))


@query("ext_js_values", with_captures("") + " SELECT capture_id, 'React.version' AS path, repeat(react, 40)[:120] AS value FROM texts WHERE react IS NOT NULL")
def ext_js_values(spark, sf):
    wide = captures(spark, sf).withColumn("js", F.map_concat(
        F.transform_values("js", lambda _k, v: F.repeat(v, F.lit(40))), F.create_map(F.lit("unasked"), F.lit("x"))))
    kept = sources.runtime_values(["React.version", "React.version", "", "p" * 201, "Vue.version"])
    return wide.select("capture_id", F.explode(kept).alias("path", "value"))


# Links of every form, made from the page id.
FORMS = ["/a/b§", "c§/d", "?q=§", "#f§", "//other.example.net/x§", "../up/§", "./here/./§", "a/../../§/..", "http://abs.example.org/p§?x=1#y",
         "mailto:x§@example.com", "/é/§ z", "", "/bad%zz§"]
URL_LINKS_SQL = f"""
links AS (SELECT page_id, url, ix, replace(form, '§', (page_id % 97)::VARCHAR) AS link FROM pages, (SELECT unnest({FORMS!r}) AS form, unnest(range({len(FORMS)})) AS ix)),
based AS (SELECT *, {ROOT} AS root, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path,
  regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS query, regexp_extract(url, '^([a-z]+):', 1) AS scheme, page_id % 97 AS n FROM links),
foldered AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder FROM based),
parents AS (SELECT *, regexp_replace(folder, '[^/]+/$', '') AS parent FROM foldered),
grand AS (SELECT *, CASE WHEN folder = '/' THEN '/' ELSE parent END AS up, CASE WHEN parent = '/' OR folder = '/' THEN '/' ELSE regexp_replace(parent, '[^/]+/$', '') END AS up2 FROM parents)"""


def _links(spark, sf):
    forms = F.array(*[F.struct(F.lit(i).alias("ix"), F.lit(f).alias("form")) for i, f in enumerate(FORMS)])
    rows = table(spark, sf, "pages").select("page_id", "url", F.inline(forms))
    return rows.select("page_id", "url", "ix", F.replace("form", F.lit("§"), (F.col("page_id") % 97).cast("string")).alias("link"))


@query("url_resolve", f"""WITH {URL_LINKS_SQL}
SELECT page_id, ix::INTEGER AS ix, CASE ix WHEN 0 THEN root || link WHEN 1 THEN root || folder || link WHEN 2 THEN root || path || link
  WHEN 3 THEN root || path || query || link WHEN 4 THEN scheme || ':' || link WHEN 5 THEN root || up || 'up/' || n
  WHEN 6 THEN root || folder || 'here/' || n WHEN 7 THEN root || up WHEN 8 THEN link WHEN 9 THEN link
  WHEN 10 THEN root || '/%C3%A9/' || n || '%20z' WHEN 11 THEN root || path || query END AS absolute FROM grand""")
def url_resolve(spark, sf):
    return _links(spark, sf).select("page_id", "ix", urls.resolve(F.col("url"), F.col("link")).alias("absolute"))


@query("url_normalize", """
SELECT page_id, CASE WHEN contains(u, '?') THEN regexp_replace(split_part(u, '?', 1), '(://[^/]*/.*[^/]|://[^/]*/[^/]+)/$', '\\1') || '?' || substr(u, strpos(u, '?') + 1)
  ELSE regexp_replace(u, '(://[^/]*/.*[^/]|://[^/]*/[^/]+)/$', '\\1') END AS normalized
FROM (SELECT page_id, split_part(url, '#', 1) AS u FROM pages)""")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalize(F.col("url")).alias("normalized"))


HOSTS = ["example.com", "localhost", "127.0.0.1", "10.1.2.3", "172.20.0.1", "172.32.0.1", "192.168.1.1", "192.0.2.9", "100.64.0.1", "100.128.0.1",
         "169.254.1.1", "198.18.0.1", "203.0.113.7", "224.0.0.1", "8.8.8.8", "a.local", "db.internal", "x.home.arpa", "[::1]", "[fd00::1]",
         "[2606:4700::1]", "[fe80::1]", "user:pw@example.com", "EXAMPLE.com.", "256.1.1.1", "192.88.99.1", "198.51.100.2", "[::ffff:8.8.8.8]"]
PUBLIC = {"example.com", "172.32.0.1", "100.128.0.1", "8.8.8.8", "[2606:4700::1]", "EXAMPLE.com.", "256.1.1.1"}


@query("url_public_filter", f"""
SELECT page_id, address FROM (
  SELECT page_id, scheme, host, scheme || '://' || host || '/p' || page_id AS address FROM pages,
    (SELECT unnest({HOSTS!r}) AS host), (SELECT unnest(['http', 'https', 'ftp']) AS scheme)
  UNION ALL SELECT page_id, 'http', 'example.com', url FROM pages)
WHERE scheme <> 'ftp' AND host IN ({", ".join(map(repr, sorted(PUBLIC)))})""")
def url_public_filter(spark, sf):
    pages = table(spark, sf, "pages")
    made = pages.select("page_id", F.explode(F.array(*[
        F.concat(F.lit(f"{s}://{h}/p"), F.col("page_id").cast("string")) for h in HOSTS for s in ("http", "https", "ftp")])).alias("address"))
    both = made.unionByName(pages.select("page_id", F.col("url").alias("address")))
    return both.where(urls.is_public(F.col("address")))


@query("snap_redacted", with_captures("") + r"""
SELECT capture_id, url, title, status, 'server=' || server || coalesce(';x-powered-by=' || powered, '') AS headers, coalesce('generator=' || generator, '') AS meta,
  len(scripts)::INTEGER AS n_scripts, len(favicon_hashes)::INTEGER AS n_icons FROM texts""")
def snap_redacted(spark, sf):
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    shared = captures(spark, sf).select("capture_id", *snapshots.redacted())
    return shared.select("capture_id", "url", "title", "status", flat("headers").alias("headers"), flat("meta").alias("meta"),
                         F.size("scripts").alias("n_scripts"), F.size("favicon_hashes").alias("n_icons"))


@query("snap_compact", with_captures("") + r"""
SELECT capture_id, url[:4000] AS url, title[:2000] AS title, length(repeat(body, 9)[:80000]) AS body_chars,
  array_to_string(list_filter([p % 7, 4294967296 + p, -3], lambda x: x < 2147483648), ',') AS hashes,
  CASE WHEN p % 2 = 0 THEN 'a=true' ELSE 'a=false' END AS flags, len(scripts)::INTEGER AS n_scripts FROM texts""")
def snap_compact(spark, sf):
    p = F.col("capture_id")
    damaged = captures(spark, sf).withColumns({
        "body": F.repeat("body", F.lit(9)),
        "favicon_hashes": F.array((p % 7).cast("string"), (p + 4294967296).cast("string"), F.lit("-3"), F.lit("x1")),
        "dom_hits": F.create_map(F.lit("a"), F.when(p % 2 == 0, "true").otherwise("false"), F.lit("b"), F.lit("maybe")),
    })
    stored = damaged.select("capture_id", *snapshots.compact())
    flags = F.array_join(F.transform(F.array_sort(F.map_entries("dom_hits")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return stored.select("capture_id", "url", "title", F.length("body").cast("bigint").alias("body_chars"),
                         F.array_join(F.transform("favicon_hashes", lambda h: h.cast("string")), ",").alias("hashes"),
                         flags.alias("flags"), F.size("scripts").alias("n_scripts"))


@query("feed_slug", r"""
SELECT DISTINCT name, trim(regexp_replace(lower(trim(name)), '[^a-z0-9\p{Han}]+', '-', 'g'), '-') AS slug FROM (
  SELECT ' ' || p_name || ' (' || p_brand || ') 致远OA! ' AS name FROM part)""")
def feed_slug(spark, sf):
    name = F.concat(F.lit(" "), F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") 致远OA! "))
    return table(spark, sf, "part").select(name.alias("name")).distinct().withColumn("slug", slug(F.col("name")))


