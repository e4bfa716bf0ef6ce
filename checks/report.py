"""Rollups, rankings, batch jobs and report layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import captures, core_pack, query, table, with_captures
from checks.match import FINAL_SQL, custom_icons, detected, dictionary
from sigweave.operators import reports
from sigweave.plans import jobs
from sigweave.sources import sinks
from sigweave.streaming.runtime import work_dir

FINAL = with_captures(FINAL_SQL)


@query("agg_hit_counts", FINAL + """
SELECT c.capture_id, count(f.name) AS n_hits FROM captures c LEFT JOIN final f USING (capture_id) GROUP BY ALL""")
def agg_hit_counts(spark, sf):
    return reports.hit_counts(captures(spark, sf), detected(spark, sf))


@query("agg_tech_prevalence", FINAL + " SELECT name, count(DISTINCT capture_id) AS n_captures FROM final GROUP BY ALL")
def agg_tech_prevalence(spark, sf):
    return reports.tech_prevalence(detected(spark, sf))


@query("win_first_hit", FINAL + " SELECT capture_id, rule_id, name, version FROM final WHERE hit_ord = 1")
def win_first_hit(spark, sf):
    return reports.first_hits(detected(spark, sf))


BOOKMARKS_SQL = """,
bookmarks AS (SELECT capture_id * 10 AS bookmark_id, capture_id, CASE WHEN capture_id % 9 = 8 THEN 'javascript:' || url ELSE url END AS url FROM captures),
chosen AS (SELECT * FROM bookmarks WHERE regexp_matches(url, '^https?:') AND bookmark_id % 20 = 0),
classified AS (SELECT b.bookmark_id, f.name FROM chosen b LEFT JOIN final f ON f.capture_id = b.capture_id AND hit_ord = 1)"""


@query("agg_bookmark_groups", FINAL + BOOKMARKS_SQL + " SELECT coalesce(name, '') AS name, count(*) AS n, min(bookmark_id) AS first_id FROM classified GROUP BY ALL")
def agg_bookmark_groups(spark, sf):
    caps = captures(spark, sf)
    marks = caps.select((F.col("capture_id") * 10).alias("bookmark_id"), "capture_id", F.when(
        F.col("capture_id") % 9 == 8, F.concat(F.lit("javascript:"), F.col("url"))).otherwise(F.col("url")).alias("url"))
    only = marks.where("bookmark_id % 20 = 0").select("bookmark_id")
    groups = jobs.bookmark_scan(marks, caps, core_pack(), only, dictionary(spark, sf), custom_icons(spark, sf))
    return groups.groupBy(F.coalesce("name", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("bookmark_id").alias("first_id"))


@query("agg_confidence_stats", FINAL + """
SELECT capture_id, count(confidence) AS annotated, count(*) FILTER (confidence < 60) AS hidden,
  count(*) FILTER (confidence IS NULL OR confidence >= 60) AS visible FROM final GROUP BY ALL""")
def agg_confidence_stats(spark, sf):
    return reports.confidence_stats(detected(spark, sf), 60)


@query("sort_confidence", FINAL + """
SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY confidence DESC NULLS LAST, hit_ord)::INTEGER AS place, rule_id, name, confidence
FROM final WHERE confidence IS NULL OR confidence >= 40""")
def sort_confidence(spark, sf):
    return reports.visible_hits(detected(spark, sf), 40)


@query("win_topk_hits", FINAL + """,
ev AS (SELECT capture_id, rule_ord, count(*) AS n FROM evidence GROUP BY ALL)
SELECT f.capture_id, count(*) OVER (PARTITION BY f.capture_id)::INTEGER AS total_hits, hit_ord::INTEGER AS hit_ord, rule_id, name, version, confidence,
  least(6, CASE WHEN level = 0 THEN ev.n ELSE 1 END)::INTEGER AS n_evidence
FROM final f LEFT JOIN ev ON level = 0 AND ev.capture_id = f.capture_id AND ev.rule_ord = f.way[1]""")
def win_topk_hits(spark, sf):
    return reports.display_hits(detected(spark, sf)).withColumn("n_evidence", F.size("evidence")).drop("evidence")


TARGETS_SQL = """,
inputs AS (
  SELECT capture_id * 4 AS ord, url FROM captures
  UNION ALL SELECT capture_id * 4 + 1, '  ' || url || '#again ' FROM captures WHERE capture_id % 3 = 0
  UNION ALL SELECT capture_id * 4 + 2, 'ftp://' || capture_id FROM captures WHERE capture_id % 5 = 0
  UNION ALL SELECT capture_id * 4 + 3, 'https://gone.example.com/' || capture_id % 11 FROM captures),
clean AS (SELECT ord, url, CASE WHEN trim(url) LIKE 'http%' THEN split_part(trim(url), '#', 1) END AS target FROM inputs),
verdicts AS (SELECT ord, target, CASE WHEN target IS NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY target ORDER BY ord) = 1 THEN 'kept' ELSE 'duplicate' END AS verdict FROM clean)"""


def _inputs(spark, sf):
    c = F.col("capture_id")
    caps = captures(spark, sf).select("capture_id", "url")
    return (
        caps.select((c * 4).alias("ord"), "url")
        .unionByName(caps.where(c % 3 == 0).select((c * 4 + 1).alias("ord"), F.concat(F.lit("  "), F.col("url"), F.lit("#again ")).alias("url")))
        .unionByName(caps.where(c % 5 == 0).select((c * 4 + 2).alias("ord"), F.concat(F.lit("ftp://"), c.cast("string")).alias("url")))
        .unionByName(caps.select((c * 4 + 3).alias("ord"), F.concat(F.lit("https://gone.example.com/"), (c % 11).cast("string")).alias("url"))))


@query("set_dedup_targets", with_captures(TARGETS_SQL) + " SELECT ord, target, verdict FROM verdicts")
def set_dedup_targets(spark, sf):
    return reports.classify_targets(_inputs(spark, sf)).select("ord", "target", "verdict")


# A page answers for its own address; equal addresses are answered by the first.
BATCH_SQL = FINAL_SQL + TARGETS_SQL + """,
pages_by_url AS (SELECT split_part(url, '#', 1) AS target, min(capture_id) AS capture_id FROM captures GROUP BY ALL),
scans AS (SELECT v.target, p.capture_id FROM verdicts v LEFT JOIN pages_by_url p USING (target) WHERE verdict = 'kept'),
totals AS (SELECT capture_id, count(*) AS total_hits FROM final GROUP BY ALL)"""


def _batch(spark, sf):
    return jobs.batch_scan(_inputs(spark, sf), captures(spark, sf), detected(spark, sf))


@query("win_batch_topk", with_captures(BATCH_SQL) + """
SELECT s.target AS requested_url, c.url AS final_url, c.title[:300] AS title, c.status, total_hits::INTEGER AS total_hits,
  list_sum(list_transform([1], lambda x: least(total_hits, 20)))::INTEGER AS n_shown, f.name AS first_name
FROM scans s JOIN captures c USING (capture_id) JOIN totals USING (capture_id) JOIN final f ON f.capture_id = c.capture_id AND f.hit_ord = 1""")
def win_batch_topk(spark, sf):
    return reports.batch_display(_batch(spark, sf).results).select("requested_url", "final_url", "title", "status", "total_hits", F.size("hits").alias("n_shown"),
                          F.col("hits")[0]["name"].alias("first_name"))


@query("agg_batch_counters", with_captures(BATCH_SQL) + """
SELECT count(*) FILTER (verdict = 'kept') AS total, count(*) FILTER (verdict = 'invalid') AS invalid, count(*) FILTER (verdict = 'duplicate') AS duplicate,
  (SELECT count(capture_id) FROM scans) AS completed, (SELECT count(*) FROM scans WHERE capture_id IS NULL) AS failed FROM verdicts""")
def agg_batch_counters(spark, sf):
    return _batch(spark, sf).counters


@query("sink_batch_csv", with_captures(BATCH_SQL) + """
SELECT s.target AS requested_url, c.url AS final_url, c.title[:300] AS title, c.status::VARCHAR AS status, total_hits::VARCHAR AS total_hits,
  f.rule_id AS fingerprint_id, f.name AS fingerprint_name, f.version, coalesce(f.confidence::VARCHAR, '') AS confidence, '' AS error
FROM scans s JOIN captures c USING (capture_id) JOIN totals USING (capture_id) JOIN final f ON f.capture_id = c.capture_id
UNION ALL SELECT target, '', '', '', '', '', '', '', '', 'not stored' FROM scans WHERE capture_id IS NULL""")
def sink_batch_csv(spark, sf):
    scan = _batch(spark, sf)
    folder = work_dir(spark, "batch-csv")
    sinks.write_csv(sinks.batch_table(scan.results, scan.failures), folder)
    return sinks.read_csv(spark, folder, sinks.BATCH_CSV)


@query("sink_batch_json", with_captures(BATCH_SQL) + """
SELECT 'result' AS kind, s.target AS url, total_hits::INTEGER AS total_hits, '' AS error,
  (SELECT string_agg(rule_id || '|' || name || '|' || coalesce(confidence::VARCHAR, 'null') || '|' || version, ';' ORDER BY hit_ord) FROM final f WHERE f.capture_id = s.capture_id) AS hits FROM scans s JOIN totals USING (capture_id)
UNION ALL SELECT 'failure', target, 0, 'not stored', '' FROM scans WHERE capture_id IS NULL
UNION ALL SELECT 'counters', '', (SELECT count(*) FROM scans)::INTEGER, '', ''""")
def sink_batch_json(spark, sf):
    scan = _batch(spark, sf)
    folder = work_dir(spark, "batch-json")
    lines = sinks.batch_report(scan.counters, scan.results, scan.failures)
    sinks.write_lines(lines.select(F.to_json(F.struct("kind", "value")).alias("value")), folder)
    get = lambda p: F.get_json_object("value", p)
    read = spark.read.text(folder).select(F.get_json_object("value", "$.kind").alias("kind"), F.get_json_object("value", "$.value").alias("value"))
    hits = F.from_json(get("$.detections"), "array<struct<id:string,name:string,confidence:int,version:string>>")
    told = F.transform(hits, lambda h: F.concat_ws("|", h["id"], h["name"], F.coalesce(h["confidence"].cast("string"), F.lit("null")), h["version"]))
    return read.select("kind", F.coalesce(get("$.requestedUrl"), get("$.url"), F.lit("")).alias("url"),
                       F.coalesce(get("$.totalHits"), get("$.total"), F.lit("0")).cast("int").alias("total_hits"),
                       F.coalesce(get("$.error"), F.lit("")).alias("error"), F.coalesce(F.array_join(told, ";"), F.lit("")).alias("hits"))


# History: every page scanned twice, the second time as part of a batch.
HISTORY_SQL = FINAL_SQL + """,
scans AS (
  SELECT capture_id, url, title, status, favicon_hashes, 'page' AS source, seen_at FROM captures
  UNION ALL SELECT capture_id, url, title, status, favicon_hashes, 'batch', seen_at + INTERVAL 1 DAY FROM captures WHERE capture_id % 2 = 0),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seen_at DESC, capture_id DESC) AS rn FROM scans) WHERE rn = 1)"""


def history(spark, sf):
    # Pages are matched once; a page that was scanned twice then gets both its times.
    once = reports.scan_history(captures(spark, sf), detected(spark, sf), F.lit("page"), F.col("at"))
    page = F.struct(F.lit("page").alias("source"), F.col("at").alias("at"))
    batch = F.struct(F.lit("batch").alias("source"), (F.col("at") + F.expr("INTERVAL 1 DAY")).alias("at"))
    times = F.when(F.col("capture_id") % 2 == 0, F.array(page, batch)).otherwise(F.array(page))
    return once.withColumn("_t", F.explode(times)).withColumns({"source": F.col("_t.source"), "at": F.col("_t.at")}).drop("_t")


@query("win_latest_per_url", with_captures(HISTORY_SQL) + """
SELECT url, capture_id, source, epoch(seen_at)::BIGINT AS at_s, coalesce(n, 0)::INTEGER AS n_hits FROM latest LEFT JOIN (SELECT capture_id, count(*) AS n FROM final GROUP BY ALL) USING (capture_id)""")
def win_latest_per_url(spark, sf):
    return reports.latest_per_url(history(spark, sf)).select("url", "capture_id", "source", F.unix_seconds("at").alias("at_s"), F.size("hits").alias("n_hits"))


@query("limit_history", with_captures(HISTORY_SQL) + " SELECT url, capture_id, source FROM latest ORDER BY seen_at DESC, capture_id DESC LIMIT 120")
def limit_history(spark, sf):
    return reports.newest(reports.latest_per_url(history(spark, sf)), 120).select("url", "capture_id", "source")


ISO = "strftime(seen_at, '%Y-%m-%dT%H:%M:%S.000Z')"
# Evidence of implied names and of the dictionary beside that of rules.
EVIDENCE_SQL = """,
shown AS (
  SELECT f.*, CASE WHEN f.level = 1000000 THEN 'icon_hash' WHEN f.level > 0 THEN 'implies' ELSE e.type END AS matcher, coalesce(e.part, '') AS location, coalesce(e.pattern, '') AS expression,
    CASE WHEN f.level = 1000000 THEN 'mmh3 ' || replace(f.rule_id, 'icon-', '') || ' (dictionary)' WHEN f.level > 0 THEN 'derived from ' || k.source ELSE e.detail END AS matched,
    coalesce(e.matcher_ix, 0) * 1000 + coalesce(e.pattern_ix, 0) AS e_ord
  FROM final f LEFT JOIN evidence e ON f.level = 0 AND e.capture_id = f.capture_id AND e.rule_ord = f.way[1]
  LEFT JOIN kept k ON f.level BETWEEN 1 AND 999999 AND k.capture_id = f.capture_id AND k.rule_id = f.rule_id AND k.level = f.level)"""
# A title with everything that has to be quoted, and an empty one.
ODD_TITLE_SQL = """CASE l.capture_id % 5 WHEN 0 THEN 'a "b", c' || chr(13) || chr(10) || 'd' WHEN 1 THEN '' WHEN 2 THEN '"' WHEN 3 THEN ' ' || l.title || ' ' ELSE l.title END"""


def odd_titles(rows):
    kind = F.col("capture_id") % 5
    return rows.withColumn("title", F.when(kind == 0, 'a "b", c\r\nd').when(kind == 1, "").when(kind == 2, '"').when(kind == 3, F.concat(F.lit(" "), "title", F.lit(" "))).otherwise(F.col("title")))


@query("sink_history_csv", with_captures(HISTORY_SQL + EVIDENCE_SQL) + f"""
SELECT {ISO} AS time, source, l.url, {ODD_TITLE_SQL} AS title, l.status::VARCHAR AS status, array_to_string(l.favicon_hashes, ' ') AS favicon_hash,
  f.rule_id AS fingerprint_id, f.name AS fingerprint_name, f.version, coalesce(f.confidence::VARCHAR, '') AS confidence, matcher, location, matched, expression
FROM latest l JOIN shown f USING (capture_id)""")
def sink_history_csv(spark, sf):
    """Written and read back: quotes, line ends and empty fields come through."""
    folder = work_dir(spark, "history-csv")
    sinks.write_csv(sinks.history_table(odd_titles(reports.latest_per_url(history(spark, sf)))), folder)
    return sinks.read_csv(spark, folder, sinks.HISTORY_CSV)


@query("sink_history_json", with_captures(HISTORY_SQL + EVIDENCE_SQL) + f"""
SELECT {ISO} AS timestamp, source, url, {ODD_TITLE_SQL} AS title, status, array_to_string(favicon_hashes, ' ') AS hashes,
  (SELECT string_agg(rule_id || '|' || version || '|' || coalesce(confidence::VARCHAR, 'null') || '|' || matcher || '|' || matched, ';' ORDER BY hit_ord, e_ord)
   FROM shown f WHERE f.capture_id = l.capture_id) AS detections FROM latest l""")
def sink_history_json(spark, sf):
    report = sinks.history_report(odd_titles(reports.latest_per_url(history(spark, sf))))
    folder = work_dir(spark, "history-json")
    sinks.write_json(report, folder)
    read = spark.read.schema(report.schema).json(folder)
    told = F.flatten(F.transform("detections", lambda h: F.transform(h["evidence"], lambda e: F.concat_ws(
        "|", h["id"], h["version"], F.coalesce(h["confidence"].cast("string"), F.lit("null")), e["matcher"], e["matched"]))))
    return read.select("timestamp", "source", "target.url", "target.title", "target.status", F.array_join(F.transform("target.faviconHashes", lambda h: h.cast("string")), " ").alias("hashes"),
                       F.nullif(F.array_join(told, ";"), F.lit("")).alias("detections"))


@query("limit_rules_filter", """
WITH found AS (SELECT p_partkey FROM part WHERE contains(lower('part-' || p_partkey || chr(10) || p_name), 'red'))
SELECT 'item' AS kind, 'part-' || p_partkey AS rule_id, 0::BIGINT AS total FROM (SELECT * FROM found ORDER BY p_partkey LIMIT 50)
UNION ALL SELECT 'total', '', count(*) FROM found""")
def limit_rules_filter(spark, sf):
    rules = table(spark, sf, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("rule_id"),
                                            F.col("p_name").alias("name"), F.col("p_partkey").alias("rule_ord"))
    items, total = reports.find_rules(rules, " RED ", 50)
    return items.select(F.lit("item").alias("kind"), "rule_id", F.lit(0).cast("bigint").alias("total")).unionByName(
        total.select(F.lit("total").alias("kind"), F.lit("").alias("rule_id"), "total"))
