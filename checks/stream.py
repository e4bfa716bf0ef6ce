"""Streams, each drained to its end and compared with the batch result.

Rows are written in order of time as slices, one per micro-batch; a slice has as many
files as its rows ask for.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import CAPTURES_SQL, captures, core_pack, query, table, with_captures
from checks.match import CLOSED, FINAL_SQL, closure_sql, custom_icons, dictionary, match_sql
from sigweave.operators import reports
from sigweave.plans import detect
from sigweave.schema import RULE
from sigweave.session import stored
from sigweave.sources.pack import RulePack
from sigweave.streaming import captures as streams
from sigweave.streaming import quiet
from sigweave.streaming.runtime import read_stream, work_dir
from sigweave.streaming.tables import RuleVersions

SLICES = 6
ROWS_PER_FILE = 100_000


def as_stream(df, order: str, slices: int = SLICES):
    """Write rows as slices in order of a column, one after the other, and read them as a
    stream of one slice a micro-batch; a file source takes files by age."""
    spark = df.sparkSession
    path = work_dir(spark, "stream-in")
    sliced = stored(df.repartitionByRange(slices, order).withColumn("_slice", F.spark_partition_id()), "slices")
    sizes = {r["_slice"]: r["count"] for r in sliced.groupBy("_slice").count().collect()}
    files = max(1, math.ceil(max(sizes.values(), default=1) / ROWS_PER_FILE))
    for n in sorted(sizes):
        sliced.where(F.col("_slice") == n).drop("_slice").repartition(files).write.mode("append").parquet(path)
    return read_stream(spark, path, df.schema, files)


@query("st_match", with_captures(FINAL_SQL) + " SELECT capture_id, rule_id, name, version FROM final")
def st_match(spark, sf):
    out = work_dir(spark, "st-match")
    streams.match_stream(as_stream(captures(spark, sf), "at"), core_pack(), out, work_dir(spark, "state"), dictionary(spark, sf), custom_icons(spark, sf))
    return spark.read.parquet(out).select("capture_id", "rule_id", "name", "version")


@query("st_latest_capture", with_captures("") + """
SELECT tab_id, capture_id, url FROM (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY seen_at DESC) AS rn FROM captures) WHERE rn = 1""")
def st_latest_capture(spark, sf):
    latest = streams.latest_captures(work_dir(spark, "st-latest"))
    rows = captures(spark, sf).select("tab_id", "capture_id", "url", "at")
    streams.keep_newest(as_stream(rows, "at"), latest, work_dir(spark, "state"))
    return latest.read(spark).select("tab_id", "capture_id", "url")


@query("st_drop_late", """
WITH responses AS (SELECT user_id AS tab_id, event_id - CASE WHEN event_id % 7 = 0 THEN 5000 ELSE 0 END AS nav_seq, (200 + event_id % 5)::INTEGER AS status FROM events)
SELECT tab_id, arg_max(status, nav_seq) AS status, max(nav_seq) AS nav_seq FROM responses GROUP BY ALL""")
def st_drop_late(spark, sf):
    e = F.col("event_id")
    responses = table(spark, sf, "events").select(
        F.col("user_id").alias("tab_id"), (e - F.when(e % 7 == 0, 5000).otherwise(0)).alias("nav_seq"), (200 + e % 5).cast("int").alias("status"), F.col("ts").alias("at"))
    current = streams.current_responses(work_dir(spark, "st-response"))
    streams.keep_newest(as_stream(responses, "at"), current, work_dir(spark, "state"))
    return current.read(spark).select("tab_id", "status", "nav_seq")


# The events are minutes apart, so the quiet times are stretched: what matters is that a
# tab rests for the gap. Rows count once the watermark, ten seconds behind, has passed them.
RESTED_SQL = "(SELECT make_timestamp((epoch_ms(max({0})) - 10000) * 1000) FROM {1})"


@query("st_route_debounce", f"""
WITH routes AS (SELECT user_id AS tab_id, ts, '/r/' || (event_id % 3) AS url FROM events),
passed AS (SELECT *, lag(url) OVER w AS before, lag(ts) OVER w AS earlier FROM routes WHERE ts < {RESTED_SQL.format('ts', 'routes')} + INTERVAL 1 MILLISECOND
  WINDOW w AS (PARTITION BY tab_id ORDER BY ts)),
changes AS (SELECT tab_id, ts, url FROM passed WHERE before IS DISTINCT FROM url OR ts - earlier > INTERVAL 1 DAY),
waited AS (SELECT *, lead(ts) OVER (PARTITION BY tab_id ORDER BY ts) AS later FROM changes)
SELECT tab_id, epoch_us(ts) AS at_us, url FROM waited
WHERE coalesce(later - ts >= INTERVAL 2 HOUR, ts + INTERVAL 2 HOUR <= {RESTED_SQL.format('ts', 'routes')})""")
def st_route_debounce(spark, sf):
    routes = table(spark, sf, "events").select(F.col("user_id").alias("tab_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("/r/"), (F.col("event_id") % 3).cast("string")).alias("url"))
    out = work_dir(spark, "st-routes")
    settled = quiet.settled_routes(as_stream(routes, "ts"), gap="2 hours", idle="1 day")
    settled.writeStream.format("parquet").outputMode("append").option("checkpointLocation", work_dir(spark, "state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(settled.schema).parquet(out)


# Icons of a tab, and its pages with the hashes they bring, 3607 seconds apart.
ICON_HASH = "CASE event_id % 50 WHEN 0 THEN -1010568750 WHEN 1 THEN 7 WHEN 2 THEN 42 WHEN 3 THEN 0 ELSE event_id % 50 + 1000 END"
OWN_ICONS = next(line for line in CAPTURES_SQL.splitlines() if line.strip().endswith("AS favicon_hashes,"))
SETTLED_SQL = f"""
own AS (SELECT page_id AS capture_id, page_id % 20 AS tab_id, TIMESTAMP '2024-01-01' + to_seconds(3607 * page_id) AS ts,
  CASE page_id % 10 WHEN 0 THEN [-1010568750] WHEN 1 THEN [42, -1015932800] WHEN 2 THEN [0] ELSE []::INTEGER[] END AS hashes FROM pages),
late_icons AS (SELECT user_id % 20 AS tab_id, ts, ({ICON_HASH})::INTEGER AS hash FROM events),
rested AS (SELECT make_timestamp((epoch_ms(max(ts)) - 10000) * 1000) AS mark FROM (SELECT ts FROM own UNION ALL SELECT ts FROM late_icons)),
shown AS (SELECT *, lead(ts) OVER (PARTITION BY tab_id ORDER BY ts) AS until FROM own),
seen AS (
  SELECT s.tab_id, s.capture_id, i.hash, min(i.ts) AS ts, any_value(s.until) AS until, any_value(s.hashes) AS hashes
  FROM late_icons i JOIN shown s ON s.tab_id = i.tab_id AND i.ts >= s.ts AND (s.until IS NULL OR i.ts < s.until)
  WHERE i.hash <> 0 AND NOT list_contains(s.hashes, i.hash) AND i.ts <= (SELECT mark FROM rested) GROUP BY s.tab_id, s.capture_id, i.hash),
marks AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 HOUR, true)::INT AS fresh FROM seen WINDOW w AS (PARTITION BY tab_id, capture_id ORDER BY ts)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY tab_id, capture_id ORDER BY ts) AS n FROM marks),
settled AS (
  SELECT tab_id, capture_id, n, max(ts) + INTERVAL 2 HOUR AS closed, list_sort(list(hash)) AS fresh, any_value(hashes) AS hashes FROM runs
  GROUP BY tab_id, capture_id, n HAVING max(ts) + INTERVAL 2 HOUR <= least(coalesce(any_value(until), (SELECT mark FROM rested)), (SELECT mark FROM rested))),
last AS (SELECT tab_id, capture_id, arg_max(closed, closed) AS closed FROM settled GROUP BY tab_id, capture_id
  QUALIFY row_number() OVER (PARTITION BY tab_id ORDER BY max(closed) DESC) = 1),
gathered AS (
  SELECT l.tab_id, l.capture_id, l.closed, list_concat(any_value(s.hashes), flatten(list(s.fresh ORDER BY s.n))) AS all_hashes
  FROM last l JOIN settled s USING (tab_id, capture_id) GROUP BY ALL),"""


@query("st_icon_sessions", "WITH " + SETTLED_SQL + CAPTURES_SQL.replace(
    OWN_ICONS, "    (SELECT any_value(g.all_hashes) FROM gathered g WHERE g.capture_id = page_id) AS favicon_hashes,").replace(
    "  FROM pages),", "  FROM pages WHERE page_id IN (SELECT capture_id FROM gathered)),") + FINAL_SQL + """
SELECT tab_id, capture_id, epoch_us(closed) AS closed_us, array_to_string(all_hashes, ',') AS hashes,
  (SELECT string_agg(rule_id, ',' ORDER BY hit_ord) FROM final f WHERE f.capture_id = g.capture_id) AS hits FROM gathered g""")
def st_icon_sessions(spark, sf):
    """Hits of each tab's page after the icons that came late."""
    caps = captures(spark, sf)
    pages = caps.select(
        F.col("tab_id").cast("long").alias("tab_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("capture_id") * 3607).alias("ts"), "capture_id", F.col("favicon_hashes").alias("hashes"))
    icons = table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("tab_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("capture_id"), F.array(F.expr(ICON_HASH).cast("int")).alias("hashes"))
    settled = quiet.settled_icons(as_stream(pages.unionByName(icons), "ts", slices=3), gap="2 hours", idle="60 days")
    found = streams.rematch_table(work_dir(spark, "st-icons"))
    streams.rematch_stream(settled, caps, core_pack(), found, work_dir(spark, "state"), dictionary(spark, sf), custom_icons(spark, sf))
    return found.read(spark).select(
        "tab_id", "capture_id", "closed_us", F.array_join(F.transform("favicon_hashes", lambda h: h.cast("string")), ",").alias("hashes"),
        F.when(F.size("hits") > 0, F.array_join("hits.rule_id", ",")).alias("hits"))


def _changed_rules() -> list[dict]:
    """The core pack after an edit: one rule dropped, one with another status, one new."""
    kept = [r for r in core_pack().source if r["id"] != "nginx"]
    edited = [{**r, "matchers": [{**m, "status": [500]} if m["type"] == "status" else m for m in r["matchers"]]} for r in kept]
    return [*edited, {"id": "late-rule", "name": "Late", "implies": ["PHP"], "matchers": [{"type": "word", "part": "url", "words": ["example.net"]}]}]


CHANGED = RulePack(_changed_rules())


@query("st_rule_change_rescan", " UNION ALL ".join(
    f"SELECT {n} AS version_of_rules, * FROM ({with_captures(match_sql(pack) + closure_sql(pack))} SELECT capture_id, rule_id, name, version FROM kept)" for n, pack in ((1, core_pack()), (2, CHANGED))))
def st_rule_change_rescan(spark, sf):
    """Every stored capture is matched again after changes came to rest. The second version
    of the rules is published while the stream runs."""
    rules = RuleVersions(work_dir(spark, "rules"))
    kind = T.StructType([T.StructField("rule_ord", T.IntegerType()), T.StructField("rule", RULE)])
    docs = lambda pack: spark.createDataFrame([(n, r) for n, r in enumerate(pack.source)], kind)
    rules.publish(docs(core_pack()), 1)
    events = table(spark, sf, "events")
    half = F.unix_seconds("ts") >= 1705363200
    changes = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("scope")).withColumn("version", F.when(half, 2).otherwise(1))
    settled = streams.settled_changes(as_stream(changes, "ts", slices=3), gap="5 minutes")
    out = work_dir(spark, "st-rescan")

    def stored_captures():
        # Somebody edits the rules after the first rescan.
        rules.publish(docs(CHANGED), 2)
        return captures(spark, sf)

    streams.rescan_stream(settled, stored_captures, rules, out, work_dir(spark, "state"))
    return streams.read_rescans(spark, out)


@query("st_history_upsert", with_captures(CLOSED) + """,
latest AS (SELECT split_part(url, '#', 1) AS url, max(capture_id) AS capture_id FROM captures GROUP BY ALL ORDER BY max(capture_id) DESC LIMIT 200)
SELECT url, capture_id, coalesce((SELECT string_agg(rule_id || '=' || version, ',' ORDER BY level, way, rule_id) FROM kept k WHERE k.capture_id = l.capture_id), '') AS hits FROM latest l""")
def st_history_upsert(spark, sf):
    caps = captures(spark, sf).withColumn("url", F.regexp_replace("url", "#.*\\z", ""))
    hits = detect.detect(captures(spark, sf), core_pack())
    history = streams.history_table(work_dir(spark, "st-history"))
    streams.history_stream(as_stream(reports.scan_history(caps, hits, F.lit("page"), F.col("at")), "at"), history, work_dir(spark, "state"))
    kept = streams.read_history(history, spark, 200)
    return kept.select("url", "capture_id", F.array_join(F.transform("hits", lambda h: F.concat(h["id"], F.lit("="), h["version"])), ",").alias("hits"))
