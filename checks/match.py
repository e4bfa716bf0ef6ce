"""Matchers, folding, closure, dictionary: queries over captures x the core pack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import captures, core_pack, query, sql_text, sql_values, table, with_captures
from sigweave.operators import closure, favicons, folding, matching
from sigweave.plans import detect
from sigweave.sources.pack import RulePack

# What the SQL side knows about the pack, stated by hand.
INVALID = {"(unclosed", "(?=ahead)nothing", "x++", ""}
EXPRESSIONS = {
    'contains(body, "track(") && status == 200': "contains(body, 'track(') AND status = 200",
    'matches(title, "^[A-Z]")': "regexp_matches(title, '^[A-Z]')",
    "status != \"404\" && !contains(url, 'utm_')": "status <> 404 AND NOT contains(url, 'utm_')",
    "nosuch == 1 || true": "NULL::BOOLEAN",
    "status == 200 || nosuch == 1": "CASE WHEN status = 200 THEN true END",
    "favicon_hash == 42 && nosuch": "CASE WHEN coalesce(favicon_hashes[1], 0) = 42 THEN NULL ELSE false END",
}


def version_sql() -> str:
    return r"""CASE version WHEN '' THEN '' WHEN '\1' THEN g1 WHEN '\1.\2' THEN g1 || '.' || g2
      WHEN '\1?v\1:none' THEN CASE WHEN g1 <> '' THEN 'v' || g1 ELSE 'none' END END"""


def match_sql(pack: RulePack) -> str:
    parts = "body title url header raw meta script".split()
    pats = sql_values("pats", ["pid", "mid", "pattern_ix", "type", "part", "pattern", "version", "number", "key", "valid"], [
        (p.pid, p.mid, p.pattern_ix, p.type, p.part if p.part in parts else "body", p.pattern, p.version,
         p.number if p.type in ("status", "icon_hash") else None, p.key,
         not (p.type == "regex" and p.pattern in INVALID) and p.type != "binary") for p in pack.patterns])
    matchers = sql_values("matchers", ["mid", "rule_ord", "matcher_ix", "type", "part", "condition", "negative", "confidence"], [
        (m.mid, m.rule_ord, m.matcher_ix, m.type, m.part, m.condition, m.negative, m.confidence) for m in pack.matchers])
    rules = sql_values("rules", ["rule_ord", "rule_id", "name", "condition", "n_matchers", "rule_conf"], [
        (r.rule_ord, r.rule_id, r.name, r.condition, r.n_matchers, r.confidence) for r in pack.rules])
    expressions = " UNION ALL ".join(
        f"SELECT capture_id, {sql_text(text)} AS pattern, {sql} AS value FROM texts" for text, sql in EXPRESSIONS.items())
    return f""",
{pats},
{matchers},
{rules},
found AS (
  SELECT capture_id, pid, pattern AS detail, version, '' AS g1, '' AS g2, false AS failed
  FROM parts JOIN pats USING (part) WHERE type = 'word' AND contains(lower(text), lower(pattern))
  UNION ALL
  SELECT capture_id, pid, regexp_extract(text, '(?i)' || pattern, 0), version,
    regexp_extract(text, '(?i)(?:' || pattern || ')()()', 1), regexp_extract(text, '(?i)(?:' || pattern || ')()()', 2), false
  FROM parts JOIN (SELECT * FROM pats WHERE type = 'regex' AND valid) USING (part) WHERE regexp_matches(text, '(?i)' || pattern)
  UNION ALL
  SELECT capture_id, pid, 'status ' || pattern, version, '', '', false FROM texts JOIN pats ON type = 'status' AND number = status
  UNION ALL
  SELECT capture_id, pid, 'mmh3 ' || pattern, version, '', '', false
  FROM (SELECT capture_id, unnest(list_distinct(favicon_hashes)) AS h FROM texts) JOIN pats ON type = 'icon_hash' AND number = h
  UNION ALL
  SELECT capture_id, pid, 'window.React.version = ' || react, version,
    regexp_extract(react, '(?:' || pattern || ')()', 1), '', false
  FROM texts JOIN pats ON type = 'js' AND key = 'React.version' WHERE react IS NOT NULL AND (pattern = '' OR regexp_matches(react, pattern))
  UNION ALL
  SELECT capture_id, pid, pattern, version, '', '', false FROM texts JOIN pats ON type = 'dom' AND pattern = '#__next' WHERE next_dom
  UNION ALL
  SELECT capture_id, pid, pattern, version, '', '', value IS NULL FROM ({expressions}) JOIN pats USING (pattern)
  WHERE type = 'dsl' AND (value IS NULL OR value)),
pattern_hits AS (
  SELECT capture_id, pid, mid, pattern_ix, type, part, pattern, failed,
    CASE WHEN type = 'regex' AND detail = '' THEN '(zero-width match)' WHEN length(detail) > 120 THEN detail[:120] || '…' ELSE detail END AS detail,
    {version_sql().replace('version', 'f.version')} AS version
  FROM found f JOIN pats USING (pid)),
counted AS (
  SELECT c.capture_id, m.*,
    (SELECT count(*) FROM pats x WHERE x.mid = m.mid) AS total,
    (SELECT count(*) FROM pats x WHERE x.mid = m.mid AND NOT x.valid) AS dead,
    coalesce(h.hits, 0) AS hits, coalesce(h.failures, 0) AS failures
  FROM captures c CROSS JOIN matchers m
  LEFT JOIN (SELECT capture_id, mid, count(*) FILTER (NOT failed) AS hits, count(*) FILTER (failed) AS failures FROM pattern_hits GROUP BY ALL) h
    ON h.capture_id = c.capture_id AND h.mid = m.mid),
matcher_state AS (
  SELECT *, CASE WHEN total = 0 THEN 'miss'
    WHEN condition = 'and' THEN CASE WHEN total - hits - dead - failures > 0 THEN 'miss' WHEN dead + failures > 0 THEN 'invalid' ELSE 'hit' END
    ELSE CASE WHEN hits > 0 THEN 'hit' WHEN dead + failures > 0 THEN 'invalid' ELSE 'miss' END END AS state
  FROM counted),
matcher_hits AS (SELECT * FROM matcher_state WHERE state = CASE WHEN negative THEN 'miss' ELSE 'hit' END),
evidence AS (
  SELECT h.capture_id, h.rule_ord, h.matcher_ix, coalesce(e.pattern_ix, 0) AS pattern_ix, h.type,
    CASE WHEN h.negative OR e.type IN ('word', 'regex') THEN CASE WHEN h.negative THEN h.part ELSE h.part END ELSE '' END AS part,
    CASE WHEN h.negative THEN 'negative holds: the condition was not met' ELSE e.detail END AS detail,
    CASE WHEN NOT h.negative AND e.type = 'regex' THEN e.pattern ELSE '' END AS pattern,
    CASE WHEN h.negative THEN '' ELSE e.version END AS version
  FROM matcher_hits h LEFT JOIN pattern_hits e ON NOT h.negative AND NOT e.failed AND e.capture_id = h.capture_id AND e.mid = h.mid),
rule_hits AS (
  SELECT h.capture_id, r.rule_ord, r.rule_id, r.name,
    CASE WHEN signal IS NULL THEN rule_conf WHEN rule_conf IS NULL THEN signal ELSE signal * rule_conf // 100 END AS confidence,
    coalesce(v.version, '') AS version
  FROM (SELECT capture_id, rule_ord, count(*) AS n_hit, max(confidence) AS hi, min(confidence) AS lo FROM matcher_hits GROUP BY ALL) h
  JOIN rules r ON r.rule_ord = h.rule_ord
  CROSS JOIN LATERAL (SELECT CASE WHEN r.condition = 'and' THEN lo ELSE hi END AS signal)
  LEFT JOIN (SELECT capture_id, rule_ord, arg_min(version, matcher_ix * 1000 + pattern_ix) AS version FROM evidence WHERE version <> '' GROUP BY ALL) v
    ON v.capture_id = h.capture_id AND v.rule_ord = h.rule_ord
  WHERE r.condition = 'or' OR n_hit = n_matchers)"""


def closure_sql(pack: RulePack) -> str:
    lookup = {}
    for rule in pack.source:
        lookup[rule["name"].lower()] = lookup[rule["id"].lower()] = rule
    edges = [(key, ix, name) for key, rule in lookup.items() for ix, name in enumerate(rule.get("implies", []))]
    bans = [(key, name.lower()) for key, rule in lookup.items() for name in rule.get("excludes", [])]
    return f""",
{sql_values("edges", ["src", "ix", "dst"], edges)},
{sql_values("banned_by", ["src", "banned"], bans)},
reach AS (
  WITH RECURSIVE walk AS (
    SELECT capture_id, lower(name) AS key, name, '' AS source, confidence, 0 AS level, [rule_ord] AS way FROM rule_hits
    UNION ALL
    SELECT w.capture_id, lower(e.dst), e.dst, w.name, w.confidence, w.level + 1, list_append(w.way, e.ix)
    FROM walk w JOIN edges e ON e.src = w.key WHERE w.level < 4)
  SELECT * FROM walk),
implied AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, key ORDER BY level, way) AS rn FROM reach) r
  WHERE rn = 1 AND level > 0),
closed AS (
  SELECT capture_id, rule_id, name, version, confidence, 0 AS level, [rule_ord] AS way, '' AS source FROM rule_hits
  UNION ALL
  SELECT capture_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), name, '', confidence, level, way, source FROM implied),
kept AS (
  SELECT * FROM closed c WHERE NOT EXISTS (
    SELECT 1 FROM closed o JOIN banned_by b ON b.src = lower(o.name) WHERE o.capture_id = c.capture_id AND b.banned = lower(c.name)))"""


PACK = core_pack()
MATCH = match_sql(PACK)
CLOSED = MATCH + closure_sql(PACK)

# Icon dictionary of the queries: two fixed names, one name per supplier, and a
# custom overlay by customer segment. Two captures' hashes are in the first part.
KNOWN_ICONS = {-1010568750: "Phpmyadmin", -1015932800: "Ghost Cms"}
DICTIONARY_SQL = """,
dictionary AS (SELECT -1010568750 AS hash, 'Phpmyadmin' AS name UNION ALL SELECT -1015932800, 'Ghost Cms'
  UNION ALL SELECT (s_suppkey + 1000)::INTEGER, s_name FROM supplier),
custom AS (SELECT CASE WHEN c_custkey = 0 THEN 42 ELSE (c_custkey + 500000)::INTEGER END AS hash, c_mktsegment AS name FROM customer)"""


def dictionary(spark, sf) -> DataFrame:
    known = reduce(DataFrame.union, [
        spark.range(1).select(F.lit(h).alias("hash"), F.lit(n).alias("name")) for h, n in KNOWN_ICONS.items()])
    return known.unionByName(table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000).cast("int").alias("hash"), F.col("s_name").alias("name")))


def custom_icons(spark, sf) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.when(c == 0, 42).otherwise((c + 500000).cast("int")).alias("hash"), F.col("c_mktsegment").alias("name"))


def _pattern_query(kind: str):
    def run(spark, sf):
        pack = core_pack()
        hits = matching.pattern_hits(captures(spark, sf), pack.only(kind))
        patterns = pack.only(kind).pattern_table(spark).select("pid", "pattern", "part")
        return hits.where("NOT failed").join(F.broadcast(patterns), "pid").select("capture_id", "pattern", "detail", "version")

    query(f"match_{kind}", with_captures(MATCH) + f"""
SELECT h.capture_id, h.pattern, h.detail, h.version FROM pattern_hits h WHERE type = '{kind}' AND NOT failed""")(run)


for _kind in ("word", "regex", "status", "icon_hash", "js", "dom"):
    _pattern_query(_kind)


@query("match_expr", with_captures(MATCH) + """
SELECT capture_id, pattern AS expression, failed FROM pattern_hits WHERE type = 'dsl'""")
def match_expr(spark, sf):
    hits = matching.pattern_hits(captures(spark, sf), core_pack(), ("dsl",))
    return hits.select("capture_id", F.col("detail").alias("expression"), "failed")


@query("match_invalid", with_captures(MATCH) + """
SELECT capture_id, mid, dead + failures AS n_invalid FROM counted WHERE dead + failures > 0""")
def match_invalid(spark, sf):
    """Conditions that are broken, on load or on a capture; they never hit."""
    caps, pack = captures(spark, sf), core_pack()
    dead = [m for m in pack.matchers if m.n_invalid]
    broken = caps.select("capture_id", F.inline(F.array(*[
        F.struct(F.lit(m.mid).alias("mid"), F.lit(m.n_invalid).alias("n")) for m in dead])))
    failed = matching.pattern_hits(caps, pack.only("dsl", "js")).where("failed").drop("detail", "version")
    pids = F.broadcast(pack.only("dsl", "js").pattern_table(spark).select("pid", "pattern", "type"))
    mids = F.broadcast(pack.pattern_table(spark).select("mid", "pattern", "type"))
    late = failed.join(pids, "pid").join(mids, ["pattern", "type"]).select("capture_id", "mid", F.lit(1).alias("n"))
    return broken.unionByName(late).groupBy("capture_id", "mid").agg(F.sum("n").alias("n_invalid"))


def _matcher_hits(spark, sf):
    caps, pack = captures(spark, sf), core_pack()
    return folding.matcher_hits(matching.pattern_hits(caps, pack, marked=True), pack)


@query("match_condition", with_captures(MATCH) + """
SELECT capture_id, mid, condition FROM matcher_hits WHERE NOT negative""")
def match_condition(spark, sf):
    meta = F.broadcast(core_pack().matcher_table(spark).select("mid", "condition", "negative"))
    return _matcher_hits(spark, sf).join(meta, "mid").where("NOT negative").select("capture_id", "mid", "condition")


@query("match_negative", with_captures(MATCH) + """
SELECT capture_id, mid, part, 'negative holds: the condition was not met' AS detail FROM matcher_hits WHERE negative""")
def match_negative(spark, sf):
    meta = F.broadcast(core_pack().matcher_table(spark).select("mid", "negative"))
    rows = _matcher_hits(spark, sf).join(meta, "mid").where("negative")
    return rows.select("capture_id", "mid", F.col("evidence")[0]["part"].alias("part"), F.col("evidence")[0]["detail"].alias("detail"))


def _rule_hits(spark, sf):
    return detect.rule_hits(captures(spark, sf), core_pack())


@query("match_rule_condition", with_captures(MATCH) + " SELECT capture_id, rule_ord, rule_id, name FROM rule_hits")
def match_rule_condition(spark, sf):
    return _rule_hits(spark, sf).select("capture_id", "rule_ord", "rule_id", "name")


@query("match_confidence", with_captures(MATCH) + " SELECT capture_id, rule_ord, confidence::INTEGER AS confidence FROM rule_hits")
def match_confidence(spark, sf):
    return _rule_hits(spark, sf).select("capture_id", "rule_ord", "confidence")


@query("match_hit_version", with_captures(MATCH) + " SELECT capture_id, rule_ord, version FROM rule_hits WHERE version <> ''")
def match_hit_version(spark, sf):
    return _rule_hits(spark, sf).where("version <> ''").select("capture_id", "rule_ord", "version")


@query("match_version", with_captures(MATCH) + """
SELECT capture_id, pattern, version FROM pattern_hits WHERE version <> ''""")
def match_version(spark, sf):
    pack = core_pack()
    hits = matching.pattern_hits(captures(spark, sf), pack).where("version <> ''")
    return hits.join(F.broadcast(pack.pattern_table(spark).select("pid", "pattern")), "pid").select("capture_id", "pattern", "version")


@query("match_evidence", with_captures(MATCH) + """
SELECT e.* FROM evidence e JOIN rule_hits r ON r.capture_id = e.capture_id AND r.rule_ord = e.rule_ord""")
def match_evidence(spark, sf):
    return _rule_hits(spark, sf).select("capture_id", "rule_ord", F.inline("evidence"))


@query("join_implies", with_captures(CLOSED) + " SELECT capture_id, rule_id, name, confidence::INTEGER AS confidence, level, source FROM closed WHERE level > 0")
def join_implies(spark, sf):
    pack = core_pack()
    closed = closure.add_implied(_rule_hits(spark, sf), pack).where("level > 0")
    return closed.select("capture_id", "rule_id", "name", "confidence", "level",
                         F.regexp_replace(F.col("evidence")[0]["detail"], "\\Aderived from ", "").alias("source"))


@query("join_excludes", with_captures(CLOSED) + " SELECT capture_id, rule_id, name FROM kept")
def join_excludes(spark, sf):
    pack = core_pack()
    return closure.drop_excluded(closure.add_implied(_rule_hits(spark, sf), pack), pack).select("capture_id", "rule_id", "name")


@query("join_favicon_dict", with_captures(DICTIONARY_SQL) + """
SELECT capture_id, hash, name FROM (
  SELECT capture_id, h.hash, coalesce(c.name, d.name) AS name, row_number() OVER (PARTITION BY capture_id, coalesce(c.name, d.name) ORDER BY ix) AS rn
  FROM (SELECT capture_id, unnest(list_filter(favicon_hashes, lambda x: x <> 0)) AS hash, generate_subscripts(list_filter(favicon_hashes, lambda x: x <> 0), 1) AS ix FROM captures) h
  LEFT JOIN dictionary d ON d.hash = h.hash LEFT JOIN custom c ON c.hash = h.hash
  WHERE coalesce(c.name, d.name) IS NOT NULL) WHERE rn = 1""")
def join_favicon_dict(spark, sf):
    named = favicons.icon_names(captures(spark, sf), dictionary(spark, sf), custom_icons(spark, sf))
    return named.groupBy("capture_id", "name").agg(F.min_by("hash", "hash_ix").alias("hash"))


FINAL_SQL = CLOSED + DICTIONARY_SQL + """,
icons AS (
  SELECT capture_id, 'icon-' || hash AS rule_id, name, ix FROM (
    SELECT capture_id, h.hash, coalesce(c.name, d.name) AS name, ix, row_number() OVER (PARTITION BY capture_id, coalesce(c.name, d.name) ORDER BY ix) AS rn
    FROM (SELECT capture_id, unnest(list_filter(favicon_hashes, lambda x: x <> 0)) AS hash, generate_subscripts(list_filter(favicon_hashes, lambda x: x <> 0), 1) - 1 AS ix FROM captures) h
    LEFT JOIN dictionary d ON d.hash = h.hash LEFT JOIN custom c ON c.hash = h.hash
    WHERE coalesce(c.name, d.name) IS NOT NULL) i
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.capture_id = i.capture_id AND k.name = i.name)),
final AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY level, way, rule_id) AS hit_ord FROM (
    SELECT capture_id, rule_id, name, version, confidence::INTEGER AS confidence, level, way FROM kept
    UNION ALL SELECT capture_id, rule_id, name, '', NULL, 1000000, [ix] FROM icons))"""


def detected(spark, sf):
    return detect.detect(captures(spark, sf), core_pack(), dictionary(spark, sf), custom_icons(spark, sf))


@query("match_detect", with_captures(FINAL_SQL) + " SELECT capture_id, hit_ord, rule_id, name, version, confidence FROM final")
def match_detect(spark, sf):
    return detect.with_position(detected(spark, sf)).select("capture_id", "hit_ord", "rule_id", "name", "version", "confidence")


@query("set_union_hits", with_captures(FINAL_SQL) + """
SELECT CASE level WHEN 0 THEN 'rule' WHEN 1000000 THEN 'icon' ELSE 'implied' END AS origin, count(*) AS n FROM final GROUP BY ALL""")
def set_union_hits(spark, sf):
    origin = F.when(F.col("level") == 0, "rule").when(F.col("level") == favicons.ICON_LEVEL, "icon").otherwise("implied")
    return detected(spark, sf).groupBy(origin.alias("origin")).agg(F.count(F.lit(1)).alias("n"))


# A large generated pack.
GENERATED = 2000
COMMON = ["the", "tion", "nav", "article", "class", "track", "href", "lang", "meta", "script"]
TAILS = ["and", "her", "ing", "con"]
STARTS = ["res", "nter", "ther"]


def generated_pack(n: int = GENERATED) -> RulePack:
    out = []
    for k in range(n):
        if k % 2:
            matcher = {"type": "word", "part": "body", "words": [COMMON[k % 10] + TAILS[k % 4], f"tech{k}", f"track({k})"][: 1 + k % 3]}
        else:
            start = f"/({COMMON[k % 10]}|{STARTS[k % 3]})[a-z]*{k % 10}?\">"
            matcher = {"type": "regex", "part": "body", "regex": [f"track\\(({k})\\)", start][: 1 + (k % 4 == 0)]}
        out.append({"id": f"gen-{k}", "name": f"Generated {k}", "matchers": [matcher]})
    return RulePack(out)


@query("match_candidates", f"""
WITH numbers AS (SELECT k::INTEGER AS k FROM range({GENERATED}) r(k)),
common AS (SELECT {COMMON!r} AS c, {TAILS!r} AS s, {STARTS!r} AS t),
pats AS (
  SELECT k, 'word' AS type, unnest([c[k % 10 + 1] || s[k % 4 + 1], 'tech' || k, 'track(' || k || ')'][:1 + k % 3]) AS pattern FROM numbers, common WHERE k % 2 = 1
  UNION ALL
  SELECT k, 'regex', unnest(['track\\((' || k || ')\\)', '/(' || c[k % 10 + 1] || '|' || t[k % 3 + 1] || ')[a-z]*' || (k % 10) || '?">'][:1 + (k % 4 = 0)::INT]) FROM numbers, common WHERE k % 2 = 0),
hits AS (
  SELECT page_id, k, pattern FROM pages JOIN (SELECT k, pattern FROM pats WHERE type = 'word') ON contains(lower(html), lower(pattern))
  UNION ALL
  SELECT page_id, k, pattern FROM pages JOIN (SELECT DISTINCT pattern FROM pats WHERE type = 'regex') ON regexp_matches(html, '(?i)' || pattern)
    JOIN pats USING (pattern))
SELECT page_id AS capture_id, 'gen-' || k AS rule_id, pattern FROM hits""")
def match_candidates(spark, sf):
    pack = generated_pack()
    rules = F.broadcast(pack.rule_table(spark).select("rule_ord", "rule_id"))
    mids = F.broadcast(pack.matcher_table(spark).select("mid", "rule_ord"))
    pids = F.broadcast(pack.pattern_table(spark).select("pid", "mid", "pattern"))
    hits = matching.text_hits(captures(spark, sf), pack)
    return hits.join(pids, "pid").join(mids, "mid").join(rules, "rule_ord").select("capture_id", "rule_id", "pattern")
