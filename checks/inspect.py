"""Expressions, search, trials, probes, rule health and rule checks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from checks.base import NEXT_PROBE, captures, core_pack, query, sql_text, sql_values, table, with_captures
from checks.extract import RICH, rich_pages
from checks.feeds import fill
from checks.match import match_sql
from sigweave.functions.expressions import capture_values, try_column
from sigweave.operators import favicons, health, probes, quality, search
from sigweave.plans import detect
from sigweave.sources.pack import RulePack
from sigweave.streaming.runtime import work_dir

T, E = "true", "NULL::BOOLEAN"
EXPRESSIONS = {
    "expr_idents": [("status_code == 200 || status == 404", "status IN (200, 404)"), ("favicon_hash == -1010568750", "coalesce(favicon_hashes[1], 0) = -1010568750"),
                    ("contains(script, 'jquery') && contains(meta, 'WordPress')", "contains(script_text, 'jquery') AND contains(meta_text, 'WordPress')"),
                    ("contains(raw, 'nginx') && contains(header, 'PHP')", "contains(header_text, 'nginx') AND contains(header_text, 'PHP')"),
                    ("false || true", T), ("unknown_name", E), ("title != '' && body != '' && url != ''", "title <> '' AND body <> '' AND url <> ''")],
    "expr_contains": [("contains(title, 'The')", "contains(title, 'The')"), ("contains(url, status)", "contains(url, status::VARCHAR)"), ("contains(title)", E), ("contains(nope, 'x')", E)],
    "expr_matches": [("matches(url, '^https://(www|blog)\\.')", "regexp_matches(url, '^https://(www|blog)\\.')"), ("matches(title, '(?i)^the')", "regexp_matches(title, '(?i)^the')"),
                     ("matches(title, '(')", E), ("matches(url, status)", "contains(url, status::VARCHAR)")],
    "expr_eq_ne": [("status == \"200\"", "status = 200"), ("200 == 0200", T), ("status != 200", "status <> 200"), ("true == \"true\"", T), ("title == url", "title = url"), ("a == 1 == 2", E), ("'1' == 01", T)],
    "expr_and_or_not": [("status == 200 || status == 404 && contains(url, '/en/')", "status = 200 OR (status = 404 AND contains(url, '/en/'))"), ("!(status == 200) && !contains(url, 'http:')", "status <> 200 AND NOT contains(url, 'http:')"),
                        ("status == 200 && nosuch", "CASE WHEN status = 200 THEN NULL ELSE false END"), ("nosuch && status == 200", E), ("status == 200 || f(1)", "CASE WHEN status = 200 THEN true END"), ("! status == 200", "status <> 200")],
    "expr_truthiness": [("title", "title <> ''"), ("''", "false"), ("0 || 'x'", T), ("status", T), ("favicon_hash", "coalesce(favicon_hashes[1], 0) <> 0"), ("!''", T), ("'' || 0", "false")],
}


def _expression_query(name, pairs):
    rows = " UNION ALL ".join(f"SELECT capture_id, {sql_text(e)} AS expression, {sql} AS value FROM texts" for e, sql in pairs)

    @query(name, with_captures("") + f" SELECT capture_id, expression, coalesce(value, false) AS value, value IS NULL AS failed FROM ({rows})")
    def run(spark, sf):
        names = capture_values()
        results = F.array(*[F.struct(F.lit(e).alias("expression"), try_column(e, names).alias("value")) for e, _ in pairs])
        return captures(spark, sf).select("capture_id", F.inline(results)).select(
            "capture_id", "expression", F.coalesce("value", F.lit(False)).alias("value"), F.col("value").isNull().alias("failed"))


for _name, _pairs in EXPRESSIONS.items():
    _expression_query(_name, _pairs)
_expression_query("expr_many", [p for pairs in EXPRESSIONS.values() for p in pairs])


@query("search_body_kwic", r"""
WITH cut AS (SELECT page_id AS capture_id, html AS body, list_slice(string_split(lower(html), 'and'), 1, -1) AS pieces FROM pages),
ends AS (SELECT capture_id, body, i AS find, list_sum(list_transform(pieces[:i], lambda s: length(s))) + (i - 1) * 3 AS pos FROM cut, range(1, 11) r(i) WHERE i < len(pieces))
SELECT capture_id, find - 1 AS find, substr(body, greatest(pos - 120, 0)::BIGINT + 1, (least(pos, 120) + 123)::BIGINT) AS context FROM ends""")
def search_body_kwic(spark, sf):
    found = captures(spark, sf).select("capture_id", F.posexplode_outer(search.body_finds(F.col("body"), " AND ")).alias("find", "context"))
    return found.where("find IS NOT NULL").withColumn("find", F.col("find").cast("bigint"))


@query("search_js", with_captures("") + " SELECT capture_id, 'React.version' AS path, react AS value FROM texts WHERE contains(lower('React.version ' || react), '18.1')")
def search_js(spark, sf):
    return search.js_finds(captures(spark, sf), "18.1")


@query("search_rules", """
WITH rules AS (SELECT 'set-' || p_partkey % 5 AS set_id, p_partkey % 5 AS set_ord, p_partkey AS rule_ord, 'part-' || p_partkey AS rule_id, p_name AS name, '["' || p_brand || '"]' AS matchers FROM part)
SELECT set_id, rule_id, name, lower(name) = 'red widget' AS exact FROM rules WHERE contains(lower(rule_id || chr(10) || name || chr(10) || matchers), 'red widget')
ORDER BY lower(name) <> 'red widget', set_ord, rule_ord LIMIT 30""")
def search_rules(spark, sf):
    k = F.col("p_partkey")
    rules = table(spark, sf, "part").select(
        F.concat(F.lit("set-"), (k % 5).cast("string")).alias("set_id"), (k % 5).alias("set_ord"), k.alias("rule_ord"), F.concat(F.lit("part-"), k.cast("string")).alias("rule_id"),
        F.col("p_name").alias("name"), F.concat(F.lit('["'), F.col("p_brand"), F.lit('"]')).alias("matchers"))
    return search.rule_finds(rules, "Red Widget")


@query("page_overview", with_captures("") + """
SELECT capture_id, url, title, status, (1 + (powered IS NOT NULL)::INT)::INTEGER AS n_headers, (generator IS NOT NULL)::INTEGER AS n_meta, len(scripts)::INTEGER AS n_scripts, (react IS NOT NULL)::INTEGER AS n_js FROM texts""")
def page_overview(spark, sf):
    return search.page_overview(captures(spark, sf)).select("capture_id", "url", "title", "status", F.size("headers").alias("n_headers"), F.size("meta").alias("n_meta"),
                                                            F.size("scripts").alias("n_scripts"), F.size("js").alias("n_js"))


TRIALS = ["(?:license|copyright)\\W+\\w+", "\\b[a-z]+@[a-z.]+\\b", "token\\s*[:=]?\\s*\\S+", "(", "x{2}{3}", "^The .{0,300}", "é+\\w*"]


@query("trial_regex", "WITH " + ", ".join([f"tried(pattern) AS (VALUES {', '.join('(' + sql_text(t) + ')' for t in TRIALS if t not in ('(', 'x{2}{3}'))})"]) + """
SELECT doc_id, pattern, true AS valid, m AS matched, CASE WHEN NOT m THEN '' WHEN length(d) > 200 THEN d[:200] || '…' ELSE d END AS detail FROM (
  SELECT doc_id, pattern, regexp_matches(text, '(?i)' || pattern) AS m, regexp_extract(text, '(?i)' || pattern, 0) AS d FROM documents, tried)
UNION ALL SELECT doc_id, bad, false, false, '' FROM documents, (VALUES ('('), ('x{2}{3}')) b(bad)""")
def trial_regex(spark, sf):
    return search.try_patterns(table(spark, sf, "documents").select("doc_id", "text"), TRIALS)


@query("trial_words", """
SELECT doc_id, array_to_string(w, '|') AS words, len(w) < 2 AS none_of_both, len(w) > 0 AS any_word FROM (
  SELECT doc_id, list_filter(['License', 'THE', 'été'], lambda x: contains(lower(text), lower(x))) AS w FROM documents)""")
def trial_words(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    words = ["License", "THE", "été"]
    rows = search.try_words(docs, words)
    return rows.select("doc_id", F.array_join("matched_words", "|").alias("words"), (F.size("matched_words") < 2).alias("none_of_both"), F.col("matched").alias("any_word"))


@query("locate_evidence", r"""
WITH runs AS (
  SELECT page_id AS capture_id, string_split_regex(regexp_replace(regexp_replace(html, '(?is)<(?:script\b[\s\S]*?</script|style\b[\s\S]*?</style|noscript\b[\s\S]*?</noscript)>|<!--[\s\S]*?-->', '<>', 'g'),
    '(?is)<title[^>]*>(.*?)</title>', '<>', 'g'), '<[^>]*>') AS runs FROM pages),
found AS (SELECT capture_id, w, list_position(list_transform(runs, lambda r: contains(lower(r), lower(w))), true) AS spot, runs FROM runs, (VALUES ('The'), ('tion'), ('track(')) v(w))
SELECT capture_id, w AS detail, (spot - 1)::INTEGER AS run, strpos(lower(runs[spot]), lower(w))::INTEGER AS position FROM found WHERE spot > 0""")
def locate_evidence(spark, sf):
    caps = captures(spark, sf)
    hits = caps.select("capture_id", F.inline(F.array(*[
        F.struct(F.lit("word").alias("type"), F.lit(part).alias("part"), F.lit(w).alias("detail")) for w, part in (("The", "body"), ("tion…", "raw"), ("track(", "body"), ("The", "title"))])))
    found = search.locate(hits, caps)
    return found.withColumn("detail", F.regexp_replace("detail", "…\\z", ""))


DOM = [{"sel": "div.ad"}, {"sel": "a[href]"}, {"sel": "#missing"}, {"sel": "html", "attrs": {"lang": "^(en|fr)$"}}, {"sel": "link[rel~=icon]"}, {"sel": "nav > ul"}, {"sel": "p", "text": "x"},
       {"sel": "meta[charset='utf-8'], video"}, {"sel": "script[src$=\".js\"][async]"}, {"sel": "*", "attrs": {"property": "OG:"}}]


@query("dom_probe_offline", "WITH " + RICH + f""",
tags AS (SELECT capture_id, unnest(regexp_extract_all(body, '(?is)<[a-z][\\w-]*(?:\\s[^>]*)?>')) AS text FROM rich),
facts AS (SELECT capture_id, lower(regexp_extract(text, '<([A-Za-z][\\w-]*)', 1)) AS tag, text FROM tags)
SELECT DISTINCT capture_id, sel FROM (
  SELECT capture_id, 'div.ad' AS sel FROM facts WHERE tag = 'div' AND contains(text, 'class="ad"')
  UNION ALL SELECT capture_id, 'a[href]' FROM facts WHERE tag = 'a' AND regexp_matches(text, '(?i)\\shref=')
  UNION ALL SELECT capture_id, 'html' FROM facts WHERE tag = 'html' AND regexp_matches(text, 'lang="(en|fr)"')
  UNION ALL SELECT capture_id, 'link[rel~=icon]' FROM facts WHERE tag = 'link' AND regexp_matches(text, 'rel="shortcut icon"|rel=icon')
  UNION ALL SELECT capture_id, 'meta[charset=''utf-8''], video' FROM facts WHERE tag = 'meta' AND contains(text, 'charset')
  UNION ALL SELECT capture_id, '*' FROM facts WHERE contains(text, 'property=og:title'))""")
def dom_probe_offline(spark, sf):
    from sigweave.sources.pack import probe_key

    hits, _ = probes.offline_dom_hits(rich_pages(spark, sf), DOM)
    names = F.create_map(*[F.lit(x) for p in DOM for x in (probe_key(p["sel"], p.get("text") or "", p.get("attrs")), p["sel"])])
    return hits.select("capture_id", F.try_element_at(names, F.col("probe_id")).alias("sel"))


PROBE_RULE = json.dumps({"id": "p-§", "matchers": [
    {"type": "js", "js": [{"path": "Lib§.v"}, {"path": "Shared.x", "pattern": "1"}, {"path": ""}]}, {"type": "dom", "words": ["#a§", ".shared"], "dom": [{"sel": "#a§"}, {"sel": "img", "attrs": {"src": "x", "alt": "y§"}}]}]}, ensure_ascii=False)


def _probe_rules(spark, sf):
    from sigweave.sources.rules import typed_rules

    return typed_rules(table(spark, sf, "part").select(fill(F.lit(PROBE_RULE)).alias("doc")))


@query("set_probe_plan", """
SELECT 'path' AS kind, 'Lib' || p_partkey || '.v' AS name, '' AS attrs FROM part UNION ALL SELECT 'path', 'Shared.x', ''
UNION ALL SELECT 'dom', '#a' || p_partkey, '' FROM part UNION ALL SELECT 'dom', '.shared', '' UNION ALL SELECT 'dom', 'img', 'alt=y' || p_partkey || ';src=x' FROM part""")
def set_probe_plan(spark, sf):
    paths, dom = probes.plan(_probe_rules(spark, sf))
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return paths.select(F.lit("path").alias("kind"), F.col("path").alias("name"), F.lit("").alias("attrs")).unionByName(
        dom.select(F.lit("dom").alias("kind"), F.col("sel").alias("name"), F.coalesce(attrs, F.lit("")).alias("attrs")))


@query("dom_hit_selectors", with_captures("") + " SELECT capture_id, '#__next' AS selectors FROM texts WHERE next_dom")
def dom_hit_selectors(spark, sf):
    known = _probe_rules(spark, sf)
    _, dom = probes.plan(known)
    plan = dom.select("probe_id", "sel").unionByName(table(spark, sf, "pages").select(F.lit(NEXT_PROBE).alias("probe_id"), F.lit("#__next").alias("sel")).distinct())
    return probes.hit_selectors(captures(spark, sf), plan).withColumn("selectors", F.array_join("selectors", ","))


@query("agg_runtime_coverage", with_captures("") + """
SELECT capture_id, rule_id, CASE rule_id WHEN 'react' THEN CASE WHEN react IS NULL THEN 'React.version,Vue.version' ELSE 'Vue.version' END WHEN 'node-js' THEN 'process.version' ELSE '' END AS missing,
  rule_id = 'next-js' AS has_dom, false AS complete FROM texts, (VALUES ('react'), ('node-js'), ('next-js')) r(rule_id)""")
def agg_runtime_coverage(spark, sf):
    rows = probes.coverage(captures(spark, sf), core_pack())
    return rows.select("capture_id", "rule_id", F.array_join("missing_paths", ",").alias("missing"), "has_dom", "complete")


FORMS = [("¤-[0-9]+", "prefilterable", "small"), ("[0-9]+(?:a|b)?", "broad", ""), ("(§", "invalid", ""), ("é¤?", "non_ascii", ""), ("(?:§x|¤)+", "prefilterable", ""), ("é{1,2}", "non_ascii", ""), (".*", "broad", "")]
HEALTH_SQL = f"""
WITH forms(ix, form, kind) AS (VALUES {', '.join(f"({i}, {sql_text(f)}, {sql_text(k)})" for i, (f, k, _) in enumerate(FORMS))}),
pats AS (SELECT 'set-' || p_partkey % 3 AS set_id, p_partkey * 10 + ix AS ord, 'part-' || p_partkey AS rule_id, replace(replace(form, '§', p_partkey::VARCHAR), '¤', p_name) AS pattern, kind, p_name FROM part, forms)"""


def _health(spark, sf):
    k = F.col("p_partkey")
    forms = F.array(*[F.struct(F.lit(i).alias("ix"), F.lit(f).alias("form")) for i, (f, _, _) in enumerate(FORMS)])
    rows = table(spark, sf, "part").select("*", F.inline(forms)).select(
        F.concat(F.lit("set-"), (k % 3).cast("string")).alias("set_id"), (k * 10 + F.col("ix")).alias("ord"), F.concat(F.lit("part-"), k.cast("string")).alias("rule_id"),
        F.col("p_name").alias("name"), fill(F.col("form")).alias("pattern"))
    return health.classified(rows)


@query("agg_regex_health", HEALTH_SQL + """
SELECT set_id, count(*) AS total, count(*) FILTER (kind = 'prefilterable') AS prefilterable, count(*) FILTER (kind = 'non_ascii') AS non_ascii,
  count(*) FILTER (kind = 'broad') AS broad, count(*) FILTER (kind = 'invalid') AS invalid, 'invalid' AS grade FROM pats GROUP BY ALL""")
def agg_regex_health(spark, sf):
    return health.summary(_health(spark, sf))


@query("win_anchor_rank", HEALTH_SQL + """,
strong AS (SELECT *, length(regexp_replace(anchor, '[^A-Za-z0-9]', '', 'g'))::INTEGER AS strength FROM (
  SELECT set_id, ord, pattern, CASE WHEN ord % 10 = 0 THEN p_name || '-' WHEN length((ord // 10) || 'x') <= length(replace(p_name, ' ', '')) THEN (ord // 10) || 'x' ELSE p_name END AS anchor
  FROM pats WHERE kind = 'prefilterable')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY strength, pattern, ord) AS up, row_number() OVER (PARTITION BY set_id ORDER BY strength DESC, pattern, ord) AS down FROM strong)
SELECT set_id, 'short' AS list, up::INTEGER AS place, pattern, anchor, strength FROM ranked WHERE up <= 20
UNION ALL SELECT set_id, 'long', down::INTEGER, pattern, anchor, strength FROM ranked WHERE down <= 20""")
def win_anchor_rank(spark, sf):
    return health.anchor_ranking(_health(spark, sf)).select("set_id", "list", "place", "pattern", "anchor", "strength")


@query("win_issue_rank", HEALTH_SQL + """
SELECT set_id, kind, place::INTEGER AS place, pattern, rule_id FROM (
  SELECT *, row_number() OVER (PARTITION BY set_id, kind ORDER BY ord) AS place FROM (
    SELECT set_id, kind, pattern, min(ord) AS ord, arg_min(rule_id, ord) AS rule_id FROM pats WHERE kind IN ('broad', 'invalid') GROUP BY ALL)) WHERE place <= 50""")
def win_issue_rank(spark, sf):
    return health.issue_ranking(_health(spark, sf)).select("set_id", "kind", "place", "pattern", "rule_id")


GOOD = {"id": "ok-§", "name": "¤", "matchers-condition": "or", "confidence": 50, "matchers": [{"type": "word", "words": ["¤"]}]}
CHECKED = [
    (GOOD, []), ({**GOOD, "id": "", "confidence": 101, "matchers-condition": "xor"}, [("id", "invalid_string"), ("confidence", "out_of_range"), ("matchers-condition", "invalid_enum")]),
    ({**GOOD, "surprise": 1}, [("$", "invalid_json")]), ({**GOOD, "matchers": "none"}, [("$", "invalid_json")]), ({**GOOD, "implies": None, "excludes": []}, [("implies", "invalid_null"), ("excludes", "invalid_list")]),
    ({**GOOD, "matchers": []}, [("matchers", "invalid_list")]),
    ({**GOOD, "matchers": [{"type": "regex", "regex": ["a", "(§"], "words": ["x"]}]}, [("matchers[0].words", "unsupported_field"), ("matchers[0]", "invalid_payload")]),
    ({**GOOD, "matchers": [{"type": "regex", "regex": ["a", "(§"], "part": ""}]}, [("matchers[0].part", "invalid_enum"), ("matchers[0].regex[1]", "invalid_regex")]),
    ({**GOOD, "matchers": [{"type": "status", "status": [99, 200, 600]}, {"type": "odd", "odd": 1}]}, [("$", "invalid_json")]),
    ({**GOOD, "matchers": [{"type": "status", "status": [99, 200, 600], "confidence": -1}, {"type": "odd", "words": ["a"]}]},
     [("matchers[0].status[0]", "out_of_range"), ("matchers[0].status[2]", "out_of_range"), ("matchers[0].confidence", "out_of_range"), ("matchers[1].words", "unsupported_field"), ("matchers[1].type", "invalid_enum")]),
    ({**GOOD, "matchers": [{"type": "dsl", "dsl": ["status == §", "status = §"]}, {"type": "js", "js": [{"path": "", "pattern": "[§"}]}, {"type": "word", "words": ["a", " "], "part": "foot", "condition": "nor"}]},
     [("matchers[1].js[0].path", "invalid_string"), ("matchers[1].js[0].pattern", "invalid_regex"), ("matchers[0].dsl[1]", "invalid_dsl"), ("matchers[2].words[1]", "invalid_string"), ("matchers[2].part", "invalid_enum"), ("matchers[2].condition", "invalid_enum")]),
    ({**GOOD, "matchers": [{"type": "word", "words": ["w"] * 51}]}, [("matchers[0].words", "invalid_list")]),
]


def _checked(spark, sf):
    docs = F.array(*[F.struct(F.lit(i).alias("case"), F.lit(json.dumps(d, ensure_ascii=False)).alias("doc")) for i, (d, _) in enumerate(CHECKED)])
    return table(spark, sf, "part").select("*", F.inline(docs)).select("p_partkey", "case", fill(F.col("doc")).alias("doc"))


@query("rules_quality", "WITH " + sql_values("issues", ["kase", "path", "code"], [(i, p, c) for i, (_, found) in enumerate(CHECKED) for p, c in found])
       + ' SELECT p_partkey, kase AS "case", path, code FROM part, issues')
def rules_quality(spark, sf):
    return quality.check(_checked(spark, sf))


BACKTEST = [{"id": "t-nav", "name": "Nav", "matchers-condition": "or", "matchers": [{"type": "word", "words": ["<nav>"]}]},
            {"id": "t-fr", "name": "French", "matchers-condition": "and", "matchers": [{"type": "regex", "regex": ["lang=\"(fr|de)\""], "version": "\\1"}, {"type": "status", "status": [200]}]},
            {"id": "t-bad", "name": "Bad", "matchers-condition": "or", "matchers": [{"type": "regex", "regex": ["("]}]}]
BACKTEST_PACK = RulePack([r for r in BACKTEST if r["id"] != "t-bad"])


@query("rules_backtest", with_captures(match_sql(BACKTEST_PACK)) + " SELECT capture_id, rule_id, version FROM rule_hits")
def rules_backtest(spark, sf):
    docs = spark.createDataFrame([(r["id"], json.dumps(r), i) for i, r in enumerate(BACKTEST)], "rule_id string, doc string, rule_ord int")
    from sigweave.sources.rules import typed_rules

    passed = quality.passing(docs, quality.check(docs))
    pack = RulePack.from_table(typed_rules(passed.select("rule_ord", "doc")))
    return detect.rule_hits(captures(spark, sf), pack).select("capture_id", "rule_id", "version")


MURMUR_SQL = """
WITH icons AS (
  SELECT page_id AS capture_id, unnest([html, url[:58], html, url || chr(10)]) AS content FROM pages),
text AS (SELECT DISTINCT capture_id, regexp_replace(base64(encode(content)), '(.{76})', '\\1' || chr(10), 'g') || chr(10) AS t FROM icons),
codes AS (SELECT capture_id, list_transform(string_split(t, ''), lambda c: unicode(c)::HUGEINT) AS c, length(t) AS n FROM text),
blocks AS (
  SELECT capture_id, n, list_transform(range(0, n // 4), lambda i: c[4*i+1] + c[4*i+2] * 256 + c[4*i+3] * 65536 + c[4*i+4] * 16777216) AS k,
    coalesce(CASE WHEN n % 4 > 0 THEN c[n - n % 4 + 1] END, 0) + coalesce(CASE WHEN n % 4 > 1 THEN c[n - n % 4 + 2] END, 0) * 256
      + coalesce(CASE WHEN n % 4 > 2 THEN c[n - n % 4 + 3] END, 0) * 65536 AS rest FROM codes),
mixed AS (
  SELECT capture_id, n, list_transform(list_append(k, rest), lambda x: (((x * 3432918353) % 4294967296 * 32768) % 4294967296 + ((x * 3432918353) % 4294967296) // 131072) * 461845907 % 4294967296) AS m FROM blocks),
folded AS (
  SELECT capture_id, n, m, list_reduce(list_prepend(0::HUGEINT, m[1:len(m) - 1]),
    lambda h, x: (((xor(h, x) * 8192) % 4294967296 + xor(h, x) // 524288) * 5 + 3864292196) % 4294967296) AS h FROM mixed),
ends AS (SELECT capture_id, xor(xor(h, m[len(m)]), n::HUGEINT) AS a FROM folded),
e1 AS (SELECT capture_id, xor(a, a // 65536) * 2246822507 % 4294967296 AS b FROM ends),
e2 AS (SELECT capture_id, xor(b, b // 8192) * 3266489909 % 4294967296 AS d FROM e1),
hashes AS (SELECT capture_id, xor(d, d // 65536) AS u FROM e2)
SELECT capture_id, array_to_string(list_sort(list(DISTINCT (CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END)::INTEGER)), ',') AS hashes FROM hashes WHERE u <> 0 GROUP BY ALL"""


@query("favicon_hash_job", MURMUR_SQL)
def favicon_hash_job(spark, sf):
    """Icon bytes stand in from page text: three per page from a table, one from files."""
    pages = table(spark, sf, "pages")
    icons = pages.select(F.col("page_id").alias("capture_id"), F.explode(F.array(
        F.encode("html", "UTF-8"), F.encode(F.substring("url", 1, 58), "UTF-8"), F.encode("html", "UTF-8"))).alias("content"))
    folder = work_dir(spark, "icons")
    favicons.write_icon_lines(pages.select(F.col("page_id").alias("capture_id"), F.encode(F.concat("url", F.lit("\n")), "UTF-8").alias("content")), folder)
    both = icons.unionByName(favicons.icon_lines(spark, folder))
    return favicons.hash_icons(both).select("capture_id", F.array_join(F.transform("favicon_hashes", lambda h: h.cast("string")), ",").alias("hashes"))
