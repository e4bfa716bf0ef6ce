"""Feed conversion over documents made from the part table: one document per part
with its key, name and brand filled in. The SQL side states the expected rows of
the document by hand and fills in the same values."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from checks.base import query, sql_text, sql_values, table
from sigweave.sources import favicons, feeds, loose, rules
from sigweave.streaming.runtime import work_dir

TECH = json.dumps({"Tech §": {
    "headers": {"Server": "@/([0-9]+)\\;version:\\1\\;confidence:50", "x.Powered": "^on§", "A-Only": ""},
    "cookies": {"sid+§": "", "tok": "a+\\;confidence:50\\;version:\\1"},
    "meta": {"generator": ["¤ ([0-9.]+)\\;version:\\1", "^¤", 7]},
    "html": ["<div class=\"w-§\">", "x{2,300}y§", "(?=bad)", "a.b\\;confidence:200", "two\\\\words", "\\;confidence:3"],
    "scriptSrc": "js\\/¤\\;confidence:40", "url": ["^https?://§\\.", "z++"],
    "js": {"App.v": "^(\\d+)$\\;version:\\1", "App.bad": "(\\;confidence:30", "App.on": "", "B.list": ["b{2,40}", "c"]},
    "dom": {"#app-§": {"exists": ""}, "div": {"exists": ""}, "p": {"text": "hello §\\;confidence:60"}, "img": {"attributes": {"src": "logo§\\;version:\\1", "alt": ""}},
            ".x": {"properties": {"a": ""}}, "body > *": ""},
    "implies": ["Base §\\;confidence:50", "", "¤"], "excludes": "Other\\;version:1"}}, ensure_ascii=False)
LISTED = json.dumps({"Listed §": {"dom": ["div.w§\\;confidence:70", "*", "a, #b"], "html": "plain/§"}, "Empty §": {"implies": "Tech §"}}, ensure_ascii=False)

# Expected: tech, section, part, type, position, pattern, path, attrs, confidence, version, position of the matcher.
Q = "(?im)^"
EXPECTED = [
    ("Tech §", 0, "header", "regex", "0.1.0", Q + "server:[^\\n]*@/([0-9]+)", None, None, 50, "\\1", "0.1.0"),
    ("Tech §", 0, "header", "regex", "0.2.0", Q + "x\\.powered:\\s*on§", None, None, None, "", "0.2.0"),
    ("Tech §", 0, "header", "regex", "1.0.0", Q + "set-cookie:[^\\n]*sid\\+§=", None, None, None, "", "0.2.0"),
    ("Tech §", 0, "header", "regex", "1.1.0", Q + "set-cookie:[^\\n]*tok=a+", None, None, 50, "\\1", "0.1.0"),
    ("Tech §", 1, "meta", "regex", "0.0.0", Q + "generator:[^\\n]*¤ ([0-9.]+)", None, None, None, "\\1", "0.0.0"),
    ("Tech §", 1, "meta", "regex", "0.0.1", Q + "generator:\\s*¤", None, None, None, "", "0.0.1"),
    ("Tech §", 2, "body", "word", "0.0.0", "<div class=\"w-§\">", None, None, None, "", "0.0.0"),
    ("Tech §", 2, "body", "regex", "0.0.1", "x{2,}y§", None, None, None, "", "0.0.1"),
    ("Tech §", 2, "body", "regex", "0.0.3", "a.b", None, None, None, "", "0.0.1"),
    ("Tech §", 2, "body", "word", "0.0.4", "two\\words", None, None, None, "", "0.0.0"),
    ("Tech §", 3, "script", "word", "0.0.0", "js/¤", None, None, 40, "", "0.0.0"),
    ("Tech §", 4, "url", "regex", "0.0.0", "^https?://§\\.", None, None, None, "", "0.0.0"),
    ("Tech §", 5, "", "js", "0.0.0", "", "App.bad", None, 30, "", "0.0.0"),
    ("Tech §", 5, "", "js", "0.1.0", "", "App.on", None, None, "", "0.1.0"),
    ("Tech §", 5, "", "js", "0.2.0", "^(\\d+)$", "App.v", None, None, "\\1", "0.2.0"),
    ("Tech §", 5, "", "js", "0.3.0", "b{2,}", "B.list", None, None, "", "0.1.0"),
    ("Tech §", 6, "", "dom", "1.0.0", "#app-§", "", None, None, "", "1.0.0"),
    ("Tech §", 6, "", "dom", "1.4.0", "img", "", "src=logo§", None, "\\1", "1.4.0"),
    ("Tech §", 6, "", "dom", "1.5.0", "p", "hello §", None, 60, "", "1.5.0"),
    ("Listed §", 2, "body", "word", "0.0.0", "plain/§", None, None, None, "", "0.0.0"),
    ("Listed §", 6, "", "dom", "0.0.0", "div.w§", "", None, 70, "", "0.0.0"),
    ("Listed §", 6, "", "dom", "0.0.2", "a, #b", "", None, None, "", "0.0.2"),
]
COLUMNS = ["tech", "section", "part", "type", "ix", "pattern", "path", "attrs", "confidence", "version", "group_ix"]
TEXT = ("tech", "pattern", "path", "attrs")


def fill(column):
    """Put key, name and brand of a part into a template."""
    out = F.replace(column, F.lit("§"), F.col("p_partkey").cast("string"))
    return F.replace(F.replace(out, F.lit("¤"), F.col("p_name")), F.lit("@"), F.regexp_replace("p_brand", "#", ""))


def _fill_sql(column: str) -> str:
    return f"replace(replace(replace({column}, '§', p_partkey::VARCHAR), '¤', p_name), '@', replace(p_brand, '#', ''))"


def expected_sql(columns: list[str], rows: list[tuple], text: tuple[str, ...], where: str = "true") -> str:
    picked = ", ".join(f"{_fill_sql(c)} AS {c}" if c in text else c for c in columns)
    return f"WITH {sql_values('expected', columns, rows)} SELECT {picked} FROM expected, part WHERE {where}"


def documents(spark, sf, *templates: str):
    part = table(spark, sf, "part")
    return part.select(F.explode(F.array(*[fill(F.lit(t)) for t in templates])).alias("value"), "p_partkey")


def _place(ix):
    return F.concat_ws(".", *[F.col(f"{ix}.{f}").cast("string") for f in ("f", "key_ix", "value_ix")])


def _flat(rows):
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\\;")
    return rows.select("tech", "section", "part", "type", _place("ix").alias("ix"), "pattern", "path", F.nullif(attrs, F.lit("")).alias("attrs"),
                       "confidence", "version", _place("group_ix").alias("group_ix"))


def _techs(spark, sf):
    return feeds.technologies(documents(spark, sf, TECH, LISTED))


def _section_query(name, sections, where=""):
    rows = [r for r in EXPECTED if r[1] in sections]

    @query(name, expected_sql(COLUMNS, rows, TEXT))
    def run(spark, sf):
        techs = _techs(spark, sf)
        if sections == (feeds.JS,):
            made = feeds.js_matchers(techs)
        elif sections == (feeds.DOM,):
            made = feeds.dom_matchers(techs)
        else:
            made = feeds.text_matchers(techs).where(F.col("section").isin(*sections))
        return _flat(feeds.group_by_meta(made))


_section_query("feed_header_pattern", (feeds.HEADER, feeds.META))
_section_query("feed_plain_literal", (feeds.HTML, feeds.SCRIPT, feeds.URL))
_section_query("feed_js_probes", (feeds.JS,))
_section_query("feed_dom_conditions", (feeds.DOM,))


@query("feed_group_by_meta", expected_sql(COLUMNS, EXPECTED, TEXT))
def feed_group_by_meta(spark, sf):
    return _flat(feeds.techmap_rows(_techs(spark, sf)))


@query("src_feed_techmap", """
SELECT 'tech-' || p_partkey AS id, 'Tech ' || p_partkey AS name, 14 AS n_matchers, 19 AS n_patterns, 'Base ' || p_partkey || ',' || p_name AS implies, 'Other' AS excludes FROM part
UNION ALL SELECT 'listed-' || p_partkey, 'Listed ' || p_partkey, 3, 3, '', '' FROM part""")
def src_feed_techmap(spark, sf):
    techs = _techs(spark, sf)
    made = feeds.to_rules(feeds.techmap_rows(techs), feeds.relations(techs))
    n = F.aggregate("matchers", F.lit(0), lambda acc, m: acc + F.size(m["payload"]))
    return made.select("id", "name", F.size("matchers").alias("n_matchers"), n.alias("n_patterns"),
                       F.array_join("implies", ",").alias("implies"), F.array_join("excludes", ",").alias("excludes"))


@query("feed_relations", """
SELECT 'Tech ' || p_partkey AS tech, kind, ix, CASE ix WHEN 0 THEN CASE kind WHEN 'implies' THEN 'Base ' || p_partkey ELSE 'Other' END ELSE p_name END AS name
FROM part, (VALUES ('implies', 0), ('implies', 1), ('excludes', 0)) v(kind, ix)
UNION ALL SELECT 'Empty ' || p_partkey, 'implies', 0, 'Tech ' || p_partkey FROM part""")
def feed_relations(spark, sf):
    return feeds.relations(_techs(spark, sf))



@query("feed_pattern_suffix", r"""
SELECT p_partkey, p_name AS pattern, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_size % 120)::INTEGER END AS confidence,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '\1.' || (p_partkey % 3) END AS version FROM part""")
def feed_pattern_suffix(spark, sf):
    k = F.col("p_partkey")
    sep = F.lit("\\;")
    conf = F.when(k % 4 == 0, "confidence:high").otherwise(F.concat(F.lit("confidence:"), (F.col("p_size") % 120).cast("string")))
    ver = F.when(k % 5 == 0, "other:1").otherwise(F.concat(F.lit("version:\\1."), (k % 3).cast("string")))
    raw = F.concat(F.col("p_name"), sep, conf, sep, F.lit("x"), sep, ver)
    return table(spark, sf, "part").select("p_partkey", *feeds.split_suffixes(raw))


@query("feed_cookie_pattern", r"""
SELECT p_partkey, '(?im)^set-cookie:[^\n]*sid\.' || p_partkey || '=' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS pattern FROM part""")
def feed_cookie_pattern(spark, sf):
    name = F.concat(F.lit("sid."), F.col("p_partkey").cast("string"))
    value = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("")
    return table(spark, sf, "part").select("p_partkey", feeds.cookie_pattern(name, value).alias("pattern"))


GUARD_FORMS = [("a{§}", None), ("(?:¤){2,99}", "(?:¤){2,}"), ("x++§", None), ("(¤", None), ("[¤-", None), ("¤{3,}", "¤{3,}"), ("(?P<n>¤)", "(?P<n>¤)"), ("(" * 33 + "¤" + ")" * 33, None), ("\\p{Han}¤", "\\p{Han}¤")]


@query("feed_pattern_guard", f"""
WITH forms AS (SELECT unnest([{', '.join(sql_text(f or '') for _, f in GUARD_FORMS)}]) AS kept, unnest(range({len(GUARD_FORMS)})) AS form_ix)
SELECT p_partkey, form_ix::INTEGER AS form_ix, CASE form_ix WHEN 0 THEN CASE WHEN p_partkey > 16 THEN 'a{{' || p_partkey || ',}}' ELSE 'a{{' || p_partkey || '}}' END ELSE replace(kept, '¤', p_name) END AS pattern
FROM part, forms WHERE form_ix IN (1, 5, 6, 8) OR (form_ix = 0 AND p_partkey <= 1000)""")
def feed_pattern_guard(spark, sf):
    forms = F.array(*[F.struct(F.lit(i).alias("form_ix"), F.lit(f).alias("form")) for i, (f, _) in enumerate(GUARD_FORMS)])
    rows = table(spark, sf, "part").select("*", F.inline(forms)).select("p_partkey", "form_ix", fill(F.col("form")).alias("form"))
    return rows.withColumn("g", feeds.guard(F.col("form"))).where("g.valid").select("p_partkey", "form_ix", "g.pattern")


SELECTORS = ["div", "*", "#a§", "div.x", "body > *", "a[href]", "p, li:first-child", " , ", "h1,h2"]


@query("feed_informative_selector", f"""
SELECT p_partkey, selector FROM (SELECT p_partkey, replace(unnest({SELECTORS!r}), '§', p_partkey::VARCHAR) AS selector FROM part) WHERE regexp_matches(selector, '[.#\\[:]')""")
def feed_informative_selector(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.explode(F.array(*map(F.lit, SELECTORS))).alias("selector"))
    rows = rows.withColumn("selector", F.replace("selector", F.lit("§"), F.col("p_partkey").cast("string")))
    return rows.where(feeds.informative(F.col("selector")))


KEYWORDS = [
    {"cms": "Portal @", "method": "keyword", "location": "body", "keyword": ["/¤/", "v§"]},
    {"cms": "Portal @", "method": "keyword", "location": "title", "keyword": "¤"},
    {"cms": "Icon §", "method": "faviconhash", "location": "body", "keyword": ["§", "0", "4294967295", "x"]},
    {"cms": "", "method": "keyword", "location": "body", "keyword": ["a"]},
    {"cms": "Skip §", "method": "keyword", "location": "cookie", "keyword": ["a"]},
    {"cms": "None §", "method": "keyword", "location": "body", "keyword": [1]},
    {"cms": "Other §", "method": "hash", "location": "body", "keyword": ["a"]},
]


@query("src_feed_keywords", """
SELECT p_partkey, 'portal-' || lower(replace(p_brand, '#', '')) AS rule_id, 0 AS ix, 'word' AS type, 'body' AS part, '/' || p_name || '/|v' || p_partkey AS payload FROM part
UNION ALL SELECT p_partkey, 'portal-' || lower(replace(p_brand, '#', '')), 1, 'word', 'title', p_name FROM part
UNION ALL SELECT p_partkey, 'icon-' || p_partkey, 2, 'icon_hash', '', CASE WHEN p_partkey = 0 THEN '-1' ELSE p_partkey || '|-1' END FROM part""")
def src_feed_keywords(spark, sf):
    listed, wrapped = json.dumps(KEYWORDS, ensure_ascii=False), json.dumps({"fingerprint": KEYWORDS}, ensure_ascii=False)
    part = table(spark, sf, "part")
    docs = part.select("p_partkey", fill(F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(wrapped)).alias("value"))
    rows = feeds.keyword_rows(feeds.keyword_entries(docs), "p_partkey")
    payload = F.array_join(F.when(F.col("type") == "word", F.col("words")).otherwise(F.transform("hashes", lambda h: h.cast("string"))), "|")
    return rows.select("p_partkey", "rule_id", "ix", "type", "part", payload.alias("payload"))


TEMPLATE = json.dumps({"id": "tpl-§", "info": {"name": "¤"}, "http": [
    {"matchers": [{"type": "word", "part": "all", "words": ["w§", "¤"], "condition": "and"}, {"type": "status", "status": [200, 404]}, {"type": "binary", "binary": ["ff"]}], "matchers-condition": "and"},
    {"matchers": [{"type": "regex", "part": "header", "regex": ["x-§"], "negative": True}, {"type": "dsl", "dsl": ["status_code == 200 && contains(body, '¤')"]}]}]}, ensure_ascii=False)
OLD_TEMPLATE = json.dumps({"id": "old-§", "info": {}, "requests": [{"matchers": [{"type": "word", "words": ["¤"]}], "matchers-condition": ""}]}, ensure_ascii=False)
NOT_TEMPLATE = json.dumps({"id": "native-§", "matchers": [{"type": "word", "words": ["¤"]}]}, ensure_ascii=False)
TEMPLATE_ROWS = [
    ("tpl-§", "¤", "and", 0, 0, "word", "body", "and", False, "w§|¤"), ("tpl-§", "¤", "and", 0, 1, "status", "", "", False, "200|404"),
    ("tpl-§", "¤", "and", 1, 0, "regex", "header", "", True, "x-§"), ("tpl-§", "¤", "and", 1, 1, "dsl", "", "", False, "status == 200 && contains(body, '¤')"),
    ("old-§", "old-§", "or", 0, 0, "word", "body", "", False, "¤"),
]
TEMPLATE_COLUMNS = ["rule_id", "name", "matchers_condition", "block_ix", "matcher_ix", "type", "part", "condition", "negative", "payload"]


@query("src_feed_templates", expected_sql(TEMPLATE_COLUMNS, TEMPLATE_ROWS, ("rule_id", "name", "payload")))
def src_feed_templates(spark, sf):
    docs = documents(spark, sf, TEMPLATE, OLD_TEMPLATE, NOT_TEMPLATE)
    return feeds.template_rows(docs, "value").withColumn("payload", F.array_join("payload", "|"))


NATIVE = """- id: rule-§
  name: "¤"
  matchers-condition: and
  matchers:
    - {type: word, part: body, words: ["¤", "v§"]}
    - {type: status, status: [200]}
- {id: bare-§, matchers: [{type: regex, regex: ["x§"], confidence: 40, extra: 1}]}
- {id: "", matchers: [{type: word, words: [a]}]}
- {id: hollow-§, matchers: []}
---
id: single-§
matchers-condition: nonsense
implies: ["¤"]
matchers: [{type: word, words: ["s§"]}]
---
id: wrong-§
matchers: [{type: word, words: "not a list"}]
"""
NATIVE_ROWS = [("rule-§", "¤", "and", 2, "¤|v§", None, ""), ("bare-§", "bare-§", "or", 1, "x§", 40, ""), ("single-§", "single-§", "or", 1, "s§", None, "¤")]


NATIVE_COLUMNS = ["rule_id", "name", "condition", "n_matchers", "payload", "confidence", "implies"]


@query("src_rules_native", expected_sql(NATIVE_COLUMNS, NATIVE_ROWS, ("rule_id", "name", "payload", "implies")) + """
UNION ALL SELECT '!file-' || p_partkey // 50, 'wrong types', '', count(*)::INTEGER, '', NULL, '' FROM part GROUP BY ALL
UNION ALL SELECT '!broken-' || p_partkey, 'unreadable', '', 1, '', NULL, '' FROM part WHERE p_partkey % 50 = 7""")
def src_rules_native(spark, sf):
    """Rule files written and read back, fifty parts a file and some files broken; what the
    load leaves out shows up with its file."""
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    name = F.concat(F.lit("file-"), F.floor(key / 50).cast("string"))
    good = part.select(name.alias("source"), F.concat(F.lit("---\n"), fill(F.lit(NATIVE))).alias("value"))
    bad = part.where(key % 50 == 7).select(F.concat(F.lit("broken-"), key.cast("string")).alias("source"), F.lit("- {id: [").alias("value"))
    folder = work_dir(spark, "rule-files")
    good.unionByName(bad).repartition("source").write.partitionBy("source").text(folder)
    files = rules.read_files(spark, f"{folder}/*").withColumn("source", F.regexp_extract("source", "/source=([^/]*)/", 1))
    first = F.col("rule.matchers")[0]
    read = rules.native_rules(files).select(
        F.col("rule.id").alias("rule_id"), F.col("rule.name").alias("name"), F.col("rule")["matchers-condition"].alias("condition"), F.size("rule.matchers").alias("n_matchers"),
        F.array_join(F.coalesce(first["words"], first["regex"]), "|").alias("payload"), first["confidence"].alias("confidence"),
        F.coalesce(F.array_join("rule.implies", "|"), F.lit("")).alias("implies"))
    left = rules.quarantine(files).groupBy("source", F.substring_index("error", ":", 1).alias("name")).agg(F.count(F.lit(1)).cast("int").alias("n_matchers"))
    none = F.lit("")
    return read.unionByName(left.select(
        F.concat(F.lit("!"), "source").alias("rule_id"), "name", none.alias("condition"), "n_matchers", none.alias("payload"), F.lit(None).cast("int").alias("confidence"), none.alias("implies")))


LOOSE = json.dumps({"id": " loose-§ ", "matchersCondition": "and", "confidence": 0.5, "implies": "¤", "excludes": ["", "x§"], "matchers": [
    {"type": "word", "words": "¤", "confidence": "0.92", "negative": 1}, {"type": "status", "status": ["200", 404.7, "x", None]}, {"type": "regex", "regex": []},
    {"type": " icon_hash ", "hash": "-1§", "version": "  "}, {"type": "js", "js": {"path": "a.b§", "pattern": ""}}, {"type": "dom", "dom": [{"sel": "#x§", "text": "t"}, {"sel": " "}]},
    {"type": "odd", "odd": [1]}, {"words": ["no type"]}, "junk"]}, ensure_ascii=False)
SINGLE = json.dumps({"id": "one-§", "name": "", "confidence": 101, "matchers": {"type": "dsl", "dsl": ["status == §"], "confidence": 1}}, ensure_ascii=False)
DROPPED = json.dumps({"id": "gone-§", "matchers": [{"type": "word", "words": [""]}]})
LOOSE_ROWS = [
    ("loose-§", "loose-§", "and", 50, "¤", "x§", 0, "word", "¤", 92, True), ("loose-§", "loose-§", "and", 50, "¤", "x§", 1, "status", "200|404|0", None, False),
    ("loose-§", "loose-§", "and", 50, "¤", "x§", 2, "icon_hash", "-1§", None, False), ("loose-§", "loose-§", "and", 50, "¤", "x§", 3, "js", "a.b§", None, False),
    ("loose-§", "loose-§", "and", 50, "¤", "x§", 4, "dom", "#x§", None, False), ("one-§", "one-§", "", None, "", "", 0, "dsl", "status == §", 100, False),
]
LOOSE_COLUMNS = ["rule_id", "name", "condition", "rule_confidence", "implies", "excludes", "matcher_ix", "type", "payload", "confidence", "negative"]


def _loose_flat(repaired):
    m = F.col("m")
    numbers = lambda c: F.transform(m[c], lambda n: n.cast("string"))
    payload = F.coalesce(m["words"], m["regex"], numbers("status"), numbers("hash"), m["dsl"], F.transform(m["js"], lambda p: p["path"]), F.transform(m["dom"], lambda p: p["sel"]))
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return repaired.select("rule", F.posexplode("rule.matchers").alias("matcher_ix", "m")).select(
        F.col("rule.id").alias("rule_id"), F.col("rule.name").alias("name"), F.coalesce(F.col("rule")["matchers-condition"], F.lit("")).alias("condition"),
        F.col("rule.confidence").alias("rule_confidence"), joined("rule.implies").alias("implies"), joined("rule.excludes").alias("excludes"), "matcher_ix",
        m["type"].alias("type"), F.array_join(payload, "|").alias("payload"), m["confidence"].alias("confidence"), F.coalesce(m["negative"], F.lit(False)).alias("negative"))


@query("src_rules_sanitize", expected_sql(LOOSE_COLUMNS, LOOSE_ROWS, ("rule_id", "name", "implies", "excludes", "payload")))
def src_rules_sanitize(spark, sf):
    docs = documents(spark, sf, LOOSE, SINGLE, DROPPED).select(F.try_parse_json("value").alias("doc"))
    return _loose_flat(loose.repair(docs))


@query("src_rules_import_split", """
SELECT 'template' AS kind, 'tpl-' || p_partkey AS rule_id FROM part UNION ALL SELECT 'template', 'old-' || p_partkey FROM part
UNION ALL SELECT 'native', 'native-' || p_partkey FROM part UNION ALL SELECT 'native', 'one-' || p_partkey FROM part""")
def src_rules_import_split(spark, sf):
    nested = f"[[{OLD_TEMPLATE}, {NOT_TEMPLATE}], {SINGLE}, 5, null]"
    docs = documents(spark, sf, TEMPLATE, nested, DROPPED).select(F.try_parse_json("value").alias("doc"))
    templates, native = loose.route(docs)
    return templates.select(F.lit("template").alias("kind"), F.try_variant_get("doc", "$.id", "string").alias("rule_id")).unionByName(
        native.select(F.lit("native").alias("kind"), F.col("rule.id").alias("rule_id")))


@query("src_favicon_dict", """
SELECT s_suppkey::INTEGER AS hash, s_name AS name FROM supplier UNION ALL SELECT (-1 - s_suppkey)::INTEGER, 'Neg ' || s_suppkey FROM supplier
UNION ALL SELECT (s_suppkey + 1000)::INTEGER, 'Line of ' || s_name FROM supplier
UNION ALL SELECT NULL, 'broken-' || s_suppkey || ': no object' FROM supplier WHERE s_suppkey % 10 = 3""")
def src_favicon_dict(spark, sf):
    """Dictionary files written and read back, a file for ten suppliers, and some broken."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey").cast("string")
    pairs = F.concat(F.lit('"'), k, F.lit('": "'), F.col("s_name"), F.lit('", "-'), (F.col("s_suppkey") + 1).cast("string"), F.lit('": "Neg '), k, F.lit('", "x'), k, F.lit('": "bad"'))
    groups = s.groupBy(F.concat(F.lit("dict-"), F.floor(F.col("s_suppkey") / 10).cast("string")).alias("source")).agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list(pairs), ",\n"), F.lit("}")).alias("value"))
    broken = s.where("s_suppkey % 10 = 3").select(F.concat(F.lit("broken-"), k).alias("source"), F.when(F.col("s_suppkey") % 20 == 3, '{"1": ').otherwise("[1]").alias("value"))
    folder = work_dir(spark, "icon-names")
    groups.unionByName(broken).repartition("source").write.partitionBy("source").text(folder)
    read, bad = favicons.from_json_files(spark, f"{folder}/*")
    lines = s.select(F.explode(F.split(F.concat((F.col("s_suppkey") + 1000).cast("string"), F.lit("   Line of "), F.col("s_name"), F.lit(" \nno hash here\n")), "\n")).alias("line"))
    left = bad.select(F.lit(None).cast("int").alias("hash"), F.concat(F.regexp_extract("source", "/source=([^/]*)/", 1), F.lit(": "), "error").alias("name"))
    return read.unionByName(favicons.from_lines(lines, "line")).unionByName(left)
