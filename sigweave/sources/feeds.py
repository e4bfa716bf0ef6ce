"""Rule feeds: three published formats turned into flat matcher rows.

A converted feed is a flat table with one row per pattern, ``(tech, section, part,
type, confidence, version, group_ix, ix, pattern, ...)``: patterns with equal
confidence and version within a section belong to the matcher ``group_ix``. Flat
rows keep a technology of any size splittable; ``to_rules`` nests them where rule
documents are wanted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from sigweave.functions.patterns import is_valid, loosen_repeats
from sigweave.functions.text import let, slug

# Sections of a technology in the order its matchers are listed.
HEADER, META, HTML, SCRIPT, URL, JS, DOM = range(7)
PART = {HEADER: "header", META: "meta", HTML: "body", SCRIPT: "script", URL: "url"}
# Characters that make a pattern more than plain text.
METACHARACTERS = "[.+*?()|\\[\\]{}^$]"
TEMPLATE_PARTS = ("title", "url", "header", "raw", "meta", "script")
KEYWORD_PARTS = ("body", "title", "header", "url")


# Patterns with suffixes

def clean(pattern: Column) -> Column:
    return F.split(pattern, "\\\\;", 2)[0]


def _after_first(items: Column) -> Column:
    return F.filter(items, lambda _, i: i > 0)


def _from(text: Column, place: int) -> Column:
    """The text from its character at ``place`` on."""
    return F.substring(text, F.lit(place), F.char_length(text))


def _suffix(pattern: Column, name: str) -> Column:
    """Text of the last ``name:`` suffix, NULL without one."""
    tags = _after_first(F.split(pattern, "\\\\;"))
    held = F.filter(tags, lambda t: t.startswith(f"{name}:"))
    return _from(F.try_element_at(held, F.lit(-1)), len(name) + 2)


def suffix_confidence(pattern: Column) -> Column:
    """The last confidence suffix that is a whole number."""
    tags = F.filter(_after_first(F.split(pattern, "\\\\;")), lambda t: t.rlike("\\Aconfidence:[+-]?[0-9]{1,9}\\z"))
    return _from(F.try_element_at(tags, F.lit(-1)), len("confidence:") + 1).try_cast("int")


def suffix_version(pattern: Column) -> Column:
    return F.coalesce(_suffix(pattern, "version"), F.lit(""))


def split_suffixes(pattern: Column) -> list[Column]:
    return [clean(pattern).alias("pattern"), suffix_confidence(pattern).alias("confidence"), suffix_version(pattern).alias("version")]


# Pattern forms

def quote(text: Column) -> Column:
    """Backslashes before every metacharacter."""
    return F.regexp_replace(text, "([\\\\.+*?()|\\[\\]{}^$])", "\\\\$1")


def header_pattern(key: Column, pattern: Column) -> Column:
    """Line-anchored pattern for one header or meta name.

    ``^`` in front means the value starts so, otherwise it contains it; an empty
    pattern asks for the name alone.
    """
    start = F.concat(F.lit("(?im)^"), quote(F.lower(key)), F.lit(":"))
    return (
        F.when(pattern == "", start)
        .when(pattern.startswith("^"), F.concat(start, F.lit("\\s*"), _from(pattern, 2)))
        .otherwise(F.concat(start, F.lit("[^\\n]*"), pattern)))


def cookie_pattern(name: Column, pattern: Column) -> Column:
    return header_pattern(F.lit("set-cookie"), F.concat(quote(name), F.lit("="), pattern))


def guard(pattern: Column) -> Column:
    """``struct<pattern, valid>``: repeats loosened, and whether it compiles."""

    @pandas_udf("pattern string, valid boolean")
    def check(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"pattern": texts.map(loosen_repeats), "valid": texts.map(is_valid)})

    # Else a filter on the outcome is pushed below the check and checks every pattern again.
    return check.asNondeterministic()(pattern)


def plain_literal(pattern: Column) -> Column:
    """The text a pattern without metacharacters stands for, else NULL. Only an
    escaped slash and an escaped backslash are read as text."""
    special = pattern.rlike(METACHARACTERS) | F.regexp_replace(pattern, "\\\\[/\\\\]", "").contains("\\")
    return F.when(~special, F.regexp_replace(pattern, "\\\\([/\\\\])", "$1"))


def informative(selector: Column) -> Column:
    """Whether a part of the selector names a class, id, attribute or state."""
    return F.exists(F.split(selector, ","), lambda s: s.rlike("[.#\\[:]"))


# Loosely typed values

def strings(value: Column) -> Column:
    """A variant that holds a text or a list as a list of non-empty texts."""

    def listed(held: Column) -> Column:
        kind = F.schema_of_variant(held)
        texts = F.filter(F.try_variant_get(held, "$", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
        return F.when(kind == "STRING", F.array(F.try_variant_get(held, "$", "string"))).when(
            kind.startswith("ARRAY"), F.transform(texts, lambda v: F.try_variant_get(v, "$", "string")))

    return F.filter(F.coalesce(let(value, listed), F.array()), lambda s: s != "")


def _object(doc: Column, name: str) -> Column:
    """An object field as ``map<string,variant>``, empty when it is not one."""
    return F.coalesce(F.try_variant_get(doc, f"$.{name}", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _entries(pairs: Column) -> Column:
    """``array<struct<key, value>>`` of a map in key order."""
    return F.transform(F.array_sort(F.map_keys(pairs)), lambda k: F.struct(k.alias("key"), F.try_element_at(pairs, k).alias("value")))


def technologies(feed: DataFrame, column: str = "value") -> DataFrame:
    """``{name: {...}}`` documents to ``(tech, doc)`` rows, ``doc`` a variant."""
    pairs = F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>")
    return feed.select(F.explode(pairs).alias("tech", "doc"))


# Tech maps

def _raw(section: int, f: int, key_ix, value_ix, key, raw, attrs=None) -> Column:
    """One pattern as it stands in the document, with its place there."""
    return F.struct(
        F.lit(section).alias("section"), F.lit(f).alias("f"), key_ix.alias("key_ix"), value_ix.alias("value_ix"), key.alias("key"), raw.alias("raw"),
        (F.lit(None).cast("map<string,string>") if attrs is None else attrs).alias("attrs"))


def _first(value: Column) -> Column:
    return F.coalesce(F.try_element_at(strings(value), F.lit(1)), F.lit(""))


def _field_patterns(field: str, section: int) -> Column:
    """Raw patterns of one field as structs, in order."""
    f = int(field == "cookies")
    if section in (HTML, SCRIPT, URL):
        values = strings(F.try_variant_get("doc", f"$.{field}", "variant"))
        return F.transform(values, lambda raw, j: _raw(section, f, F.lit(0), j, F.lit(""), raw))
    # A cookie without a value pattern still counts.
    listed = lambda v: let(strings(v), lambda held: F.when(F.size(held) == 0, F.array(F.lit(""))).otherwise(held)) if f else strings(v)
    return F.flatten(F.transform(_entries(F.col(f"m_{field}")), lambda e, i: F.transform(listed(e["value"]), lambda raw, j: _raw(section, f, i, j, e["key"], raw))))


def _js_patterns() -> Column:
    return F.transform(_entries(F.col("m_js")), lambda e, i: _raw(JS, 0, i, F.lit(0), e["key"], _first(e["value"])))


def _bare_selectors() -> Column:
    return F.transform(strings(F.try_variant_get("doc", "$.dom", "variant")), lambda raw, j: _raw(DOM, 0, F.lit(0), j, F.lit(""), raw))


def _selectors() -> Column:
    """The object form: text and attribute conditions; NULL where page properties are asked for."""

    def one(sel: Column, i: Column, cond: Column) -> Column:
        given = F.try_variant_get(F.try_element_at(cond, F.lit("attributes")), "$", "map<string,variant>")
        attrs = F.map_filter(F.transform_values(given, lambda _k, v: _first(v)), lambda _k, v: v != "")
        row = _raw(DOM, 1, i, F.lit(0), sel, _first(F.try_element_at(cond, F.lit("text"))), attrs)
        return F.when(cond.isNull() | ~F.map_contains_key(cond, "properties"), row)

    return F.transform(_entries(F.col("m_dom")), lambda e, i: let(F.try_variant_get(e["value"], "$", "map<string,variant>"), lambda cond: one(e["key"], i, cond)))


FIELDS = (("headers", HEADER), ("cookies", HEADER), ("meta", META), ("html", HTML), ("scriptSrc", SCRIPT), ("url", URL))


def _matchers(techs: DataFrame, sections: tuple[int, ...]) -> DataFrame:
    """Matcher rows of some sections; every document is read once for all of them."""
    made = [_field_patterns(f, s) for f, s in FIELDS if s in sections]
    maps = [f for f, s in FIELDS if s in sections and s in (HEADER, META)]
    if JS in sections:
        made, maps = [*made, _js_patterns()], [*maps, "js"]
    if DOM in sections:
        made, maps = [*made, _bare_selectors(), _selectors()], [*maps, "dom"]
    keyed = techs.select("tech", "doc", *[_object(F.col("doc"), f).alias(f"m_{f}") for f in maps])
    raw = keyed.select("tech", F.inline(F.filter(F.concat(*made), lambda r: r.isNotNull())))

    section, text, attrs = F.col("section"), F.col("text"), F.col("attrs")
    loose, is_js, is_dom, bare = section.isin(HTML, SCRIPT, URL), section == JS, section == DOM, F.col("f") == 0
    selector = F.when(bare, text).otherwise(F.col("key"))
    filled = informative(selector) | (~bare & ((text != "") | (F.coalesce(F.size("attrs"), F.lit(0)) > 0)))
    cut = raw.select("*", clean(F.col("raw")).alias("text")).where((~loose | (text != "")) & (~is_dom | filled))
    shaped = F.when(is_dom, "").when(loose | is_js, text).when(F.col("f") == 1, cookie_pattern(F.col("key"), text)).otherwise(header_pattern(F.col("key"), text))
    # Text conditions and attributes in order of their names: the first suffix counts.
    texts = F.concat(F.array("raw"), F.transform(F.array_sort(F.map_keys("attrs")), lambda k: F.try_element_at("attrs", k)))
    confidences = F.filter(F.transform(texts, suffix_confidence), lambda c: c.isNotNull())
    versions = F.filter(F.transform(texts, suffix_version), lambda v: v != "")
    rows = cut.select(
        "tech", "section", F.struct("f", "key_ix", "value_ix").alias("ix"), "f", "key", "text", shaped.alias("pattern"), "attrs",
        F.when(attrs.isNull(), suffix_confidence(F.col("raw"))).otherwise(F.try_element_at(confidences, F.lit(1))).alias("confidence"),
        F.when(attrs.isNull(), suffix_version(F.col("raw"))).otherwise(F.coalesce(F.try_element_at(versions, F.lit(1)), F.lit(""))).alias("version"))
    # A runtime path stays without a pattern that does not compile, other patterns go.
    checked = rows.withColumn("g", guard(F.col("pattern"))).where(F.col("g.valid") | is_js).withColumn("literal", F.when(loose, plain_literal(F.col("g.pattern"))))
    part = F.coalesce(F.element_at(F.create_map(*[x for k, v in PART.items() for x in (F.lit(k), F.lit(v))]), section), F.lit(""))
    return checked.select(
        "tech", "section", part.alias("part"),
        F.when(is_js, "js").when(is_dom, "dom").when(F.col("literal").isNotNull(), "word").otherwise("regex").alias("type"), "ix",
        F.when(is_dom, selector).when(is_js & ~F.col("g.valid"), "").otherwise(F.coalesce("literal", "g.pattern")).alias("pattern"),
        F.when(is_js, F.col("key")).when(is_dom, F.when(bare, "").otherwise(text)).alias("path"),
        F.transform_values("attrs", lambda _k, v: clean(v)).alias("attrs"), valid_confidence(F.col("confidence")).alias("confidence"), "version")


def text_matchers(techs: DataFrame) -> DataFrame:
    """Header, cookie, meta, html, script and url patterns of a tech map."""
    return _matchers(techs, (HEADER, META, HTML, SCRIPT, URL))


def js_matchers(techs: DataFrame) -> DataFrame:
    """Runtime paths with their first value pattern; one that does not compile
    is dropped and the path alone remains."""
    return _matchers(techs, (JS,))


def dom_matchers(techs: DataFrame) -> DataFrame:
    """DOM selectors. Bare ones must be informative; of the object form text and
    attribute conditions stay, and what needs page properties is left out."""
    return _matchers(techs, (DOM,))


def valid_confidence(value: Column) -> Column:
    return F.when(value.between(0, 100), value)


def group_by_meta(rows: DataFrame) -> DataFrame:
    """Give patterns of a section with equal confidence and version one matcher,
    named by the position of its first pattern. Words come before patterns of the
    same section. A group is part of one feed document, so it is never large."""
    same = Window.partitionBy("tech", "section", "type", F.coalesce("confidence", F.lit(-1)), "version")
    return rows.withColumn("group_ix", F.min("ix").over(same))


def techmap_rows(techs: DataFrame) -> DataFrame:
    """All matchers of a tech map as flat rows."""
    return group_by_meta(_matchers(techs, (HEADER, META, HTML, SCRIPT, URL, JS, DOM)))


def relations(techs: DataFrame) -> DataFrame:
    """``(tech, kind, ix, name)`` edges: implies and excludes, suffixes cut."""
    def listed(kind: str) -> Column:
        names = strings(F.try_variant_get("doc", f"$.{kind}", "variant"))
        return F.transform(names, lambda raw, i: F.struct(F.lit(kind).alias("kind"), i.alias("ix"), raw.alias("raw")))

    return techs.select("tech", F.inline(F.concat(listed("implies"), listed("excludes")))).select("tech", "kind", "ix", clean(F.col("raw")).alias("name")).where("name <> ''")


def to_rules(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Nest flat rows into ``(id, name, matchers, implies, excludes)``. A rule is
    one document of the feed, so what is nested is as large as that document."""
    payload = F.sort_array(F.collect_list(F.struct("ix", "pattern", "path", "attrs_json")))
    matchers = rows.withColumn("attrs_json", F.to_json("attrs")).groupBy("tech", "section", "part", "type", "confidence", "version", "group_ix").agg(payload.alias("payload"))
    word_first = F.when(F.col("type") == "word", 0).otherwise(1)
    per_tech = matchers.groupBy("tech").agg(F.sort_array(F.collect_list(F.struct(
        "section", word_first.alias("o"), "group_ix", "type", "part", "confidence", "version",
        F.transform("payload", lambda p: F.struct(p["pattern"].alias("pattern"), p["path"].alias("path"), p["attrs_json"].alias("attrs"))).alias("payload")))).alias("matchers"))
    names = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ix", "name")))), lambda e: e["name"]).alias(kind)
    linked = edges.groupBy("tech").agg(names("implies"), names("excludes"))
    return per_tech.join(linked, "tech", "left").select(
        slug(F.col("tech")).alias("id"), F.col("tech").alias("name"), "matchers",
        F.coalesce("implies", F.array()).alias("implies"), F.coalesce("excludes", F.array()).alias("excludes"))


# Keyword lists

def keyword_entries(feed: DataFrame, column: str = "value") -> DataFrame:
    """``[...]`` or ``{"fingerprint": [...]}`` documents to entry rows."""
    doc = F.try_parse_json(column)
    entries = F.coalesce(F.try_variant_get(doc, "$.fingerprint", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    get = lambda name: F.coalesce(F.try_variant_get("entry", f"$.{name}", "string"), F.lit(""))
    kept = [c for c in feed.columns if c != column]
    return feed.select(*kept, F.posexplode(entries).alias("ix", "entry")).select(
        *kept, "ix", get("cms").alias("cms"), get("method").alias("method"), get("location").alias("location"),
        F.try_variant_get("entry", "$.keyword", "variant").alias("keyword"))


def keyword_rows(entries: DataFrame, *keep: str) -> DataFrame:
    """``(rule_id, name, ix, type, part, condition, words, hashes)``: one matcher
    per usable entry; entries of one product share its rule. ``keep`` names
    further columns, such as the file, that order the entries."""
    kind = F.schema_of_variant("keyword")
    texts = F.coalesce(F.when(kind == "STRING", F.array(F.try_variant_get("keyword", "$", "string"))).when(
        kind.startswith("ARRAY"), F.transform(F.filter(F.try_variant_get("keyword", "$", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"),
                                              lambda v: F.try_variant_get(v, "$", "string"))), F.array())
    number = lambda t: F.regexp_extract(t, "\\A\\s*([+-]?[0-9]{1,18})", 1).try_cast("bigint")
    wrap = lambda n: let(n.bitwiseAND(F.lit(0xFFFFFFFF)), lambda u: F.when(u >= 1 << 31, u - (1 << 32)).otherwise(u).cast("int"))
    hashes = F.transform(F.filter(F.transform(texts, number), lambda n: n.isNotNull() & (n != 0)), wrap)
    is_word = F.col("method") == "keyword"
    rows = entries.where("cms <> ''").select(
        *keep, slug(F.col("cms")).alias("rule_id"), F.col("cms").alias("name"), "ix", "method", "location",
        F.when(is_word, texts).otherwise(F.array()).alias("words"),
        F.when(F.col("method") == "faviconhash", hashes).otherwise(F.array()).alias("hashes"))
    usable = (is_word & F.col("location").isin(*KEYWORD_PARTS) & (F.size("words") > 0)) | (F.size("hashes") > 0)
    return rows.where(usable).select(
        *keep, "rule_id", "name", "ix", F.when(is_word, "word").otherwise("icon_hash").alias("type"),
        F.when(is_word, F.col("location")).otherwise("").alias("part"), F.when(is_word, "and").otherwise("").alias("condition"), "words", "hashes")


# Scanner templates

def template_rows(docs: DataFrame, column: str = "doc") -> DataFrame:
    """``(rule_id, name, matchers_condition, block_ix, matcher_ix, type, part,
    condition, negative, payload)`` of scanner templates.

    The ``http`` blocks count, or ``requests`` without any; an unknown part is
    the body, unsupported types are left out, and the last block that states a
    condition decides for the rule.
    """
    doc = F.try_parse_json(column)
    blocks = lambda f: F.try_variant_get(doc, f"$.{f}", "array<variant>")
    chosen = F.when(F.coalesce(F.size(blocks("http")), F.lit(0)) > 0, blocks("http")).otherwise(blocks("requests"))
    text = lambda v, p: F.coalesce(F.try_variant_get(v, p, "string"), F.lit(""))
    templates = docs.where(F.try_variant_get(doc, "$.info", "map<string,variant>").isNotNull()).select(
        text(doc, "$.id").alias("rule_id"), text(doc, "$.info.name").alias("title"), chosen.alias("blocks")).where(
        (F.col("rule_id") != "") & (F.size("blocks") > 0))
    stated = F.filter(F.transform("blocks", lambda b: text(b, "$.matchers-condition")), lambda c: c != "")
    named = templates.select(
        "rule_id", F.coalesce(F.nullif("title", F.lit("")), "rule_id").alias("name"),
        F.coalesce(F.try_element_at(stated, F.lit(-1)), F.lit("or")).alias("matchers_condition"), F.posexplode("blocks").alias("block_ix", "block"))
    rows = named.select("rule_id", "name", "matchers_condition", "block_ix", F.posexplode(F.try_variant_get("block", "$.matchers", "array<variant>")).alias("matcher_ix", "m"))
    kind, part = text(F.col("m"), "$.type"), text(F.col("m"), "$.part")
    listed = lambda f: F.coalesce(F.try_variant_get("m", f"$.{f}", "array<string>"), F.array())
    payload = (
        F.when(kind == "word", listed("words")).when(kind == "regex", listed("regex"))
        .when(kind == "status", F.transform(F.coalesce(F.try_variant_get("m", "$.status", "array<int>"), F.array()), lambda n: n.cast("string")))
        .when(kind == "dsl", F.transform(listed("dsl"), lambda e: F.replace(e, F.lit("status_code"), F.lit("status")))))
    is_text = kind.isin("word", "regex")
    return rows.where(kind.isin("word", "regex", "status", "dsl")).select(
        "rule_id", "name", "matchers_condition", "block_ix", "matcher_ix", kind.alias("type"),
        F.when(is_text, F.when(part.isin(*TEMPLATE_PARTS), part).otherwise("body")).otherwise("").alias("part"),
        F.when(kind != "status", text(F.col("m"), "$.condition")).otherwise("").alias("condition"),
        F.coalesce(F.try_variant_get("m", "$.negative", "boolean"), F.lit(False)).alias("negative"), payload.alias("payload"))
