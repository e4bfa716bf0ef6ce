"""Rule check: what is wrong with a rule, as ``(rule_id, path, code)`` rows.

Each rule is judged from its own document, so the whole check is one projection
over a rule table of any size. Documents come as JSON text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.functions.expressions import is_readable
from sigweave.functions.patterns import is_valid
from sigweave.functions.text import UNICODE_SPACE
from sigweave.schema import MATCHER_TYPES, PARTS, PAYLOAD_FIELD, RULE

# Limits of the check; lists are bounded for candidates only.
CANDIDATE_LIST, TEXT, NAME, PROBE_TEXT, ATTRS, ATTR_NAME = 50, 4000, 500, 1000, 30, 200

RULE_FIELDS = {"id", "name", "matchers-condition", "matchers", "implies", "excludes", "confidence"}
MATCHER_FIELDS = {"type", "part", "condition", "negative", "words", "regex", "status", "hash", "dsl", "js", "dom", "confidence", "version"}


def _issue(path: Column | str, code: str) -> Column:
    return F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(code).alias("code"))


def _when(bad: Column, path: Column | str, code: str) -> Column:
    """List with one issue where ``bad`` holds."""
    return F.when(F.coalesce(bad, F.lit(False)), F.array(_issue(path, code))).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<path:string,code:string>>")


def _filled(text: Column, most: int) -> Column:
    return text.rlike(f"[^{UNICODE_SPACE}]") & (F.octet_length(text) <= most)


def _join(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _list_issues(values: Column, path: Column, most: int, longest: int) -> Column:
    """Size of a list, else the first entry that is empty or too long."""
    size = F.coalesce(F.size(values), F.lit(0))
    wrong = F.filter(F.transform(values, lambda v, i: F.struct(i.alias("i"), (~_filled(v, longest)).alias("bad"))), lambda e: e["bad"])
    bad_size = (size == 0) | (size > most) if most else size == 0
    first = F.try_element_at(wrong, F.lit(1))["i"]
    return F.when(bad_size, F.array(_issue(path, "invalid_list"))).when(
        first.isNotNull(), F.array(_issue(_join(path, "[", first, "]"), "invalid_string"))).otherwise(_none())


def _each(values: Column, bad, path, code: str) -> Column:
    """One issue per entry for which ``bad`` holds."""
    marked = F.transform(values, lambda v, i: F.when(bad(v), _issue(path(i), code)))
    return F.coalesce(F.filter(marked, lambda m: m.isNotNull()), _none())


def _bad_texts(lists: Column, is_bad) -> Column:
    """For a list of text lists the same shape of flags. An Arrow batch is judged at once,
    each of its texts a single time."""

    @F.arrow_udf("array<array<boolean>>")
    def judge(rows: pa.Array) -> pa.Array:
        inner = rows.values
        texts = inner.values.dictionary_encode(null_encoding="encode")
        flags = pa.array([is_bad(t) for t in texts.dictionary.to_pylist()], pa.bool_()).take(texts.indices)
        return _listed(rows, _listed(inner, flags))

    return judge(lists)


def _listed(like: pa.ListArray, values: pa.Array) -> pa.ListArray:
    """``values`` in lists that are cut, and null, as those of ``like``."""
    return pa.ListArray.from_arrays(pa.array(like.offsets.to_numpy()), values, mask=like.is_null())


def _bad_pattern(text: str | None) -> bool:
    return bool(text) and not is_valid(text)


def _bad_expression(text: str | None) -> bool:
    return not is_readable(text or "")


def _payload_issues(m: Column, ix: Column, flags: Column, most: int) -> Column:
    base = _join("matchers[", ix, "]")
    kind = m["type"]
    at = lambda name: (lambda i: _join(base, f".{name}[", i, "]"))
    count = lambda name: F.coalesce(F.size(m[name]), F.lit(0))
    size_bad = lambda name: ((count(name) == 0) | (count(name) > most)) if most else count(name) == 0
    flagged = lambda name: F.coalesce(F.filter(F.transform(flags, lambda b, i: F.when(b, _issue(at(name)(i), f"invalid_{name}"))), lambda x: x.isNotNull()), _none())
    js_path = lambda i, f: _join(base, ".js[", i, f"].{f}")
    dom_path = lambda i, f: _join(base, ".dom[", i, f"].{f}")
    js = F.concat(
        _when(size_bad("js"), _join(base, ".js"), "invalid_list"),
        _each(m["js"], lambda p: ~_filled(F.coalesce(p["path"], F.lit("")), NAME), lambda i: js_path(i, "path"), "invalid_string"),
        _each(m["js"], lambda p: (F.coalesce(p["pattern"], F.lit("")) != "") & ~_filled(p["pattern"], PROBE_TEXT), lambda i: js_path(i, "pattern"), "invalid_string"),
        F.coalesce(F.filter(F.transform(flags, lambda b, i: F.when(b, _issue(js_path(i, "pattern"), "invalid_regex"))), lambda x: x.isNotNull()), _none()))
    dom = F.concat(
        _when(size_bad("dom"), _join(base, ".dom"), "invalid_list"),
        _each(m["dom"], lambda p: ~_filled(F.coalesce(p["sel"], F.lit("")), PROBE_TEXT), lambda i: dom_path(i, "sel"), "invalid_string"),
        _each(m["dom"], lambda p: (F.coalesce(p["text"], F.lit("")) != "") & ~_filled(p["text"], PROBE_TEXT), lambda i: dom_path(i, "text"), "invalid_string"),
        _each(m["dom"], lambda p: F.coalesce(F.size(p["attrs"]), F.lit(0)) > ATTRS, lambda i: dom_path(i, "attrs"), "too_many_items"),
        F.coalesce(F.filter(F.transform(flags, lambda b, i: F.when(b, _issue(dom_path(i, "text"), "invalid_regex"))), lambda x: x.isNotNull()), _none()))
    return (
        F.when(kind == "word", _list_issues(m["words"], _join(base, ".words"), most, TEXT))
        .when(kind == "regex", F.concat(_list_issues(m["regex"], _join(base, ".regex"), most, TEXT), flagged("regex")))
        .when(kind == "status", F.concat(_when(size_bad("status"), _join(base, ".status"), "invalid_list"),
                                         _each(m["status"], lambda v: ~v.between(100, 599), at("status"), "out_of_range")))
        .when(kind == "icon_hash", _when(size_bad("hash"), _join(base, ".hash"), "invalid_list"))
        .when(kind == "dsl", F.concat(_list_issues(m["dsl"], _join(base, ".dsl"), most, TEXT), flagged("dsl")))
        .when(kind == "js", js).otherwise(dom))


def _matcher_issues(m: Column, ix: Column, flags: Column, most: int) -> Column:
    base = _join("matchers[", ix, "]")
    sizes = [F.when(F.coalesce(F.size(m[f]), F.lit(0)) > 0, 1).otherwise(0) for f in PAYLOAD_FIELD.values()]
    given = lambda name: F.coalesce(m[name], F.lit("")) != ""
    header = F.concat(
        _when(given("part") & ~m["part"].isin(*PARTS), _join(base, ".part"), "invalid_enum"),
        _when(given("condition") & ~m["condition"].isin("and", "or"), _join(base, ".condition"), "invalid_enum"),
        _when(~m["confidence"].between(0, 100), _join(base, ".confidence"), "out_of_range"),
        _when(given("version") & ~_filled(m["version"], NAME), _join(base, ".version"), "invalid_string"))
    payload = F.when(sum(sizes[1:], sizes[0]) != 1, F.array(_issue(base, "invalid_payload"))).otherwise(_payload_issues(m, ix, flags, most))
    return F.when(~F.coalesce(m["type"], F.lit("")).isin(*MATCHER_TYPES), F.array(_issue(_join(base, ".type"), "invalid_enum"))).otherwise(F.concat(header, payload))


def _raw_matcher_issues(raw: Column, ix: Column) -> Column:
    """Fields that are present though they should not be, nulls, empty texts."""
    base = _join("matchers[", ix, "]")
    kind = F.coalesce(F.try_element_at(raw, F.lit("type")), F.lit(""))
    own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PAYLOAD_FIELD.items() for x in kv]), kind), F.lit(""))
    extra = F.filter(F.array_sort(F.map_keys(raw)), lambda k: ~k.isin("type", "part", "condition", "negative", "confidence", "version") & (k != own))
    scalars = ["part", "condition", "negative", "confidence", "version"]
    nulls = F.filter(F.array(*map(F.lit, scalars)), lambda f: F.map_contains_key(raw, f) & F.try_element_at(raw, f).isNull())
    empties = F.filter(F.array(*map(F.lit, ["part", "condition", "version"])), lambda f: F.try_element_at(raw, f) == "")
    named = lambda names, code: F.transform(names, lambda n: _issue(_join(base, ".", n), code))
    return F.concat(named(extra, "unsupported_field"), named(nulls, "invalid_null"), named(empties, "invalid_enum"))


def check(rules: DataFrame, candidate: bool = True, doc: str = "doc") -> DataFrame:
    """``(…, path, code)`` rows for JSON rule documents; no row means it passes.

    A document that does not decode, or that has unknown fields, has the single
    issue ``invalid_json``. ``candidate`` adds the limit of fifty list entries.
    """
    keep = [c for c in rules.columns if c != doc]
    most = CANDIDATE_LIST if candidate else 0
    decoded = T.StructType([*RULE.fields, T.StructField("_broken", T.StringType())])
    typed = rules.select(
        *keep, F.from_json(doc, decoded, {"columnNameOfCorruptRecord": "_broken"}).alias("r"),
        F.from_json(doc, "map<string,string>").alias("root")).withColumn("raw", F.from_json(F.try_element_at("root", F.lit("matchers")), "array<map<string,string>>"))
    r = F.col("r")
    unknown = F.exists(F.map_keys("root"), lambda k: ~k.isin(*RULE_FIELDS)) | F.exists(
        F.coalesce("raw", F.array().cast("array<map<string,string>>")), lambda m: F.exists(F.map_keys(m), lambda k: ~k.isin(*MATCHER_FIELDS)))
    broken = r.isNull() | r["_broken"].isNotNull() | F.coalesce(unknown, F.lit(True))
    regexes = F.transform(r["matchers"], lambda m: F.when(m["type"] == "regex", m["regex"]).when(m["type"] == "js", F.transform(m["js"], lambda p: p["pattern"])).when(
        m["type"] == "dom", F.transform(m["dom"], lambda p: p["text"])))
    expressions = F.transform(r["matchers"], lambda m: F.when(m["type"] == "dsl", m["dsl"]))
    judged = typed.select("*", broken.alias("broken"), _bad_texts(regexes, _bad_pattern).alias("bad_regex"), _bad_texts(expressions, _bad_expression).alias("bad_dsl"))
    size = F.coalesce(F.size(r["matchers"]), F.lit(0))
    null_roots = F.filter(F.array(*map(F.lit, ["confidence", "implies", "excludes"])), lambda f: F.map_contains_key("root", f) & F.try_element_at("root", f).isNull())
    header = F.concat(
        F.transform(null_roots, lambda n: _issue(n, "invalid_null")),
        _when(~_filled(F.coalesce(r["id"], F.lit("")), TEXT), "id", "invalid_string"), _when(~_filled(F.coalesce(r["name"], F.lit("")), TEXT), "name", "invalid_string"),
        _when(~F.coalesce(r["matchers-condition"], F.lit("")).isin("and", "or"), "matchers-condition", "invalid_enum"),
        _when((size == 0) | (size > most) if most else size == 0, "matchers", "invalid_list"),
        _when(~r["confidence"].between(0, 100), "confidence", "out_of_range"),
        F.when(r["implies"].isNotNull(), _list_issues(r["implies"], F.lit("implies"), most, NAME)).otherwise(_none()),
        F.when(r["excludes"].isNotNull(), _list_issues(r["excludes"], F.lit("excludes"), most, NAME)).otherwise(_none()))
    flags = lambda i: F.coalesce(F.try_element_at("bad_regex", i + 1), F.try_element_at("bad_dsl", i + 1))
    matchers = F.coalesce(F.flatten(F.transform(r["matchers"], lambda m, i: _matcher_issues(m, i, flags(i), most))), _none())
    shapes = F.coalesce(F.flatten(F.transform("raw", lambda m, i: _raw_matcher_issues(m, i))), _none())
    found = F.when(F.col("broken"), F.array(_issue("$", "invalid_json"))).otherwise(F.concat(shapes, header, matchers))
    return judged.select(*keep, F.explode_outer(found).alias("i")).where("i IS NOT NULL").select(*keep, "i.path", "i.code")


def passing(rules: DataFrame, issues: DataFrame, key: str = "rule_id") -> DataFrame:
    return rules.join(issues.select(key).distinct(), key, "left_anti")
