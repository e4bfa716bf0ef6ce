"""Repair of loosely typed rule documents.

Documents stay variants until every field has been brought to its type: single
values become lists, numeric text becomes numbers, a confidence between 0 and 1
becomes a percentage, and matchers or rules that end up empty are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.functions.text import let

VERSION_CHARS = 500


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(v: Column) -> Column:
    """Scalar as text; NULL for null, list and object."""
    return F.try_variant_get(v, "$", "string")


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _items(v: Column) -> Column:
    """A list as it is, anything else as a list of one, null as an empty list."""

    def listed(held: Column) -> Column:
        return let(_kind(held), lambda kind: F.when(kind.startswith("ARRAY"), F.try_variant_get(held, "$", "array<variant>")).when(
            kind == "VOID", F.array().cast("array<variant>")).otherwise(F.array(held)))

    return let(v, listed)


def _truthy(v: Column) -> Column:
    def judged(held: Column) -> Column:
        text = _text(held)
        return let(_kind(held), lambda kind: F.when(kind == "VOID", False).when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true").when(
            kind.startswith("ARRAY") | kind.startswith("OBJECT"), True).otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True))))

    return let(v, judged)


def text_list(v: Column) -> Column:
    return F.filter(F.transform(_items(v), lambda x: F.coalesce(_text(x), F.lit(""))), lambda s: s != "")


def int_list(v: Column) -> Column:
    numbers = F.transform(_items(v), lambda x: F.when((_text(x) == "") | (_kind(x) == "VOID"), F.lit(0.0)).otherwise(F.trim(_text(x)).try_cast("double")))
    finite = F.filter(numbers, lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) < 9e15))
    return F.transform(finite, lambda n: F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("bigint"))


def percent(v: Column) -> Column:
    """0-1 as 0-100, rounded half up; NULL outside 0-100 or without a number."""
    n = F.trim(F.nullif(_text(v), F.lit(""))).try_cast("double")
    scaled = F.floor(F.when(n > 1, n).otherwise(n * 100) + 0.5)
    return F.when(~F.isnan(n) & scaled.between(0, 100), scaled.cast("int"))


def _objects(v: Column) -> Column:
    def listed(held: Column) -> Column:
        kind = _kind(held)
        return F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), _items(held)).otherwise(F.array().cast("array<variant>"))

    return F.filter(let(v, listed), lambda x: _kind(x).startswith("OBJECT"))


def _filled(v: Column) -> Column:
    return let(v, lambda held: F.when(_truthy(held), _text(held)))


def js_probes(v: Column) -> Column:
    kept = F.filter(_objects(v), lambda p: F.trim(F.coalesce(_text(_get(p, "path")), F.lit(""))) != "")
    return F.transform(kept, lambda p: F.struct(_text(_get(p, "path")).alias("path"), _filled(_get(p, "pattern")).alias("pattern")))


def dom_probes(v: Column) -> Column:
    kept = F.filter(_objects(v), lambda p: F.trim(F.coalesce(_text(_get(p, "sel")), F.lit(""))) != "")
    return F.transform(kept, lambda p: F.struct(
        _text(_get(p, "sel")).alias("sel"), _filled(_get(p, "text")).alias("text"),
        F.try_variant_get(p, "$.attrs", "map<string,string>").alias("attrs")))


def repair_matcher(m: Column) -> Column:
    return let(F.trim(F.coalesce(_text(_get(m, "type")), F.lit(""))), lambda kind: _matcher_of(m, kind))


def _matcher_of(m: Column, kind: Column) -> Column:
    when = lambda name, value: F.when(kind == name, value)
    return F.struct(
        kind.alias("type"), _filled(_get(m, "part")).alias("part"), _filled(_get(m, "condition")).alias("condition"),
        F.when(_truthy(_get(m, "negative")), True).alias("negative"),
        when("word", text_list(_get(m, "words"))).alias("words"), when("regex", text_list(_get(m, "regex"))).alias("regex"),
        when("status", int_list(_get(m, "status"))).alias("status"), when("icon_hash", int_list(_get(m, "hash"))).alias("hash"),
        when("dsl", text_list(_get(m, "dsl"))).alias("dsl"), when("js", js_probes(_get(m, "js"))).alias("js"), when("dom", dom_probes(_get(m, "dom"))).alias("dom"),
        percent(_get(m, "confidence")).alias("confidence"),
        F.when(F.trim(F.coalesce(_text(_get(m, "version")), F.lit(""))) != "", F.substring(_text(_get(m, "version")), 1, VERSION_CHARS)).alias("version"))


def _has_payload(m: Column) -> Column:
    sizes = [F.coalesce(F.size(m[f]), F.lit(0)) for f in ("words", "regex", "status", "hash", "dsl", "js", "dom")]
    return sum(sizes[1:], sizes[0]) > 0


def repair(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Variant documents to repaired ``rule`` structs; hopeless ones are dropped."""
    keep = [c for c in docs.columns if c != doc]
    v = F.col(doc)
    rid = F.trim(F.coalesce(_text(_get(v, "id")), F.lit("")))

    def single_or_list(raw: Column) -> Column:
        return let(_kind(raw), lambda kind: F.when(kind.startswith("ARRAY"), F.try_variant_get(raw, "$", "array<variant>")).when(
            kind.startswith("OBJECT"), F.array(raw)).otherwise(F.array().cast("array<variant>")))

    listed = let(_get(v, "matchers"), single_or_list)
    condition = F.coalesce(_filled(_get(v, "matchers-condition")), _filled(_get(v, "matchersCondition")))
    matchers = F.filter(F.transform(F.filter(listed, lambda m: _kind(m).startswith("OBJECT")), repair_matcher), _has_payload)
    rule = F.struct(
        rid.alias("id"), F.trim(F.coalesce(_filled(_get(v, "name")), rid)).alias("name"), condition.alias("matchers-condition"), matchers.alias("matchers"),
        F.when(_truthy(_get(v, "implies")), text_list(_get(v, "implies"))).alias("implies"),
        F.when(_truthy(_get(v, "excludes")), text_list(_get(v, "excludes"))).alias("excludes"), percent(_get(v, "confidence")).alias("confidence"))
    # Filters on the document or the repaired rule would be pushed below parsing and repair and
    # repeat them; what is no object has no id.
    kept = F.filter(F.array(rule), lambda r: (r["id"] != "") & (F.size(r["matchers"]) > 0))
    return docs.select(*keep, F.explode(kept).alias("rule"))


def flatten_lists(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Lists of documents become single documents, however deep they are nested."""
    keep = [c for c in docs.columns if c != doc]
    flat = docs
    while True:
        flat = flat.select(*keep, F.explode(_items(F.col(doc))).alias(doc))
        if flat.where(_kind(F.col(doc)).startswith("ARRAY")).isEmpty():
            return flat.where(_kind(F.col(doc)) != "VOID")


def is_template(v: Column) -> Column:
    blocks = _kind(_get(v, "http")).startswith("ARRAY") | _kind(_get(v, "requests")).startswith("ARRAY")
    return (F.trim(F.coalesce(_text(_get(v, "id")), F.lit(""))) != "") & _kind(_get(v, "info")).startswith("OBJECT") & blocks


def route(docs: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(scanner templates as they are, native documents repaired)."""
    flat = flatten_lists(docs, doc)
    return flat.where(is_template(F.col(doc))), repair(flat.where(~is_template(F.col(doc))), doc)
