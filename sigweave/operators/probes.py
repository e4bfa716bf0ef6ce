"""Probe plans, coverage, and DOM probes on stored HTML."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.functions import html
from sigweave.functions.hashing import probe_id
from sigweave.functions.patterns import compile_pattern
from sigweave.functions.text import RE2_SPACE
from sigweave.sources.pack import RulePack, probe_key

COMPOUND = re.compile(r"\s*(?P<tag>\*|[A-Za-z][\w-]*)?(?P<rest>(?:[.#][\w-]+|\[[\w-]+(?:[~^$*|]?=(?:\"[^\"]*\"|'[^']*'|[^\]\s]+))?\])*)\s*\Z")
SIMPLE = re.compile(r"\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[~^$*|]?)=(?P<value>\"[^\"]*\"|'[^']*'|[^\]\s]+))?\]")


def plan(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(path)`` and ``(probe_id, sel, text, attrs)`` that the rules ask for.

    ``rules`` has a ``rule`` struct column; a rule table of any size works. Probes are told
    apart by what they ask, not by their ids: of 32 bits, some of a large table clash.
    """
    matchers = rules.select(F.explode("rule.matchers").alias("m"))
    paths = matchers.where("m.type = 'js'").select(F.explode("m.js.path").alias("path")).where("path <> ''").distinct()
    dom = matchers.where("m.type = 'dom'")
    bare = dom.select(F.explode("m.words").alias("sel")).select(
        "sel", F.lit("").alias("text"), F.lit(None).cast("map<string,string>").alias("attrs"))
    full = dom.select(F.inline("m.dom")).select("sel", F.coalesce("text", F.lit("")).alias("text"), "attrs")
    asked = bare.unionByName(full).withColumn("_pairs", F.coalesce(F.array_sort(F.map_entries("attrs")), F.expr("array()")))
    probes = asked.dropDuplicates(["sel", "text", "_pairs"]).drop("_pairs")
    return paths, probes.withColumn("probe_id", probe_id(F.col("sel"), F.col("text"), F.col("attrs")))


def hit_selectors(captures: DataFrame, probes: DataFrame) -> DataFrame:
    """``(capture_id, selectors)``: probe ids of a capture as selectors."""
    held = captures.select("capture_id", F.explode(F.map_keys("dom_hits")).alias("probe_id"))
    named = held.join(probes.select("probe_id", "sel"), "probe_id")
    return named.groupBy("capture_id").agg(F.array_sort(F.collect_set("sel")).alias("selectors"))


def coverage(captures: DataFrame, pack: RulePack) -> DataFrame:
    """``(capture_id, rule_id, missing_paths, has_dom, complete)`` for rules with
    runtime or DOM matchers. What the rules ask for is part of the projection, so
    each capture is judged where it is read."""
    asked = []
    for rule in pack.source:
        paths = list(dict.fromkeys(p.get("path") or "" for m in rule["matchers"] if m.get("type") == "js" for p in m.get("js") or []))
        has_dom = any(m.get("type") == "dom" for m in rule["matchers"])
        if paths or has_dom:
            asked.append(F.struct(F.lit(rule["id"]).alias("rule_id"), F.array(*map(F.lit, paths)).cast("array<string>").alias("paths"), F.lit(has_dom).alias("has_dom")))
    rows = captures.select("capture_id", F.map_keys("js").alias("known"), F.inline(F.array(*asked)))
    missing = F.array_except("paths", "known")
    return rows.select("capture_id", "rule_id", missing.alias("missing_paths"), "has_dom", ((F.size(missing) == 0) & ~F.col("has_dom")).alias("complete"))


def parse_selector(selector: str) -> list[list[tuple]] | None:
    """Alternatives of simple conditions, or None for selectors with combinators
    or states, which need a tree."""
    out = []
    for part in re.split(r",(?![^\[]*\])", selector):
        m = COMPOUND.match(part)
        if not m or not (m.group("tag") or m.group("rest")):
            return None
        checks: list[tuple] = [("tag", m.group("tag").lower())] if m.group("tag") and m.group("tag") != "*" else []
        for s in SIMPLE.finditer(m.group("rest")):
            if s.group("cls"):
                checks.append(("~", "class", s.group("cls")))
            elif s.group("id"):
                checks.append(("", "id", s.group("id")))
            else:
                value = s.group("value")
                checks.append((s.group("op") or "" if value else "has", s.group("attr").lower(), (value or "").strip("\"'")))
        out.append(checks)
    return out


def _present(name: str) -> Column:
    return F.exists("pairs", lambda p: p["name"] == name)


def _check(check: tuple) -> Column:
    tag, pairs = F.col("tag"), F.col("pairs")
    if check[0] == "tag":
        return tag == check[1]
    op, name, value = check
    found = html.attribute(pairs, name)
    present = _present(name)
    return {
        "has": present, "": present & (found == value), "~": F.array_contains(F.split(found, f"[{RE2_SPACE}]+"), value),
        "^": found.startswith(value), "$": found.endswith(value), "*": F.contains(found, F.lit(value)),
        "|": (found == value) | found.startswith(value + "-"),
    }[op]


def offline_dom_hits(captures: DataFrame, probes: list[dict]) -> tuple[DataFrame, list[str]]:
    """(``(capture_id, probe_id)`` of probes that hold in stored HTML, uncovered
    selectors). Probes with a text condition or a selector beyond one compound
    are returned as uncovered."""
    usable, uncovered = [], []
    for p in probes:
        checks = parse_selector(p["sel"])
        patterns = {k.lower(): compile_pattern(v) for k, v in (p.get("attrs") or {}).items()}
        if checks is None or p.get("text") or not all(c.valid for c in patterns.values()):
            uncovered.append(p["sel"])
            continue
        usable.append((probe_key(p["sel"], "", p.get("attrs")), checks, patterns))
    opening = F.regexp_extract_all("body", F.lit(f"(?is)<[a-z][\\w-]*(?:[{RE2_SPACE}][^>]*)?>"), F.lit(0))
    elements = captures.select("capture_id", F.explode_outer(opening).alias("text")).where("text IS NOT NULL").select(
        "capture_id", F.lower(F.regexp_extract("text", "<([A-Za-z][\\w-]*)", 1)).alias("tag"), html.attributes(F.col("text")).alias("pairs"))
    conditions = []
    for key, alternatives, patterns in usable:
        held = F.lit(False)
        for checks in alternatives:
            one = F.lit(True)
            for c in checks:
                one = one & _check(c)
            held = held | one
        for name, pattern in patterns.items():
            held = held & _present(name) & F.rlike(html.attribute(F.col("pairs"), name), F.lit(pattern.java))
        conditions.append(F.when(held, F.lit(key)))
    ids = F.array_compact(F.array(*conditions)) if conditions else F.array().cast("array<string>")
    return elements.select("capture_id", F.explode_outer(ids).alias("probe_id")).where("probe_id IS NOT NULL").distinct(), uncovered
