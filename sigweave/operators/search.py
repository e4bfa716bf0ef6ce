"""Text search in captures and rules, and trials of patterns on samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.functions import html
from sigweave.functions.patterns import compile_pattern
from sigweave.functions.snapshots import redacted
from sigweave.functions.text import clip, clip_with_mark, extract, lower_text, may_match, quoted, trim_space
from sigweave.sources.pack import lower_literal

# Context around a find, and how many finds are shown.
CONTEXT_CHARS, BODY_FINDS, JS_FINDS, RULE_FINDS = 120, 10, 30, 30
JS_VALUE_CHARS, SAMPLE_DETAIL_CHARS = 500, 200


def body_finds(body: Column, needle: str, limit: int = BODY_FINDS) -> Column:
    """Pieces of the body around the first occurrences, ignoring case.

    The lower-case body is split at the needle; running lengths of the pieces
    give the position of every occurrence.
    """
    text = lower_literal(needle.strip())
    size = len(text)
    pieces = F.transform(F.split(lower_text(body), quoted(text), -1), F.length)
    sums = F.aggregate(
        F.slice(pieces, 1, F.least(F.size(pieces) - 1, F.lit(min(limit, BODY_FINDS)))),
        F.array().cast("array<int>"),
        lambda acc, n: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)) + size, F.lit(0)) + n))
    return F.transform(sums, lambda at: F.substring(
        body, F.greatest(at - CONTEXT_CHARS, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT_CHARS)) + size + CONTEXT_CHARS))


def js_finds(captures: DataFrame, needle: str, limit: int = JS_FINDS) -> DataFrame:
    """Runtime paths whose name or value contains the text, by path."""
    text = needle.strip().lower()
    held = F.filter(F.array_sort(F.map_entries("js")), lambda e: F.contains(F.lower(F.concat(e["key"], F.lit(" "), e["value"])), F.lit(text)))
    return captures.select("capture_id", F.inline(F.slice(held, 1, min(limit, JS_FINDS)))).select(
        "capture_id", F.col("key").alias("path"), clip(F.col("value"), JS_VALUE_CHARS).alias("value"))


def rule_finds(rules: DataFrame, needle: str, limit: int = RULE_FINDS) -> DataFrame:
    """Rules named exactly so first, then those that contain the text in id, name
    or matchers. ``rules`` is ``(set_id, set_ord, rule_ord, rule_id, name,
    matchers)`` with matchers as JSON text; one row per set and id."""
    text = needle.strip().lower()
    exact = (F.lower("rule_id") == text) | (F.lower("name") == text)
    within = F.contains(F.lower(F.concat_ws("\n", "rule_id", "name", "matchers")), F.lit(text))
    found = rules.where(exact | within).withColumn("place", F.struct((~exact).alias("later"), "set_ord", "rule_ord"))
    once = found.groupBy("set_id", "rule_id").agg(F.min(F.struct("place", "name")).alias("r"))
    return once.orderBy("r.place").limit(min(limit, RULE_FINDS)).select(
        "set_id", "rule_id", F.col("r.name").alias("name"), (~F.col("r.place.later")).alias("exact"))


def page_overview(captures: DataFrame) -> DataFrame:
    """What describes a capture, without its body and without cookies."""
    return captures.select("capture_id", *[c for c in redacted()]).drop("dom_hits")


def try_patterns(samples: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """Each sample against each pattern: valid, matched, first match.

    Patterns are few and become expressions of one projection.
    """
    kept = [c for c in samples.columns if c != text]
    sample, low = F.col(text), F.col("_low")

    def tried(p):
        detail = clip_with_mark(extract(sample, F.lit(p.java), 0), SAMPLE_DETAIL_CHARS) if p.valid else F.lit("")
        matched = may_match(p.literals, low) & F.rlike(sample, F.lit(p.java)) if p.valid else F.lit(False)
        return F.struct(F.lit(p.source).alias("pattern"), F.lit(p.valid).alias("valid"), F.when(matched, detail).alias("found"))

    rows = samples.select(*kept, text, lower_text(sample).alias("_low")).select(
        *kept, F.inline(F.array(*[tried(compile_pattern(p)) for p in patterns])))
    return rows.select(*kept, "pattern", "valid", F.col("found").isNotNull().alias("matched"), F.coalesce("found", F.lit("")).alias("detail"))


def try_words(samples: DataFrame, words: list[str], condition: str = "or", negative: bool = False, text: str = "text") -> DataFrame:
    """Each sample against a list of words: the ones it contains, and whether the
    list as a whole holds."""
    low = lower_text(F.col(text))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(lower_literal(w))), F.lit(w)) for w in words]))
    kept = [c for c in samples.columns if c != text]
    rows = samples.select(*kept, found.alias("matched_words"))
    held = F.size("matched_words") == len(words) if condition.lower() == "and" else F.size("matched_words") > 0
    return rows.withColumn("matched", ~held if negative else held)


def visible_runs(body: Column) -> Column:
    """Text runs of a page as a reader meets them: scripts, styles and noscript
    content left out, split at tags."""
    shown = F.regexp_replace(body, "(?is)<(script|style|noscript)\\b[\\s\\S]*?</\\1>|<!--[\\s\\S]*?-->", "<>")
    return F.split(F.regexp_replace(shown, html.TITLE, "<>"), "<[^>]*>")


def locate(hits: DataFrame, captures: DataFrame) -> DataFrame:
    """Run and position of word and regex evidence in the visible text of bodies.

    ``hits`` is ``(capture_id, type, part, detail)``; evidence of other parts is
    not looked for. Positions count from 1 within the first run that holds it.
    """
    wanted = hits.where(F.col("type").isin("word", "regex") & F.col("part").isin("body", "raw", ""))
    needle = F.lower(trim_space(F.regexp_replace("detail", "…\\z", "")))
    # The evidence of a capture is a short list; a body meets it once and is stripped once.
    asked = wanted.select("capture_id", "detail", needle.alias("needle")).where("needle <> ''").groupBy("capture_id").agg(
        F.collect_list(F.struct("detail", "needle")).alias("asked"))
    rows = captures.select("capture_id", "body").join(asked, "capture_id").select(
        "capture_id", "asked", F.transform(visible_runs(F.col("body")), lambda r: F.lower(r)).alias("runs"))
    first = lambda a: F.try_element_at(F.filter(F.transform(
        "runs", lambda r, i: F.struct(i.alias("run"), F.instr(r, a["needle"]).alias("position"))), lambda x: x["position"] > 0), F.lit(1))
    found = F.transform("asked", lambda a: F.struct(a["detail"].alias("detail"), first(a).alias("at")))
    return rows.select("capture_id", F.inline(found)).where("at IS NOT NULL").select("capture_id", "detail", "at.run", "at.position")
