"""From pattern hits to rule hits.

Three outcomes per condition: hit, miss, invalid. Only hits and failures exist as
rows; misses are what is left of the known number of patterns. One exchange by
capture puts the narrow hit rows together and every later grouping keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.sources.pack import RulePack

NEGATIVE_DETAIL = "negative holds: the condition was not met"


def matcher_state(condition: Column, hits: Column, invalid: Column, total: Column) -> Column:
    """True for a hit, false for a miss, NULL for invalid."""
    misses = total - hits - invalid
    return (
        F.when(total == 0, F.lit(False))
        .when(condition == "and", F.when(misses > 0, False).when(invalid == 0, True))
        .otherwise(F.when(hits > 0, True).when(invalid == 0, False))
    )


def matcher_hits(hits: DataFrame, pack: RulePack) -> DataFrame:
    """``(capture_id, rule_ord, mid, matcher_ix, confidence, evidence)`` of the
    matchers that hold, negative ones included.

    With negative matchers in the pack every capture must have a row, so that captures
    without any hit take part: the one that ``pattern_hits`` gives for a capture as such.
    """
    spark = hits.sparkSession
    laid = hits.repartition("capture_id")
    patterns = F.broadcast(pack.pattern_table(spark).select("pid", "mid", "pattern_ix", "type", "part", "pattern"))
    matchers = F.broadcast(pack.matcher_table(spark).withColumnsRenamed({"type": "m_type", "part": "m_part"}))
    is_text = F.col("type").isin("word", "regex")
    evidence = F.struct(
        "pattern_ix", "type", F.when(is_text, F.col("part")).otherwise("").alias("part"), "detail",
        F.when(F.col("type") == "regex", F.col("pattern")).otherwise("").alias("pattern"), "version",
    )
    state = laid.join(patterns, "pid", "left").groupBy("capture_id", "mid").agg(
        F.sum(F.when(F.col("failed"), 0).otherwise(1)).alias("hits"),
        F.sum(F.when(F.col("failed"), 1).otherwise(0)).alias("failures"),
        F.array_sort(F.collect_list(F.when(~F.col("failed"), evidence))).alias("evidence"),
    ).join(matchers, "mid", "left").withColumn("state", matcher_state(
        F.col("condition"), F.col("hits"), F.col("n_invalid") + F.col("failures"), F.col("n_patterns")))
    columns = ["rule_ord", "mid", "matcher_ix", "confidence", "evidence"]
    if not pack.negative_ids:
        return state.where("state").select("capture_id", *columns)
    return _with_negatives(state, columns, pack)


def _with_negatives(state: DataFrame, columns: list[str], pack: RulePack) -> DataFrame:
    """Turn misses of negative matchers into hits, one row per capture at a time.

    A negative matcher without any row is a plain miss unless its own patterns
    are invalid; which ones those are is known from the pack. So a capture holds
    all of them but the ones it has a hit or a failure for.
    """
    quiet = [m for m in pack.matchers if m.negative and (
        m.n_invalid == 0 or (m.condition == "and" and m.n_invalid < m.n_patterns))]
    generic = lambda m: F.struct(
        F.lit(m.rule_ord).alias("rule_ord"), F.lit(m.mid).alias("mid"), F.lit(m.matcher_ix).alias("matcher_ix"),
        F.lit(m.confidence).cast("int").alias("confidence"),
        F.array(F.struct(F.lit(0).alias("pattern_ix"), F.lit(m.type).alias("type"), F.lit(m.part).alias("part"),
                         F.lit(NEGATIVE_DETAIL).alias("detail"), F.lit("").alias("pattern"), F.lit("").alias("version"))).alias("evidence"))
    absent = F.array(*[generic(m) for m in quiet]) if quiet else F.slice("held", 1, 0)
    row = F.struct(*columns)
    per_capture = state.groupBy("capture_id").agg(
        F.collect_list(F.when(~F.col("negative") & F.col("state"), row)).alias("held"),
        F.collect_list(F.when(F.col("negative") & F.coalesce("state", F.lit(True)), F.col("mid"))).alias("blocked"),
    )
    return per_capture.select("capture_id", F.inline(F.concat(
        "held", F.filter(absent, lambda m: ~F.array_contains(F.col("blocked"), m["mid"])))))


def rule_hits(matched: DataFrame, pack: RulePack) -> DataFrame:
    """``(capture_id, rule_ord, rule_id, name, version, confidence, evidence)``."""
    rules = F.broadcast(pack.rule_table(matched.sparkSession).withColumnRenamed("confidence", "rule_confidence"))
    grouped = matched.groupBy("capture_id", "rule_ord").agg(
        F.count(F.lit(1)).alias("n_hit"),
        F.max("confidence").alias("strongest"),
        F.min("confidence").alias("weakest"),
        F.array_sort(F.collect_list(F.struct("matcher_ix", "evidence"))).alias("per_matcher"),
    ).join(rules, "rule_ord")
    held = grouped.where((F.col("condition") == "or") | (F.col("n_hit") == F.col("n_matchers")))
    evidence = F.flatten(F.transform("per_matcher", lambda m: F.transform(m["evidence"], lambda e: F.struct(
        m["matcher_ix"].alias("matcher_ix"), e["pattern_ix"].alias("pattern_ix"), e["type"].alias("type"), e["part"].alias("part"),
        e["detail"].alias("detail"), e["pattern"].alias("pattern"), e["version"].alias("version")))))
    signal = F.when(F.col("condition") == "and", F.col("weakest")).otherwise(F.col("strongest"))
    return held.select(
        "capture_id", "rule_ord", "rule_id", "name",
        confidence(signal, F.col("rule_confidence")).alias("confidence"), evidence.alias("evidence"),
    ).withColumn("version", first_version(F.col("evidence")))


def confidence(signal: Column, rule_level: Column) -> Column:
    """Matcher signal scaled by the rule's own value, cut to a whole number."""
    scaled = (signal * rule_level / F.lit(100)).cast("int")
    return F.when(signal.isNull(), rule_level).when(rule_level.isNull(), signal).otherwise(scaled)


def first_version(evidence: Column) -> Column:
    held = F.filter(evidence, lambda e: e["version"] != "")
    return F.coalesce(F.try_element_at(held, F.lit(1))["version"], F.lit(""))
