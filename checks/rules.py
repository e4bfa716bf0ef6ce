"""Rule-set algebra. Rule sets come from the part table: five sets, ids shared
between sets, rules as JSON text."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import query, table
from sigweave.operators import rulesets
from sigweave.streaming.runtime import work_dir

SETS_SQL = """
rule_sets AS (
  SELECT 'set-' || (p_partkey % 5) AS set_id, 'Set ' || (p_partkey % 5) AS set_name, (p_partkey % 5)::INTEGER AS set_ord, p_partkey AS rule_ord,
    'r' || (p_partkey // 3) AS rule_id, '{"name":"' || p_name || '","brand":"' || p_brand || '"}' AS rule, p_name AS name FROM part),
enabled AS (SELECT unnest(['set-0', 'set-1', 'set-3', 'set-4', 'gone']) AS set_id),
overrides AS (SELECT rule_id, CASE WHEN min(rule_ord) % 4 = 0 THEN 'set-1' ELSE 'set-9' END AS set_id FROM rule_sets GROUP BY rule_id HAVING min(rule_ord) % 2 = 0),
live AS (SELECT r.*, coalesce(o.set_id = r.set_id, false) AS chosen FROM rule_sets r LEFT JOIN overrides o USING (rule_id) WHERE r.set_id IN (SELECT set_id FROM enabled))"""
SETS = "WITH " + SETS_SQL


def rule_sets(spark, sf):
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    return part.select(
        F.concat(F.lit("set-"), (k % 5).cast("string")).alias("set_id"), F.concat(F.lit("Set "), (k % 5).cast("string")).alias("set_name"),
        (k % 5).cast("int").alias("set_ord"), k.alias("rule_ord"), F.concat(F.lit("r"), F.floor(k / 3).cast("string")).alias("rule_id"),
        F.concat(F.lit('{"name":"'), F.col("p_name"), F.lit('","brand":"'), F.col("p_brand"), F.lit('"}')).alias("rule"), F.col("p_name").alias("name"))


def enabled_sets(spark, sf):
    """Four of the sets that exist, and one that does not."""
    chosen = table(spark, sf, "part").select((F.col("p_partkey") % 5).alias("n")).distinct()
    return chosen.where("n <> 2").select(F.concat(F.lit("set-"), F.col("n").cast("string")).alias("set_id")).unionByName(
        chosen.where("n = 2").select(F.lit("gone").alias("set_id")))


def override_rows(sets):
    first = sets.groupBy("rule_id").agg(F.min("rule_ord").alias("o")).where("o % 2 = 0")
    return first.select("rule_id", F.when(F.col("o") % 4 == 0, "set-1").otherwise("set-9").alias("set_id"))


def _state(spark, sf):
    sets = rule_sets(spark, sf)
    return sets, enabled_sets(spark, sf), override_rows(sets)


@query("rules_effective", SETS + """
SELECT rule_id, set_id, rule FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY chosen DESC, set_ord DESC, rule_ord DESC) AS rn FROM live) WHERE rn = 1""")
def rules_effective(spark, sf):
    return rulesets.effective(*_state(spark, sf))


CONFLICTS = SETS + """,
held AS (SELECT rule_id, set_id, set_ord, bool_or(chosen) AS chosen FROM live GROUP BY ALL),
found AS (SELECT rule_id, string_agg(set_id, ',' ORDER BY set_ord) AS sources, arg_max(set_id, set_ord + CASE WHEN chosen THEN 100 ELSE 0 END) AS winner, bool_or(chosen) AS explicit
  FROM held GROUP BY rule_id HAVING count(*) > 1)"""


@query("rules_conflicts", CONFLICTS + " SELECT * FROM found")
def rules_conflicts(spark, sf):
    return rulesets.conflicts(*_state(spark, sf)).withColumn("sources", F.array_join("sources", ","))


@query("rules_conflict_counts", CONFLICTS + """
SELECT e.set_id, count(f.rule_id) FILTER (f.winner = e.set_id) AS wins, count(f.rule_id) FILTER (f.winner <> e.set_id) AS overridden
FROM enabled e LEFT JOIN held h USING (set_id) LEFT JOIN found f ON f.rule_id = h.rule_id GROUP BY ALL""")
def rules_conflict_counts(spark, sf):
    sets, on, overrides = _state(spark, sf)
    return rulesets.conflict_counts(rulesets.conflicts(sets, on, overrides), on)


@query("agg_ruleset_overview", SETS + """
SELECT set_id, set_name, count(*) AS n_rules, set_id IN (SELECT set_id FROM enabled) AS enabled FROM rule_sets GROUP BY ALL""")
def agg_ruleset_overview(spark, sf):
    sets, on, _ = _state(spark, sf)
    return rulesets.overview(sets, on)


@query("rules_state_valid", SETS + """
SELECT 'enabled' AS kind, '' AS rule_id, set_id FROM enabled WHERE set_id IN (SELECT set_id FROM rule_sets)
UNION ALL SELECT 'override', rule_id, set_id FROM overrides o WHERE EXISTS (SELECT 1 FROM rule_sets r WHERE r.rule_id = o.rule_id AND r.set_id = o.set_id)
UNION ALL SELECT 'active', '', 'set-3' FROM (SELECT 1 FROM rule_sets WHERE set_id = 'set-3' LIMIT 1)
UNION ALL SELECT 'active, chosen one gone', '', arg_min(set_id, set_ord) FROM rule_sets
UNION ALL SELECT 'enabled, none chosen', '', 'set-1' FROM (SELECT 1 FROM rule_sets WHERE set_id = 'set-1' LIMIT 1)
UNION ALL SELECT 'active, no sets', '', 'default'""")
def rules_state_valid(spark, sf):
    sets, *_ = state = _state(spark, sf)
    on, overrides = rulesets.valid_state(*state)
    told = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.lit("").alias("rule_id"), "set_id")
    return told("enabled", on).unionByName(overrides.select(F.lit("override").alias("kind"), "rule_id", "set_id")).unionByName(
        told("active", rulesets.active_set(sets, "set-3"))).unionByName(told("active, chosen one gone", rulesets.active_set(sets, "gone"))).unionByName(
        told("enabled, none chosen", rulesets.enabled_or_active(sets, None, "set-1"))).unionByName(told("active, no sets", rulesets.active_set(sets.where("set_id IS NULL"), "set-3")))


# An import: set-0 and set-1 are installed, set-1 and set-2 come in, some rules
# with another brand, and some of the conflicts are decided.
IMPORT_SQL = SETS + """,
existing AS (SELECT rule_id, arg_max(rule, rule_ord) AS rule FROM rule_sets WHERE set_ord IN (0, 1) GROUP BY ALL),
incoming AS (SELECT rule_id, arg_max(CASE WHEN rule_ord % 3 = 0 THEN replace(rule, 'Brand', 'Mark') ELSE rule END, rule_ord) AS rule FROM rule_sets WHERE set_ord IN (1, 2) GROUP BY ALL),
resolutions AS (SELECT rule_id, CASE WHEN min(rule_ord) % 3 = 0 THEN 'incoming' ELSE 'existing' END AS choice FROM rule_sets GROUP BY rule_id HAVING min(rule_ord) % 5 > 1),
sides AS (SELECT rule_id, e.rule AS before, i.rule AS after FROM existing e FULL JOIN incoming i USING (rule_id))"""


def _import(spark, sf):
    sets = rule_sets(spark, sf)
    changed = F.when(F.col("rule_ord") % 3 == 0, F.replace("rule", F.lit("Brand"), F.lit("Mark"))).otherwise(F.col("rule"))
    first = sets.groupBy("rule_id").agg(F.min("rule_ord").alias("o")).where("o % 5 > 1")
    resolutions = first.select("rule_id", F.when(F.col("o") % 3 == 0, "incoming").otherwise("existing").alias("choice"))
    return sets.where("set_ord IN (0, 1)"), sets.where("set_ord IN (1, 2)").withColumn("rule", changed), resolutions


@query("rules_upsert", IMPORT_SQL + " SELECT rule_id, coalesce(after, before) AS rule FROM sides")
def rules_upsert(spark, sf):
    existing, incoming, _ = _import(spark, sf)
    return rulesets.upsert(existing, incoming)


@query("rules_merge_plan", IMPORT_SQL + """
SELECT rule_id, status, CASE WHEN status IN ('added', 'replaced') THEN after ELSE before END AS rule FROM (
  SELECT rule_id, before, after, CASE WHEN after IS NULL THEN 'untouched' WHEN before IS NULL THEN 'added' WHEN before = after THEN 'unchanged'
    WHEN choice IS NULL THEN 'unresolved' WHEN choice = 'incoming' THEN 'replaced' ELSE 'kept' END AS status
  FROM sides LEFT JOIN resolutions USING (rule_id))""")
def rules_merge_plan(spark, sf):
    return rulesets.merge_plan(*_import(spark, sf))


@query("rules_update_summary", IMPORT_SQL + """
SELECT count(*) FILTER (before IS NULL) AS added, count(*) FILTER (after IS NULL) AS removed, count(*) FILTER (before <> after) AS changed,
  count(*) FILTER (before = after) AS unchanged FROM sides""")
def rules_update_summary(spark, sf):
    existing, incoming, _ = _import(spark, sf)
    return rulesets.update_summary(existing, incoming)


@query("rules_set_replace", SETS + """
SELECT set_id, set_name, rule_id, rule FROM rule_sets WHERE set_id NOT IN ('set-2', 'set-4')
UNION ALL SELECT 'set-2', 'Set 2', rule_id, replace(rule, 'Brand', 'New') FROM rule_sets WHERE set_id = 'set-1'""")
def rules_set_replace(spark, sf):
    sets = rule_sets(spark, sf)
    fresh = sets.where("set_id = 'set-1'").withColumns({"set_id": F.lit("set-2"), "set_name": F.lit("Set 2"), "set_ord": F.lit(2), "rule": F.replace("rule", F.lit("Brand"), F.lit("New"))})
    # Stored sets: the one that changes is rewritten, the deleted one goes, the others stay as they are.
    folder = work_dir(spark, "rule-sets")
    rulesets.write_sets(sets, folder)
    rulesets.write_sets(fresh.select(*sets.columns), folder)
    kept = rulesets.replace_set(rulesets.read_sets(spark, folder), "set-4", None)
    return kept.select("set_id", "set_name", "rule_id", "rule")


@query("rules_set_create", r"""
WITH taken AS (SELECT 'brand-' || substr(p_brand, 7) AS set_id FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL UNION SELECT lower(p_type) FROM part UNION SELECT lower(p_type) || '-2' FROM part WHERE p_type LIKE 'S%')
SELECT DISTINCT p_type AS set_name, lower(p_type) || CASE WHEN p_type LIKE 'S%' THEN '-3' ELSE '-2' END AS set_id FROM part""")
def rules_set_create(spark, sf):
    part = table(spark, sf, "part")
    low = F.lower("p_type")
    taken = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("brand-"), F.substring("p_brand", 7, 9)).alias("set_id")).unionByName(
        part.select(low.alias("set_id"))).unionByName(part.where("p_type LIKE 'S%'").select(F.concat(low, F.lit("-2")).alias("set_id"))).distinct()
    return rulesets.new_set_ids(part.select(F.col("p_type").alias("set_name")).distinct(), taken)


@query("rules_reconcile", SETS + """,
mapped AS (SELECT *, CASE WHEN set_id IN ('set-1', 'set-3') OR set_name = 'Set 4' THEN 'set-1' ELSE set_id END AS target FROM rule_sets),
merged AS (SELECT target AS set_id, CASE WHEN target = 'set-1' THEN 'Source' ELSE set_name END AS set_name, rule_id, rule FROM (
  SELECT *, row_number() OVER (PARTITION BY target, rule_id ORDER BY set_id = target DESC, set_ord DESC, rule_ord DESC) AS rn FROM mapped) WHERE rn = 1)
SELECT 'rule' AS kind, set_id, set_name, rule_id, rule FROM merged
UNION ALL SELECT 'enabled', set_id, '', '', '' FROM (SELECT set_id FROM enabled WHERE set_id NOT IN ('set-1', 'set-3') UNION SELECT 'set-1') WHERE set_id IN (SELECT set_id FROM merged)
UNION ALL SELECT 'override', m.set_id, '', o.rule_id, '' FROM overrides o JOIN merged m ON m.rule_id = o.rule_id AND m.set_id = CASE WHEN o.set_id IN ('set-1', 'set-3') THEN 'set-1' ELSE o.set_id END
UNION ALL SELECT 'active', 'set-1', '', '', ''""")
def rules_reconcile(spark, sf):
    sets = rule_sets(spark, sf)
    names = sets.select("set_id", "set_name").distinct()
    aliases = names.where("set_id IN ('set-1', 'set-3')").select(F.col("set_id").alias("alias"), F.lit(False).alias("by_name")).unionByName(
        names.where("set_name = 'Set 4'").select(F.col("set_name").alias("alias"), F.lit(True).alias("by_name"))).withColumns(
        {"canonical_id": F.lit("set-1"), "canonical_name": F.lit("Source")})
    _, enabled, overrides = _state(spark, sf)
    on, moved, active = rulesets.reconcile_state(sets, aliases, enabled, overrides, "set-4")
    none = F.lit("")
    told = lambda kind, df, rule_id=none: df.select(F.lit(kind).alias("kind"), "set_id", none.alias("set_name"), rule_id.alias("rule_id"), none.alias("rule"))
    return rulesets.reconcile(sets, aliases).select(F.lit("rule").alias("kind"), "set_id", "set_name", "rule_id", "rule").unionByName(
        told("enabled", on)).unionByName(told("override", moved, F.col("rule_id"))).unionByName(told("active", active))


@query("feed_merge_converted", SETS + """,
members AS (
  SELECT rule_id, rule_ord, 'matcher' AS kind, 0 AS ix, rule AS value FROM rule_sets
  UNION ALL SELECT rule_id, rule_ord, 'implies', 1, split_part(name, ' ', 1) FROM rule_sets
  UNION ALL SELECT rule_id, rule_ord, 'implies', 2, split_part(name, ' ', 2) FROM rule_sets
  UNION ALL SELECT rule_id, rule_ord, 'excludes', 1, set_name FROM rule_sets)
SELECT rule_id, kind, value, rule_ord, ix FROM members WHERE kind = 'matcher'
UNION ALL SELECT rule_id, kind, value, rule_ord, ix FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, kind, value ORDER BY rule_ord, ix) AS rn FROM members WHERE kind <> 'matcher') WHERE rn = 1""")
def feed_merge_converted(spark, sf):
    word = lambda n: F.element_at(F.split("name", " "), n)
    members = rule_sets(spark, sf).select("rule_id", "rule_ord", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(ix).alias("ix"), value.alias("value")) for kind, ix, value in (
            ("matcher", 0, F.col("rule")), ("implies", 1, word(1)), ("implies", 2, word(2)), ("excludes", 1, F.col("set_name")))])))
    return rulesets.merge_converted(members).select("rule_id", "kind", "value", "place.rule_ord", "place.ix")


@query("feed_content_hash", SETS + """,
buckets AS (SELECT set_id, substr(sha256(rule), 1, 3) AS bucket, sha256(string_agg(sha256(rule), '' ORDER BY sha256(rule))) AS b, count(*) AS n FROM rule_sets GROUP BY ALL)
SELECT set_id, sha256(string_agg(b, '' ORDER BY bucket)) AS content_hash, sum(n)::BIGINT AS n_rules FROM buckets GROUP BY ALL""")
def feed_content_hash(spark, sf):
    return rulesets.content_hash(rule_sets(spark, sf))


VERSIONS_SQL = SETS + """,
versions AS (SELECT set_id, rule_id, rule, (rule_ord % 3)::INTEGER AS version FROM rule_sets WHERE set_ord < 4 OR rule_ord % 3 = 0)"""


@query("feed_version_rollback", VERSIONS_SQL + """,
restored AS (SELECT set_id, rule_id, rule, 3 AS version FROM versions WHERE version = 1)
SELECT set_id, rule_id, rule, version FROM restored
UNION ALL SELECT set_id, rule_id, rule, version FROM versions WHERE set_id = 'set-4'""")
def feed_version_rollback(spark, sf):
    sets = rule_sets(spark, sf)
    versions = sets.where("set_ord < 4 OR rule_ord % 3 = 0").select("set_id", "rule_id", "rule", (F.col("rule_ord") % 3).cast("int").alias("version"))
    return rulesets.current_version(rulesets.rollback(versions))


@query("rule_lookup", SETS + """,
asked AS (SELECT DISTINCT ' ' || upper(p_name) AS asked FROM part UNION SELECT DISTINCT upper(rule_id) FROM rule_sets)
SELECT asked, rule_id, name FROM (
  SELECT a.asked, r.rule_id, r.name, row_number() OVER (PARTITION BY a.asked ORDER BY r.rule_ord) AS rn
  FROM asked a JOIN rule_sets r ON lower(r.rule_id) = lower(trim(a.asked)) OR lower(r.name) = lower(trim(a.asked))) WHERE rn = 1""")
def rule_lookup(spark, sf):
    sets = rule_sets(spark, sf)
    asked = table(spark, sf, "part").select(F.concat(F.lit(" "), F.upper("p_name")).alias("asked")).unionByName(sets.select(F.upper("rule_id").alias("asked"))).distinct()
    return rulesets.lookup(sets, asked)


@query("sink_rules", SETS + r"""
SELECT '{"id":"' || rule_id || '","name":"' || name || '"}' AS value FROM rule_sets WHERE set_id = 'set-1'""")
def sink_rules(spark, sf):
    from sigweave.sources.rules import to_export
    from sigweave.sources.sinks import write_lines

    chosen = rule_sets(spark, sf).where("set_id = 'set-1'").select(F.struct(F.col("rule_id").alias("id"), "name").alias("rule"))
    folder = work_dir(spark, "rules-out")
    write_lines(to_export(chosen), folder)
    return spark.read.text(folder)
