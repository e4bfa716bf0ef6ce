"""Algebra of rule sets.

Rule sets are tables ``(set_id, set_name, set_ord, rule_ord, rule_id, rule)``
where ``rule`` is any comparable column, usually JSON text. Everything is a
grouping by rule id with maxima, so partial aggregation applies and one id that
occurs in very many rows does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by ``rule_id``; the incoming rule wins, later rows beat earlier ones."""
    both = existing.select("rule_id", "rule_ord", "rule", F.lit(0).alias("side")).unionByName(
        incoming.select("rule_id", "rule_ord", "rule", F.lit(1).alias("side")))
    return both.groupBy("rule_id").agg(F.max_by("rule", F.struct("side", "rule_ord")).alias("rule"))


def _versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per id with the rule of either side (NULL where it is absent)."""
    both = existing.select("rule_id", "rule_ord", "rule", F.lit(False).alias("is_new")).unionByName(
        incoming.select("rule_id", "rule_ord", "rule", F.lit(True).alias("is_new"))).where("rule_id <> ''")
    pick = lambda new: F.max_by(F.when(F.col("is_new") == new, F.col("rule")), F.when(F.col("is_new") == new, F.col("rule_ord")))
    return both.groupBy("rule_id").agg(pick(False).alias("before"), pick(True).alias("after"))


def merge_plan(existing: DataFrame, incoming: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``(rule_id, status, rule)``: what an import would do with each incoming id.

    Status is added, unchanged, replaced, kept, or unresolved; ``resolutions`` is
    ``(rule_id, choice)`` and ``rule`` is what the merged set holds.
    """
    plan = _versions(existing, incoming).join(resolutions.select("rule_id", "choice"), "rule_id", "left")
    status = (
        F.when(F.col("after").isNull(), "untouched").when(F.col("before").isNull(), "added")
        .when(F.col("before") == F.col("after"), "unchanged").when(F.col("choice").isNull(), "unresolved")
        .when(F.col("choice") == "incoming", "replaced").otherwise("kept"))
    merged = F.when(status.isin("added", "replaced"), F.col("after")).otherwise(F.col("before"))
    return plan.select("rule_id", status.alias("status"), merged.alias("rule"))


def update_summary(previous: DataFrame, following: DataFrame) -> DataFrame:
    """added, removed, changed, unchanged between two versions."""
    before, after = F.col("before"), F.col("after")
    return _versions(previous, following).agg(
        F.count_if(before.isNull()).alias("added"), F.count_if(after.isNull()).alias("removed"),
        F.count_if(before != after).alias("changed"), F.count_if(before == after).alias("unchanged"))


def _enabled(rule_sets: DataFrame, enabled: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rules of enabled sets, flagged where an override names their set."""
    chosen = overrides.select("rule_id", F.col("set_id").alias("chosen_set"))
    return rule_sets.join(enabled.select("set_id").distinct(), "set_id", "left_semi").join(chosen, "rule_id", "left").withColumn(
        "chosen", F.coalesce(F.col("chosen_set") == F.col("set_id"), F.lit(False)))


def effective(rule_sets: DataFrame, enabled: DataFrame, overrides: DataFrame) -> DataFrame:
    """``(rule_id, set_id, rule)``: the later set wins, an override beats order."""
    return _enabled(rule_sets, enabled, overrides).groupBy("rule_id").agg(
        F.max_by(F.struct("set_id", "rule"), F.struct("chosen", "set_ord", "rule_ord")).alias("w")).select("rule_id", "w.*")


def conflicts(rule_sets: DataFrame, enabled: DataFrame, overrides: DataFrame) -> DataFrame:
    """``(rule_id, sources, winner, explicit)`` for ids in several enabled sets.

    ``sources`` lists sets, of which there are few, not rows.
    """
    per_set = _enabled(rule_sets, enabled, overrides).where("rule_id <> ''").groupBy("rule_id", "set_id").agg(
        F.max("set_ord").alias("set_ord"), F.max("chosen").alias("chosen"))
    return per_set.groupBy("rule_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("set_ord", "set_id"))), lambda s: s["set_id"]).alias("sources"),
        F.max_by("set_id", F.struct("chosen", "set_ord")).alias("winner"), F.max("chosen").alias("explicit"),
    ).where(F.size("sources") > 1)


def conflict_counts(found: DataFrame, enabled: DataFrame) -> DataFrame:
    """``(set_id, wins, overridden)`` for every enabled set."""
    counted = found.select(F.explode("sources").alias("set_id"), "winner").groupBy("set_id").agg(
        F.count_if(F.col("set_id") == F.col("winner")).alias("wins"), F.count_if(F.col("set_id") != F.col("winner")).alias("overridden"))
    none = F.lit(0).cast("bigint")
    return enabled.select("set_id").distinct().join(counted, "set_id", "left").select(
        "set_id", F.coalesce("wins", none).alias("wins"), F.coalesce("overridden", none).alias("overridden"))


def overview(rule_sets: DataFrame, enabled: DataFrame) -> DataFrame:
    on = enabled.select("set_id", F.lit(True).alias("on")).distinct()
    return rule_sets.groupBy("set_id", "set_name").agg(F.count(F.lit(1)).alias("n_rules")).join(on, "set_id", "left").select(
        "set_id", "set_name", "n_rules", F.coalesce("on", F.lit(False)).alias("enabled"))


DEFAULT_SET = "default"


def valid_state(rule_sets: DataFrame, enabled: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enabled ids and overrides that point at something."""
    sets = rule_sets.select("set_id").distinct()
    held = rule_sets.select("rule_id", "set_id").distinct()
    return (enabled.select("set_id").distinct().join(sets, "set_id", "left_semi"),
            overrides.join(held, ["rule_id", "set_id"], "left_semi"))


def active_set(rule_sets: DataFrame, active: str | None) -> DataFrame:
    """``(set_id)`` of the set that is edited: the chosen one if it is there, else the first,
    else the default set, which then is the only one and has no rules."""
    chosen = F.struct((F.col("set_id") != F.lit(active)).alias("other"), "set_ord", "set_id") if active else F.struct(F.lit(True).alias("other"), "set_ord", "set_id")
    return rule_sets.agg(F.coalesce(F.min(chosen)["set_id"], F.lit(DEFAULT_SET)).alias("set_id"))


def enabled_or_active(rule_sets: DataFrame, enabled: DataFrame | None, active: str | None) -> DataFrame:
    """Where no sets were ever chosen, the active one alone is enabled."""
    return active_set(rule_sets, active) if enabled is None else enabled


def reconcile_state(rule_sets: DataFrame, aliases: DataFrame, enabled: DataFrame, overrides: DataFrame, active: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Enabled ids, overrides and active set after ``reconcile``.

    Ids of aliases give way to their stable id, which is enabled if one of the sets that
    became it was, or if it was there itself. Overrides follow the id they name. What then
    points at nothing is dropped.
    """
    merged = reconcile(rule_sets, aliases)
    ids = aliases.where("NOT by_name").select(F.col("alias").alias("set_id"), "canonical_id")
    own = aliases.select(F.col("canonical_id").alias("set_id"), "canonical_id")
    ids = ids.unionByName(own).distinct()
    names = aliases.where("by_name").select(F.col("alias").alias("set_name"), "canonical_id")
    sets = rule_sets.select("set_id", "set_name").distinct()
    became = sets.join(ids, "set_id").select("set_id", "canonical_id").unionByName(sets.join(names, "set_name").select("set_id", "canonical_id")).distinct()
    chosen = became.join(enabled.select("set_id").distinct().withColumn("_on", F.lit(True)), "set_id", "left").where(
        F.col("_on") | (F.col("set_id") == F.col("canonical_id"))).select(F.col("canonical_id").alias("set_id"))
    on = enabled.select("set_id").join(ids, "set_id", "left_anti").unionByName(chosen).distinct()
    moved = overrides.join(ids, "set_id", "left").select("rule_id", F.coalesce("canonical_id", "set_id").alias("set_id"))
    on, moved = valid_state(merged, on, moved)
    place = became.where(F.col("set_id") == active).agg(F.coalesce(F.min("canonical_id"), F.lit(active)).alias("wanted"))
    first = merged.groupBy("set_id").agg(F.min("set_ord").alias("set_ord")).join(F.broadcast(place), F.col("set_id") == F.col("wanted"), "left")
    now = first.agg(F.coalesce(F.min(F.struct(F.col("wanted").isNull().alias("other"), "set_ord", "set_id"))["set_id"], F.lit(DEFAULT_SET)).alias("set_id"))
    return on, moved, now


def set_slug(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "\\A-+|-+\\z", ""), F.lit("")), F.lit("ruleset"))


def new_set_ids(names: DataFrame, taken: DataFrame) -> DataFrame:
    """Unique id for each new set name: the slug, else the slug with the first
    free suffix -2, -3, ... Names that share a slug get the free suffixes in the order of
    the names. ``taken`` is ``(set_id)``; one name is one row."""
    based = names.withColumn("base", set_slug(F.col("set_name")))
    suffix = F.regexp_extract("set_id", "-([0-9]{1,9})\\z", 1)
    used = taken.select(F.regexp_replace("set_id", "-[0-9]{1,9}\\z", "").alias("base"), suffix.try_cast("int").alias("n")).unionByName(
        taken.select(F.col("set_id").alias("base"), F.lit(1).alias("n")))
    # A new name that looks like a numbered one takes that number from the others.
    own = based.select(F.regexp_replace("base", "-[0-9]{1,9}\\z", "").alias("stem"), "base", F.regexp_extract("base", "-([0-9]{1,9})\\z", 1).try_cast("int").alias("n"))
    used = used.unionByName(own.where("stem <> base").select(F.col("stem").alias("base"), "n"))
    numbers = used.where("n >= 1").join(based.select("base").distinct(), "base", "left_semi").groupBy("base").agg(
        F.collect_set("n").alias("used"))
    ranked = based.withColumn("rank", F.row_number().over(Window.partitionBy("base").orderBy("set_name")))
    free = F.array_except(F.sequence(F.lit(1), F.size("used") + F.col("rank")), F.col("used"))
    n = F.element_at(free, F.col("rank"))
    return ranked.join(numbers, "base", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>"))).select(
        "set_name", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string"))).alias("set_id"))


def replace_set(rule_sets: DataFrame, set_id: str, rules: DataFrame | None) -> DataFrame:
    """Replace or create the rules of one set; ``None`` deletes the set.

    Write the result partitioned by ``set_id`` with dynamic partition overwrite
    and only the partition of this set is rewritten.
    """
    rest = rule_sets.where(F.col("set_id") != set_id)
    if rules is not None:
        return rest.unionByName(rules)
    if rest.isEmpty():
        raise ValueError("at least one rule set has to stay")
    return rest


def write_sets(rule_sets: DataFrame, path: str) -> None:
    """Write sets of rules; of stored sets only those among them are rewritten."""
    rule_sets.repartition("set_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_id").parquet(path)


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def reconcile(rule_sets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Fold alias sets into their stable id.

    ``aliases`` is ``(alias, by_name, canonical_id, canonical_name)``; a set joins
    by id or, where ``by_name``, by name. Rules of the canonical set win, then
    those of later sets.
    """
    by_id = aliases.where("NOT by_name").select(F.col("alias").alias("set_id"), F.col("canonical_id").alias("c1"), F.col("canonical_name").alias("n1"))
    by_name = aliases.where("by_name").select(F.col("alias").alias("set_name"), F.col("canonical_id").alias("c2"), F.col("canonical_name").alias("n2"))
    mapped = rule_sets.join(by_id, "set_id", "left").join(by_name, "set_name", "left").select(
        F.coalesce("c1", "c2", "set_id").alias("set_id"), F.coalesce("n1", "n2", "set_name").alias("set_name"),
        "set_ord", "rule_ord", "rule_id", "rule", (F.coalesce("c1", "c2", "set_id") == F.col("set_id")).alias("is_canonical"))
    return mapped.groupBy("set_id", "set_name", "rule_id").agg(
        F.max_by(F.struct("rule", "rule_ord"), F.struct("is_canonical", "set_ord", "rule_ord")).alias("w"),
        F.min("set_ord").alias("set_ord")).select("set_id", "set_name", "set_ord", "rule_id", "w.rule", "w.rule_ord")


def merge_converted(rules: DataFrame) -> DataFrame:
    """Same-id rules of one feed as flat member rows.

    In: ``(rule_id, rule_ord, kind, ix, value)`` with kind matcher, implies or
    excludes. Matchers are all kept in order; implies and excludes are distinct,
    at their first position. Flat rows keep a rule of any size splittable.
    """
    matchers = rules.where("kind = 'matcher'").select("rule_id", "kind", "value", F.struct("rule_ord", "ix").alias("place"))
    names = rules.where("kind <> 'matcher'").groupBy("rule_id", "kind", "value").agg(F.min(F.struct("rule_ord", "ix")).alias("place"))
    return matchers.unionByName(names)


def content_hash(rules: DataFrame, keys: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """Hash of all rules of a set, whatever order the rows come in.

    Two levels: rules are hashed, the hashes fall evenly into 4,096 buckets by
    their first digits, and the set's hash covers the bucket hashes. No task
    holds more than one bucket of a set.
    """
    hashed = rules.select(*keys, F.sha2("rule", 256).alias("h"))
    buckets = hashed.groupBy(*keys, F.substring("h", 1, 3).alias("bucket")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("b"), F.count(F.lit(1)).alias("n"))
    return buckets.groupBy(*keys).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "b"))), lambda x: x["b"]), ""), 256).alias("content_hash"),
        F.sum("n").alias("n_rules"))


def current_version(versions: DataFrame, back: int = 0) -> DataFrame:
    """Rules of the newest feed version, or of the one before (``back=1``).

    ``versions`` is ``(set_id, version, ...)``, partitioned by version on disk.
    """
    newest = versions.groupBy("set_id").agg(F.max("version").alias("version"))
    if back:
        older = versions.select("set_id", "version").join(newest.withColumnRenamed("version", "top"), "set_id").where("version < top")
        newest = older.groupBy("set_id").agg(F.max("version").alias("version"))
    return versions.join(newest, ["set_id", "version"], "left_semi")


def rollback(versions: DataFrame) -> DataFrame:
    """Previous version put on top again as a new one; the replaced version stays
    in the table, so another rollback brings it back."""
    top = versions.groupBy("set_id").agg((F.max("version") + 1).alias("next"))
    restored = current_version(versions, back=1).join(top, "set_id").withColumn("version", F.col("next")).drop("next")
    return versions.unionByName(restored)


def lookup(rules: DataFrame, names: DataFrame) -> DataFrame:
    """First rule whose id or name equals the given name, ignoring case."""
    keys = rules.select("rule_id", "name", "rule_ord", F.explode(F.array_distinct(F.array(F.lower("rule_id"), F.lower("name")))).alias("key"))
    asked = names.select("asked", F.lower(F.trim("asked")).alias("key")).where("key <> ''")
    return keys.join(asked, "key").groupBy("asked").agg(F.min(F.struct("rule_ord", "rule_id", "name")).alias("r")).select("asked", "r.rule_id", "r.name")
