"""Implied and excluded technologies.

What a name leads to depends on rules only. The edges of a pack are multiplied with
themselves, so that the n-th table leads along ways of 2**n edges; a name at any distance
is reached by as many of these jumps as its distance has ones in binary. A chain of
20,000 rules so takes fifteen joins, a common pack two or three.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigweave.functions.text import slug
from sigweave.session import stored
from sigweave.sources.pack import RulePack


def implied_edges(spark: SparkSession, pack: RulePack) -> DataFrame:
    """``(from_key, to_key, to_name, pred, rank)``: what each name implies at once, in order."""
    rows = [(key, name.lower(), name, ix) for key, rule in pack.by_key.items() for ix, name in enumerate(pack.source[rule.rule_ord].get("implies") or []) if name.lower() != key]
    kinds = [("from_key", pa.string()), ("to_key", pa.string()), ("to_name", pa.string()), ("rank", pa.int32())]
    table = spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds]))
    return table.groupBy("from_key", "to_key").agg(F.min_by(F.struct("to_name", F.lit(None).cast("string").alias("pred"), "rank"), "rank").alias("e")).select("from_key", "to_key", "e.*")


def implied_jumps(spark: SparkSession, pack: RulePack) -> list[DataFrame]:
    """``(from_key, nexts)`` for ways of 1, 2, 4, ... edges, stored, once per pack.

    Of several ways of one length between two names the first counts: ``rank`` orders what
    is reached from a name, ``pred`` is the name before the last. Pairs that a shorter jump
    connects are left out. The loop ends when no way is that long, or no shortest one can be.
    """
    at = (spark.sparkContext.applicationId, "jumps")
    if at in pack._tables:
        return pack._tables[at]
    made, edges = [], stored(implied_edges(spark, pack), "implies-0")
    known = edges.select("from_key", "to_key")
    while not edges.isEmpty():
        made.append(stored(edges.groupBy("from_key").agg(F.collect_list(F.struct("to_key", "to_name", "pred", "rank")).alias("nexts")).withColumnRenamed("from_key", "key"), "jumps"))
        if 1 << len(made) > 2 * len(pack.by_key):
            break
        first = edges.select("from_key", F.col("to_key").alias("mid"), F.col("to_name").alias("mid_name"), F.col("rank").alias("r1"))
        then = edges.select(F.col("from_key").alias("mid"), "to_key", "to_name", "pred", F.col("rank").alias("r2"))
        longer = first.join(then, "mid").where("from_key <> to_key").join(known, ["from_key", "to_key"], "left_anti")
        best = longer.groupBy("from_key", "to_key").agg(F.min(F.struct("r1", "r2", "to_name", F.coalesce("pred", "mid_name").alias("pred"))).alias("e")).select("from_key", "to_key", "e.*")
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("from_key").orderBy("r1", "r2"))).drop("r1", "r2")
        edges = stored(ranked, f"implies-{len(made)}")
        known = stored(known.unionByName(edges.select("from_key", "to_key")), "known")
    pack._tables[at] = made
    return made


def excluded_table(spark: SparkSession, pack: RulePack) -> DataFrame:
    pairs = sorted(
        (key, sorted({other.lower() for other in pack.source[rule.rule_ord].get("excludes") or []}))
        for key, rule in pack.by_key.items()
    )
    return spark.createDataFrame(pa.table(
        [pa.array([k for k, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.list_(pa.string()))],
        names=["from_key", "bans"]))


def has(pack: RulePack, field: str) -> bool:
    return any(r.get(field) for r in pack.source)


def add_implied(hits: DataFrame, pack: RulePack) -> DataFrame:
    """Rule hits plus what they imply; adds ``level`` and ``way`` for the order.

    An implied technology is reported once, from its first source: the nearest
    one, then the earliest in hit order. It takes over that source's confidence.

    Each jump table is joined once, to what the shorter jumps reached; it is broadcast only
    if the optimizer finds it small. The hits of one capture stay together throughout.
    """
    if not has(pack, "implies"):
        return hits.withColumns({"level": F.lit(0), "way": F.array("rule_ord")})
    jumps = implied_jumps(hits.sparkSession, pack)
    none = F.array(*[F.lit(0)] * len(jumps)) if jumps else F.array().cast("array<int>")
    own = F.struct("rule_ord", "rule_id", "name", "confidence", "evidence", "version", F.lit(0).alias("level"), F.concat(F.array("rule_ord"), none).alias("way"))
    start = F.struct(F.lit(0).alias("level"), F.array("rule_ord").alias("way"), F.col("name").alias("shown"), F.lit(None).cast("string").alias("pred"), F.col("name").alias("source"), "confidence")
    rows = hits.groupBy("capture_id", F.lower("name").alias("key")).agg(F.collect_list(own).alias("own"), F.min_by(start, F.col("rule_ord")).alias("s"))
    for n, table in enumerate(jumps):
        here = F.col("s")
        stay = F.struct("key", "own", here.withField("way", F.concat(here["way"], F.array(F.lit(0)))).alias("s"))
        # Between hit names nothing is spelt; the name before the last is then that of the hit.
        go = lambda e: F.struct(
            e["to_key"].alias("key"), F.lit(None).cast(rows.schema["own"].dataType).alias("own"), F.struct(  # noqa: B023
                (here["level"] + (1 << n)).alias("level"), F.concat(here["way"], F.array(e["rank"])).alias("way"), e["to_name"].alias("shown"),  # noqa: B023
                F.coalesce(e["pred"], F.when(here["level"] > 0, here["shown"])).alias("pred"), here["source"].alias("source"), here["confidence"].alias("confidence")).alias("s"))  # noqa: B023
        moved = F.concat(F.array(stay), F.coalesce(F.transform("nexts", go), F.slice(F.array(stay), 1, 0)))
        rows = rows.join(table, "key", "left").select("capture_id", F.inline(moved)).groupBy("capture_id", "key").agg(
            F.first("own", ignorenulls=True).alias("own"), F.min_by("s", F.struct("s.level", "s.way")).alias("s"))
    evidence = F.array(F.struct(
        F.lit(0).alias("matcher_ix"), F.lit(0).alias("pattern_ix"), F.lit("implies").alias("type"), F.lit("").alias("part"),
        F.concat(F.lit("derived from "), F.coalesce("s.pred", "s.source")).alias("detail"), F.lit("").alias("pattern"),
        F.lit("").alias("version")))
    implied = F.struct(
        F.lit(None).cast("int").alias("rule_ord"), slug(F.col("s.shown")).alias("rule_id"), F.col("s.shown").alias("name"), F.col("s.confidence").alias("confidence"),
        evidence.alias("evidence"), F.lit("").alias("version"), F.col("s.level").alias("level"), F.col("s.way").alias("way"))
    return rows.select("capture_id", F.inline(F.coalesce("own", F.array(implied))))


def drop_excluded(hits: DataFrame, pack: RulePack) -> DataFrame:
    """Remove hits some hit of the same capture excludes. Bans are simultaneous:
    a hit that is itself banned still bans. The hits of one capture, at most as
    many as the pack has names, are looked at together."""
    if not has(pack, "excludes"):
        return hits
    table = F.broadcast(excluded_table(hits.sparkSession, pack))
    columns = [c for c in hits.columns if c != "capture_id"]
    marked = hits.withColumn("from_key", F.lower("name")).join(table, "from_key", "left")
    per_capture = marked.groupBy("capture_id").agg(
        F.collect_list(F.struct(*columns)).alias("rows"),
        F.array_distinct(F.flatten(F.collect_list("bans"))).alias("bans"),
    )
    return per_capture.select("capture_id", F.inline(F.filter(
        "rows", lambda r: ~F.array_contains(F.col("bans"), F.lower(r["name"])))))
