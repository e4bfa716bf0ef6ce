"""Structure of regular expressions: can a match be ruled out by a literal?"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from sigweave.functions.patterns import compile_pattern, letters_and_digits

# Rows of the ranked lists.
ANCHOR_ROWS, ISSUE_ROWS = 20, 50


def classify(pattern: Column) -> Column:
    """``struct<kind, anchor, strength, reason>``; kind is prefilterable,
    non_ascii, broad or invalid."""

    @pandas_udf("kind string, anchor string, strength int, reason string")
    def look(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            p = compile_pattern(text, False)
            kind = "invalid" if not p.valid else "prefilterable" if p.anchor else "non_ascii" if p.non_ascii else "broad"
            anchor = p.anchor or ""
            rows.append((kind, anchor, letters_and_digits(anchor), p.reason))
        return pd.DataFrame(rows, columns=["kind", "anchor", "strength", "reason"])

    return look(pattern)


def classified(patterns: DataFrame) -> DataFrame:
    """Add the class to ``(set_id, ord, rule_id, name, pattern)`` rows."""
    rows = patterns.withColumn("c", classify(F.col("pattern")))
    return rows.select(*patterns.columns, "c.*")


def summary(rows: DataFrame) -> DataFrame:
    """Counts per set and one grade: none, invalid, broad or fine."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    out = rows.groupBy("set_id").agg(
        F.count("pattern").alias("total"), count("prefilterable").alias("prefilterable"), count("non_ascii").alias("non_ascii"),
        count("broad").alias("broad"), count("invalid").alias("invalid"))
    grade = F.when(F.col("total") == 0, "none").when(F.col("invalid") > 0, "invalid").when(F.col("broad") > 0, "broad").otherwise("fine")
    return out.withColumn("grade", grade)


def _ranked(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """First ``limit`` rows per key. A salted first round keeps ``limit`` rows per
    salt, so a set with very many patterns is cut down before it meets in a task."""
    from pyspark.sql import Window

    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(64)))
    first = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_rn") <= limit)
    return first.drop("_rn", "_salt").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= limit)


def anchor_ranking(rows: DataFrame, limit: int = ANCHOR_ROWS) -> DataFrame:
    """The shortest and the longest anchors per set, ties by pattern."""
    held = rows.where("kind = 'prefilterable'").select("set_id", "rule_id", "pattern", "anchor", "strength", "ord")
    short = _ranked(held, ["set_id"], [F.col("strength"), F.col("pattern"), F.col("ord")], limit).withColumn("list", F.lit("short"))
    long = _ranked(held, ["set_id"], [F.col("strength").desc(), F.col("pattern"), F.col("ord")], limit).withColumn("list", F.lit("long"))
    return short.unionByName(long)


def issue_ranking(rows: DataFrame, limit: int = ISSUE_ROWS) -> DataFrame:
    """The first distinct broad and invalid patterns per set."""
    issues = rows.where("kind IN ('broad', 'invalid')").groupBy("set_id", "kind", "pattern").agg(
        F.min("ord").alias("ord"), F.min_by("rule_id", "ord").alias("rule_id"))
    return _ranked(issues, ["set_id", "kind"], [F.col("ord")], limit)
