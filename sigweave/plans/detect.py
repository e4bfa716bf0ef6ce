"""Detection end to end: captures and a pack in, hits out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.operators import closure, favicons, folding, matching
from sigweave.sources.pack import RulePack


def rule_hits(captures: DataFrame, pack: RulePack) -> DataFrame:
    found = matching.pattern_hits(captures, pack, marked=bool(pack.negative_ids))
    return folding.rule_hits(folding.matcher_hits(found, pack), pack)


def detect(captures: DataFrame, pack: RulePack, dictionary: DataFrame | None = None,
           custom: DataFrame | None = None) -> DataFrame:
    """Rules, then implied names, then exclusions, then the icon dictionary.

    ``level`` and ``way`` give the order of hits within a capture: rule hits in
    rule order, implied ones breadth first, dictionary hits last.
    """
    hits = rule_hits(captures, pack)
    hits = closure.drop_excluded(closure.add_implied(hits, pack), pack)
    return hits if dictionary is None else favicons.add_icons(hits, captures, dictionary, custom)


ORDER = ("level", "way", "rule_id")


def with_position(hits: DataFrame) -> DataFrame:
    """Position of each hit within its capture, counting from 1."""
    from pyspark.sql import Window

    return hits.withColumn("hit_ord", F.row_number().over(Window.partitionBy("capture_id").orderBy(*ORDER)))
