"""Tables that streams keep up to date: one row per key, files by bucket of the key.

A micro-batch reads and rewrites only the buckets its keys fall into, so what it costs
follows the batch and not the table. Dynamic partition overwrite replaces the files of
those buckets and drops the old ones.

Merging keeps the row of the highest order per key. It gives the same table however
often and in whatever order batches are merged, so a batch may be repeated, also by a
stream that starts over with a new state folder. Merged rows are staged before they
replace anything: a job that dies while replacing is finished from the staged rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The table at ``path``; None where nothing was written yet."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return found if schema is None else spark.read.schema(schema).parquet(path)


class KeyedTable:
    """One row per ``keys``: the one of the highest ``order``.

    ``keep`` bounds the rows of a bucket to the newest by ``order``; a reader that wants the
    newest ``keep`` rows of the whole table finds them all, and the table stops growing.
    """

    def __init__(self, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS, keep: int | None = None) -> None:
        self.path, self.keys, self.order, self.buckets, self.keep = path.rstrip("/"), keys, order, buckets, keep

    def read(self, spark: SparkSession) -> DataFrame:
        found = read_table(spark, self.path)
        if found is None:
            raise ValueError(f"nothing was written to {self.path} yet")
        return found.drop("bucket")

    def _merged(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in (*self.keys, "bucket")]
        newest = rows.groupBy("bucket", *self.keys).agg(F.max_by(F.struct(*columns), F.struct(*self.order)).alias("_r"))
        merged = newest.select("bucket", *self.keys, "_r.*")
        if self.keep is None:
            return merged
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(*[F.desc(c) for c in self.order], *self.keys))
        return merged.withColumn("_place", place).where(F.col("_place") <= self.keep).drop("_place")

    def merge(self, batch: DataFrame, mark: str) -> None:
        """Merge the rows of a micro-batch. ``mark`` names the batch; the one that was
        staged last is not merged again but put in place again."""
        spark = batch.sparkSession
        staged, done = f"{self.path}.staged", f"{self.path}.mark"
        last = read_table(spark, done)
        if last is None or last.first()["mark"] != mark:
            new = batch.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).persist()
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                return
            rows = new
            current = read_table(spark, self.path)
            if current is not None:
                rows = rows.unionByName(current.where(F.col("bucket").isin(touched)))
            self._merged(rows).write.mode("overwrite").parquet(staged)
            new.unpersist()
            spark.range(1).select(F.lit(mark).alias("mark")).write.mode("overwrite").parquet(done)
        ready = spark.read.parquet(staged)
        ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def writer(self, state: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch`` of a stream whose state lies in ``state``."""
        stream = hashlib.sha256(state.encode()).hexdigest()[:16]
        return lambda batch, number: self.merge(batch, f"{stream}-{number}")


class RuleVersions:
    """Rule documents by version. A stream asks for a version in each micro-batch, so a
    version that is published while it runs counts from the next one on."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def publish(self, rules: DataFrame, version: int) -> None:
        """Write ``(rule_ord, rule)`` as a version; a version that is there is replaced."""
        rules.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(self.path)

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        """Rules of the newest version up to this one."""
        known = spark.read.parquet(self.path)
        held = known.select("version").where(F.col("version") <= version).agg(F.max("version").alias("v")).first()["v"]
        return known.where(F.col("version") == F.lit(held)).drop("version")
