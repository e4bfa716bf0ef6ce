"""Uniform shuffle into shards of exact sizes.

Each partition of the input is permuted where it lies. The counts of rows that each
sends to each shard are a matrix with fixed margins (multivariate hypergeometric,
partition by partition): a permuted partition is cut by its row of the matrix and sent,
and each shard is permuted again. Whole rows are exchanged once. All row work is
DataFrame operations; only the matrix is drawn on the driver, a stretch of partitions
at a time.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigweave.llm.common import shared_folder, store

#: Partitions whose rows of the matrix are held at once, and the rows a cell of a shard should have.
STRETCH, CELL_ROWS = 2048, 20_000
#: A generated row number holds the partition above this many bits, the place in it below.
PLACE_BITS = 33


def draw_rows(sizes: list[int], shards: int, seed: int) -> Iterator[list[int]]:
    """Rows sent from each partition to each shard: rows of the matrix sum to ``sizes``,
    columns differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    left = np.full(shards, total // shards, np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    for size in sizes:
        drawn = _draw(rng, left, size)
        left -= drawn
        yield [int(x) for x in drawn]


def draw_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """The whole matrix at once."""
    return list(draw_rows(sizes, shards, seed))


def _draw(rng: np.random.Generator, left: np.ndarray, size: int) -> np.ndarray:
    """How many of ``size`` rows, drawn without replacement, fall to each shard."""
    out = np.zeros_like(left)
    rest = int(left.sum())
    for i, good in enumerate(map(int, left)):
        rest -= good
        out[i] = hypergeometric(rng, good, rest, size)
        size -= int(out[i])
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, size: int) -> int:
    """Good items among ``size`` drawn from ``good + bad``, by inversion around the mode.

    The library's own sampler stops at a billion items; neighbouring probabilities have
    an exact ratio at any size, and 40 deviations around the mode hold all the mass a
    double can tell from zero.
    """
    least, most = max(0, size - bad), min(good, size)
    if least >= most:
        return most
    total = good + bad
    share = good / total
    mode = min(most, max(least, (size + 1) * (good + 1) // (total + 2)))
    reach = 50 + int(40 * math.sqrt(size * share * (1 - share) * max(1, total - size) / total))
    x = np.arange(max(least, mode - reach), min(most, mode + reach), dtype=np.float64)
    steps = np.log(good - x) + np.log(size - x) - np.log(x + 1) - np.log(bad - size + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return int(x[0]) + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def _bounds(spark: SparkSession, sizes: dict[int, int], shards: int, seed: int) -> DataFrame:
    """(_part, _ends): for each partition the places in it where shards end."""
    path = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}"
    numbers = sorted(sizes)
    matrix = draw_rows([sizes[n] for n in numbers], shards, seed)
    for i in range(0, max(1, len(numbers)), STRETCH):
        stretch = [{"_part": n, "_ends": np.cumsum(next(matrix)).tolist()} for n in numbers[i : i + STRETCH]]
        rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(stretch)), "array<struct<_part: long, _ends: array<long>>>")))
        rows.write.mode("append").parquet(path)
    return spark.read.schema("_part long, _ends array<long>").parquet(path)


def shard(rows: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    """The columns of ``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in
    its shard). Shard sizes differ by one at most, and the order is a seeded uniform
    shuffle. Equal rows, null ids, null and very long texts are rows like any other: the
    shuffle follows the row's place in the input, not its values, so no value is hot.
    Columns of ``rows`` named ``shard`` or ``slot`` are replaced, those named ``_row`` or
    ``_at`` left out; other names of one leading underscore are best avoided, as
    ``_part, _place, _ends, _key, _cell, _in, _start`` are used inside. An empty table gives
    no rows; with fewer rows than shards some shards stay empty.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot", "_row", "_at")]
    numbered = rows.select(*kept, F.monotonically_increasing_id().alias("_row"))
    permuted = numbered.sortWithinPartitions(F.xxhash64(F.lit(seed), "_row"), "_row")
    permuted = store(permuted.withColumn("_at", F.monotonically_increasing_id()), "permuted")
    part = F.shiftright("_at", PLACE_BITS).alias("_part")
    # One number per partition of the input, as the scheduler itself keeps.
    sizes = {r["_part"]: r["count"] for r in permuted.groupBy(part).count().collect()}
    bounds = _bounds(rows.sparkSession, sizes, shards, seed)
    cells = max(1, sum(sizes.values()) // shards // CELL_ROWS)

    def sent(*columns: str) -> DataFrame:
        """Rows with their shard; cells are equal ranges of the hash, so that all of a shard
        is shuffled cell by cell."""
        place = F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
        return (
            permuted.select(*columns, "_row", part, place.alias("_place"), F.xxhash64(F.lit(seed + 2), "_row").alias("_key"))
            .join(bounds, "_part")
            .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_place"))).cast("int"))
            .withColumn("_cell", F.shiftright(F.shiftrightunsigned("_key", 32) * F.lit(cells), 32))
            .drop("_part", "_place", "_ends")
        )

    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent().groupBy("shard", "_cell").count().select("shard", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_cell").orderBy("_key", "_row")
    placed = sent(*kept).withColumn("_in", F.row_number().over(within)).join(starts, ["shard", "_cell"])
    return placed.select(*kept, "shard", (F.col("_start") + F.col("_in") - 1).cast("long").alias("slot"))
