"""Exact inner-product search over vectors bucketed by length.

Vectors are sorted by length and cut into blocks, so a block is a bucket of similar
lengths. A query's running k-th score, divided by both lengths, is the cosine a vector
of the bucket must reach. From that local threshold each (query, bucket) takes one of
three ways: the bucket is skipped, or its rows are cut by length, or, at thresholds
near 1, by the intervals that the query's largest coordinates allow. What is left is
multiplied exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigweave.llm.common import arrow_map, partitions, store

#: Rows of a bucket and of a query block.
BUCKET_ROWS, QUERY_ROWS = 4096, 1024
#: Local cosine threshold from which coordinates prune, and how many coordinates do.
COORDINATE_COSINE, FOCUS = 0.8, 4

BLOCKS = "dim int, low double, high double, ids binary, rows binary"


def _integers(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, lengths, rows = [], [], [], []
            for key, values in zip(batch.column("vec_id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                if key is None or values is None or any(v is None for v in values):
                    continue
                x = np.array(values, np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(scale * x)
                ids.append(key)
                dims.append(len(x))
                lengths.append(float(np.sqrt(x @ x)))
                rows.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(lengths, pa.float64()), pa.array(rows, pa.binary())], ["vec_id", "dim", "length", "row"])

    return run


def _packed(limit: int):
    """Consecutive rows of one dimension as blocks of at most ``limit`` rows."""

    def flush(dim, ids, lengths, rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([min(lengths)]), pa.array([max(lengths)]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(rows)], pa.binary())],
            ["dim", "low", "high", "ids", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        dim = None
        for batch in batches:
            for key, d, length, row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "dim", "length", "row")), strict=True):
                if held[0] and (d != dim or len(held[0]) == limit):
                    yield flush(dim, *held)
                    held = ([], [], [])
                dim = d
                for into, value in zip(held, (key, length, row), strict=True):
                    into.append(value)
        if held[0]:
            yield flush(dim, *held)

    return run


def _matrix(ids: bytes, rows: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, "<i8")
    return keys, np.frombuffer(rows, "<f8").reshape(len(keys), dim)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point while every sum stays below 2**53."""
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    return (q @ c.T).astype(np.int64) if bound < 2**53 else q.astype(np.int64) @ c.astype(np.int64).T


def best(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller key."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
        return near[np.lexsort((keys[near], -scores[near]))[:k]]
    return np.lexsort((keys, -scores))[:k]


def survivors(q: np.ndarray, q_length: float, c: np.ndarray, c_lengths: np.ndarray, floor: float) -> np.ndarray:
    """Places in a bucket that may reach the score ``floor`` with the query ``q``."""
    every = np.arange(len(c))
    if floor <= 0 or not np.isfinite(floor):
        return every
    top = q_length * c_lengths.max(initial=0.0)
    if top * (1 + 1e-9) < floor:
        return every[:0]
    cosine = floor / top
    kept = every[c_lengths * q_length * (1 + 1e-9) >= floor]
    if cosine < COORDINATE_COSINE:
        return kept
    unit = q / q_length
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        here = c[kept, f] / c_lengths[kept]
        # Each row's own threshold: its length is at most the bucket's.
        t = np.minimum(1.0, floor / (q_length * c_lengths[kept]))
        reach = np.sqrt(np.maximum(0.0, (1 - unit[f] ** 2) * (1 - t * t)))
        # A vector at cosine t or more has coordinate f in [u t - reach, u t + reach], widened to
        # the pole where u itself lies within the cap.
        low = np.where(-unit[f] >= t, -1.0, unit[f] * t - reach)
        high = np.where(unit[f] >= t, 1.0, unit[f] * t + reach)
        kept = kept[(here >= low - 1e-9) & (here <= high + 1e-9)]
    return kept


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_keys, q = _matrix(r["q_ids"], r["q_rows"], r["dim"])
                keys, c = _matrix(r["ids"], r["rows"], r["dim"])
                floors = np.frombuffer(r["floors"], "<f8") if r["floors"] else np.full(len(q), -np.inf)
                c_lengths, q_lengths = np.sqrt((c * c).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
                out: list[tuple] = []
                tops = q_lengths * c_lengths.max(initial=0.0)
                steep = (floors > 0) & (floors >= COORDINATE_COSINE * tops)
                flat = np.flatnonzero(~steep)
                # Below the coordinate threshold only lengths prune; one product serves all such queries.
                limit = len(c)
                if len(flat) and (floors[flat] > 0).all():
                    limit = int((c_lengths * (q_lengths[flat] / floors[flat]).max() * (1 + 1e-9) >= 1).sum())
                long = np.argsort(-c_lengths, kind="stable")[:limit]
                scores = _products(q[flat], c[long])
                for place, i in enumerate(flat):
                    own = np.flatnonzero((keys[long] != q_keys[i]) & (scores[place] >= floors[i]))
                    for j in own[best(scores[place][own], keys[long][own], k)]:
                        out.append((int(q_keys[i]), int(keys[long[j]]), int(scores[place][j])))
                for i in np.flatnonzero(steep):
                    near = survivors(q[i], q_lengths[i], c, c_lengths, floors[i])
                    near = near[keys[near] != q_keys[i]]
                    found = _products(q[i : i + 1], c[near])[0]
                    for j in best(found, keys[near], k):
                        out.append((int(q_keys[i]), int(keys[near[j]]), int(found[j])))
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    return run


FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, scale: float = 256.0, vec: str = "embedding") -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query row.

    ``vectors`` has ``vec_id`` and an array column ``vec``; components become
    ``floor(scale * x)``. ``queries`` is the SQL condition that picks query rows. A row
    is no candidate of a query with its own id. Returns ``query_id, rank, vec_id, score``,
    ties to the smaller id. Rows whose id or vector is null, or that hold a null or
    non-finite component, take no part; vectors of different dimension are not compared.
    Repeated rows of one id count as one if they are equal. Scores must fit a long.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    plain = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors[vec].cast("array<double>").alias("vec"))
    table = store(arrow_map(plain, _integers(scale), "vec_id long, dim int, length double, row binary").dropDuplicates(["vec_id", "row"]), "vectors")
    buckets = store(
        table.repartitionByRange(n, "dim", F.desc("length"), "vec_id").sortWithinPartitions("dim", F.desc("length"), "vec_id").mapInArrow(_packed(BUCKET_ROWS), BLOCKS)
        .withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    asked = table.where(F.expr(queries))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition(min(blocks, n), "_b").sortWithinPartitions("dim", "_b", "vec_id")
    asked = store(asked.drop("_b").mapInArrow(_packed(QUERY_ROWS), BLOCKS).select("dim", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.monotonically_increasing_id().alias("q_block")), "queries")

    # First thresholds: each query block against the bucket of the longest vectors of its dimension.
    longest = buckets.groupBy("dim").agg(F.max_by("bucket", F.struct("high", F.length("ids"))).alias("bucket"))
    first = buckets.join(longest, ["dim", "bucket"])
    seeds = asked.join(first, "dim").select("dim", "q_block", "q_ids", "q_rows", "ids", "rows")

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_keys, q = _matrix(r["q_ids"], r["q_rows"], r["dim"])
                keys, c = _matrix(r["ids"], r["rows"], r["dim"])
                # Repeats of one id are one candidate, so a floor is the k-th score of different ids.
                _, once = np.unique(keys, return_index=True)
                keys, c = keys[once], c[once]
                out = np.full(len(q), -np.inf)
                scores = _products(q, c)
                for i in range(len(q)):
                    own = scores[i][keys != q_keys[i]]
                    if len(own) >= k:
                        out[i] = np.partition(own, len(own) - k)[len(own) - k]
                yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]], pa.int64()), pa.array([out.astype("<f8").tobytes()], pa.binary())], ["q_block", "floors"])

    known = store(arrow_map(seeds, floors, "q_block long, floors binary"), "floors")
    asked = asked.join(known, "q_block", "left")
    # Query blocks meet buckets through a salt of the bucket, so that both sides spread.
    spread = buckets.withColumn("salt", F.pmod(F.xxhash64("bucket"), F.lit(n)))
    copies = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("salt", F.col("salt").cast("long"))
    pairs = copies.join(spread, ["dim", "salt"]).select("dim", "q_ids", "q_rows", "floors", "ids", "rows")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    found = pairs.mapInArrow(_search(k), FOUND).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
