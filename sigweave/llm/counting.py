"""Corpus counts of 64-bit keys: counted per task with NumPy, dealt out by key range of a
hash as packed arrays, and merged per bucket. Rows stay few while every occurrence counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigweave.llm.common import arrow_map, partitions, store

#: Keys a task holds unmerged, and distinct keys it holds before it passes them on.
PENDING, HELD = 2_000_000, 1_500_000

PACKED = "bucket int, keys binary, counts binary"


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


class Tally:
    """Counts of keys added in arrays, merged whenever many are waiting."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > PENDING:
            self._settle()

    def _settle(self) -> None:
        if self.parts:
            self.parts = [merge(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))]
            self.waiting = 0

    def size(self) -> int:
        return len(self.parts[0][0]) if self.parts else 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        out = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.waiting = [], 0
        return out


def packed(buckets: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(buckets, kind="stable")
    buckets, keys, counts = buckets[order], keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else []
    ends = [*starts[1:], len(buckets)]
    for s, e in zip(starts, ends, strict=True) if len(buckets) else ():
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(buckets[s])], pa.int32()), pa.array([keys[s:e].astype("<u8").tobytes()], pa.binary()), pa.array([counts[s:e].astype("<i8").tobytes()], pa.binary())],
            ["bucket", "keys", "counts"])


def count_keys(df: DataFrame, found: Callable[[pa.RecordBatch], Iterable[tuple[np.ndarray, np.ndarray]]], bucket_of: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """One stored row per bucket: its distinct keys in order and their counts over all of ``df``.

    ``found`` gives the keys and counts of a batch; ``bucket_of`` deals keys to buckets.
    A bucket's rows are merged as they stream in, so its memory is its distinct keys.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for keys, counts in found(batch):
                tally.add(keys, counts)
                if tally.size() > HELD:
                    keys, counts = tally.take()
                    yield from packed(bucket_of(keys), keys, counts)
        keys, counts = tally.take()
        yield from packed(bucket_of(keys), keys, counts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tally = None, Tally()
        for batch in batches:
            for bucket, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts")), strict=True):
                if bucket != now and now is not None:
                    k, c = tally.take()
                    yield from packed(np.full(len(k), now), k, c)
                now = bucket
                tally.add(np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8"))
        if now is not None:
            k, c = tally.take()
            yield from packed(np.full(len(k), now), k, c)

    parts = arrow_map(df, local, PACKED)
    n = partitions(df.sparkSession)
    return store(parts.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(merged, PACKED), name)
