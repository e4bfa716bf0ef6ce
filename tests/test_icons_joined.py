"""Icon dictionaries of any size: large ones are joined by hash, not sent through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from sigweave.operators import favicons
from sigweave.sources import favicons as tables


def expected(rows, known, custom=None):
    out = []
    for capture, hashes in rows:
        for ix, h in enumerate(dict.fromkeys(h for h in hashes or [] if h)):
            own = [n for k, n in custom or [] if k == h] or [None]
            built_in = [n for k, n in known if k == h] or [None]
            out += [(capture, ix, h, n) for n in ((o or b) for o in own for b in built_in) if n]
    return sorted(out)


def test_large_dictionaries_are_not_broadcast(spark):
    ids = spark.range(150_000)
    known = ids.select(F.col("id").cast("int").alias("hash"), F.concat(F.lit("n"), "id").alias("name"))
    custom = ids.select((F.col("id") * 3).cast("int").alias("hash"), F.lit("own").alias("name"))
    captures = spark.range(20_000).select(F.col("id").alias("capture_id"), F.array(F.lit(42), (F.col("id") * 2 + 1).cast("int")).alias("favicon_hashes"))
    out = favicons.icon_names(captures, known, custom)
    assert out.groupBy("name").count().where("count > 1").collect() == [("own", 20_000 + 6_667)]
    assert out.count() == 40_000
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_sizes_are_counted_once(spark):
    ids = spark.range(150_000).withColumn("hash", F.col("id").cast("int"))
    seen = spark.sparkContext.accumulator(0)
    few = ids.where("id < 1000").withColumn("name", F.lit("a"))
    many, long = ids.withColumn("name", F.lit(None).cast("string")), ids.where("id < 1000").withColumn("name", F.repeat(F.lit("é"), F.lit(3_000)))
    assert [tables.is_small(t) for t in (few, many, long)] == [True, False, False]

    def counted(batches):
        for batch in batches:
            seen.add(1)
            yield batch

    watched = few.coalesce(1).select("hash", "name").mapInArrow(counted, "hash int, name string")
    assert [tables.is_small(watched) for _ in range(3)] == [True] * 3 and seen.value == 1


@pytest.mark.parametrize("bound", [100_000, 12, 0])
def test_names_of_odd_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(tables, "SMALL_ROWS", bound)  # both small, one of them, none
    rng = random.Random(7)
    rows = [(n, [42, *[rng.randrange(-6, 40) for _ in range(rng.randrange(4))], 42, None, 0]) for n in range(400)]
    rows += [(7, [5, 5, 0, None, -6]), (900, None), (901, []), (902, [0, None])]  # 7 is there twice
    known = [(h, f"n{h}") for h in range(-6, 20, 2)] + [(4, "again"), (6, ""), (8, None), (0, "zero"), (None, "none"), (42, "common")]
    custom = [(h, f"own{h}") for h in range(0, 30, 5)] + [(10, "twice"), (12, ""), (14, None)]
    captures = spark.createDataFrame(rows, "capture_id long, favicon_hashes array<int>")
    for given in ((known,), (known, custom), (known, []), ([], custom), ([], [])):
        got = favicons.icon_names(captures, *[spark.createDataFrame(t, "hash int, name string") for t in given])
        assert sorted(tuple(r) for r in got.select("capture_id", "hash_ix", "hash", "name").collect()) == expected(rows, *given)
