"""Whole rows are placed, in exact shards, whatever their values and partitions."""

import zlib

import pytest

from sigweave.llm import queries, sharding

TEXTS = [None, "", "one", "one", "Größe 漢字 🙂", "long " * 50_000]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("shards")
    rows = [(None if i % 7 == 0 else i // 3, TEXTS[i % len(TEXTS)]) for i in range(205)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_query_holds_every_row_in_exact_shards(spark, folder):
    path, rows = folder
    got = queries.op9_exact_sharding(spark, path).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=key) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, slots.values())) == [5] * 35 + [6] * 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize(("partitions", "stretch", "cell"), [(1, 2048, 20_000), (12, 5, 20), (40, 7, 3)])
def test_rows_travel_whole_and_partitions_mix(spark, monkeypatch, partitions, stretch, cell):
    monkeypatch.setattr(sharding, "STRETCH", stretch)
    monkeypatch.setattr(sharding, "CELL_ROWS", cell)
    rows = spark.range(0, 1003, 1, partitions).selectExpr("id", "concat('t', id) AS text", "'x' AS shard", "1 AS _row")
    got = sharding.shard(rows, shards=4).collect()
    assert sorted((r.id, r.text) for r in got) == sorted((i, f"t{i}") for i in range(1003))
    by_shard = [sorted((r.slot, r.id) for r in got if r.shard == s) for s in range(4)]
    assert sorted(map(len, by_shard)) == [250, 251, 251, 251]
    for placed in by_shard:
        assert [slot for slot, _ in placed] == list(range(len(placed)))
        # A uniform shuffle: no quarter of a shard holds far more of the first half of the input than its share.
        for q in range(4):
            low = sum(i < 502 for _, i in placed[q * 62 : q * 62 + 62])
            assert 12 <= low <= 50


def test_fewer_rows_than_shards_and_none(spark):
    rows = spark.range(3).selectExpr("id AS doc_id", "cast(null AS string) AS text")
    assert sorted(r.slot for r in sharding.shard(rows, shards=40).collect()) == [0, 0, 0]
    assert sharding.shard(rows.limit(0), shards=40).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(rows, shards=0)
