"""Keyed tables, rule versions and tabs that come to rest, apart from the queries."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigweave.streaming import captures, quiet
from sigweave.streaming.runtime import read_stream
from sigweave.streaming.tables import KeyedTable, RuleVersions

START = datetime(2024, 1, 1)


def files(path):
    return {p.parent.name: p.name for p in Path(path).glob("bucket=*/part-*")}


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["k"], ["at"], buckets=16)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, at long, v string")
    table.merge(rows(*[(k, 1, "a") for k in range(200)]), "s-0")
    before = files(table.path)
    table.merge(rows((5, 2, "b"), (5, 3, "c"), (6, 0, "old")), "s-1")
    after = files(table.path)
    assert set(before) == set(after) and 1 <= sum(before[b] != after[b] for b in before) <= 2
    got = {r.k: r.v for r in table.read(spark).collect()}
    assert len(got) == 200 and got[5] == "c" and got[6] == "a"


def test_batches_may_be_repeated_and_streams_start_over(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["k"], ["at"], buckets=4)
    batches = [spark.createDataFrame([(k, n, f"{n}") for k in range(n, n + 6)], "k int, at int, v string") for n in range(4)]
    for state in ("one", "two"):
        write = table.writer(state)
        for n in (0, 1, 1, 2, 3, 3):
            write(batches[n], n)
    assert sorted((r.k, r.v) for r in table.read(spark).collect()) == [(0, "0"), (1, "1"), (2, "2"), *[(k, "3") for k in range(3, 9)]]


def test_a_batch_that_died_while_replacing_is_finished_from_the_staged_rows(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["k"], ["at"], buckets=1)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, at int")
    table.merge(rows((1, 1), (2, 1)), "s-0")
    table.merge(rows((3, 1)), "s-1")
    for part in Path(table.path).glob("bucket=0/part-*"):
        part.write_bytes(b"")  # what a job leaves that dies in between
    table.merge(rows((3, 1)), "s-1")
    assert sorted(r.k for r in table.read(spark).collect()) == [1, 2, 3]


def test_buckets_keep_the_newest_rows(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["k"], ["at"], buckets=3, keep=5)
    for n in range(3):
        table.merge(spark.createDataFrame([(f"{n}-{k}", n * 20 + k) for k in range(20)], "k string, at int"), f"s-{n}")
    held = [r.at for r in table.read(spark).collect()]
    assert len(held) <= 15 and sorted(held)[-5:] == [55, 56, 57, 58, 59]


def test_empty_batches_and_empty_tables(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["k"], ["at"])
    table.merge(spark.createDataFrame([], "k int, at int"), "s-0")
    with pytest.raises(ValueError):
        table.read(spark)


def test_the_newest_version_up_to_one_is_read(spark, tmp_path):
    rules = RuleVersions(str(tmp_path / "r"))
    for version, name in ((1, "a"), (3, "c"), (3, "c2")):
        rules.publish(spark.createDataFrame([(0, name)], "rule_ord int, rule string"), version)
    assert [rules.read(spark, v).first()["rule"] for v in (1, 2, 3, 9)] == ["a", "a", "c2", "c2"]


class State:
    """What ``applyInPandasWithState`` hands to a function, for one key."""

    def __init__(self):
        self.kept, self.timer, self.mark = None, None, 0

    exists = property(lambda self: self.kept is not None)
    get = property(lambda self: self.kept)

    def getCurrentWatermarkMs(self):
        return self.mark

    def update(self, value):
        self.kept = value

    def remove(self):
        self.kept = self.timer = None

    def setTimeoutTimestamp(self, ms):
        assert ms >= self.mark
        self.timer = ms


def drain(kind, idle, events, values, cuts, late_ms=0):
    """Rows a keyed function gives when its events come in these batches."""
    state, rows, newest = State(), [], 0
    run = quiet._timeline(kind, idle, values, [f"c{i}" for i in range(9)][: 3 if isinstance(kind, quiet.Route) else 6])
    for a, b in zip([0, *cuts], [*cuts, len(events)]):
        frame = pd.DataFrame(events[a:b], columns=["us", "value"])
        rows += [tuple(r) for f in run((7,), iter([frame]), state) for r in f.itertuples(index=False)]
        newest = max([newest, *frame["us"].tolist()])
        state.mark = max(state.mark, newest // 1_000 - late_ms)
    for state.mark in (state.mark + 1, 10**9, 2 * 10**9, 3 * 10**9):
        while state.timer is not None and state.timer < state.mark:
            state.timer = None
            rows += [tuple(r) for f in run((7,), iter([]), state) for r in f.itertuples(index=False)]
    assert state.kept is None
    return rows


def test_routes_do_not_depend_on_batches(spark):
    rng = random.Random(4)
    at = 1_000_000
    events = []
    for _ in range(120):
        at += rng.choice([1_000, 40_000, 300_000, 700_000, 90_000_000])
        events.append((at, rng.choice("abc")))
    last, since, seen, want = None, None, None, []
    for ts, url in [*events, (10**15, None)]:
        if since is not None and ts >= since + 600_000:
            want.append((7, since, last))
            since = None
        if seen is not None and ts - seen > 60_000_000:
            last, since = None, None
        seen = ts
        if url != last:
            last, since = url, ts
    values = lambda f: f["value"].tolist()
    want = [w for w in want if w[2] is not None]
    for cuts in ([], [60], sorted(rng.sample(range(1, 120), 20)), list(range(1, 120))):
        assert drain(quiet.Route(600_000), 60_000_000, events, values, cuts) == want
    shuffled = events[:]
    for i in range(0, 118, 2):
        if shuffled[i + 1][0] - shuffled[i][0] < 500_000:
            shuffled[i], shuffled[i + 1] = shuffled[i + 1], shuffled[i]
    assert drain(quiet.Route(600_000), 60_000_000, shuffled, values, list(range(1, 120)), late_ms=600) == want


def test_icons_wait_start_over_and_are_told_once():
    page, icon = (lambda c, *h: (c, list(h))), (lambda *h: (None, list(h)))
    ms = 1_000
    events = [
        (1 * ms, icon(9)), (2 * ms, page(1, 5)), (3 * ms, icon(5)), (4 * ms, icon(6, 0)), (500 * ms, icon(7)), (900 * ms, icon(6)),
        (1_400 * ms, icon(8)), (1_500 * ms, page(2)), (1_600 * ms, icon(8, 6)), (5_000 * ms, icon(6)), (5_001 * ms, icon(9))]
    values = lambda f: f["value"].tolist()
    want = [(7, 1, 4 * ms, 1_300 * ms, [6, 7], [5, 6, 7]), (7, 2, 1_600 * ms, 2_400 * ms, [6, 8], [6, 8]), (7, 2, 5_001 * ms, 5_801 * ms, [9], [6, 8, 9])]
    for cuts in ([], [3], list(range(1, 11))):
        assert drain(quiet.Icons(800 * ms), 10**12, events, values, cuts) == want


def test_late_events_are_put_in_order(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    path = str(tmp_path / "in")
    for rows in ([(1, at(0), "a"), (1, at(8), "c")], [(1, at(4), "b"), (2, at(9), "x")], [(2, at(100), "y")], [(2, at(1_000), "z")]):
        spark.createDataFrame(rows, "tab_id long, ts timestamp, url string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("tab_id long, ts timestamp, url string").option("maxFilesPerTrigger", 1).parquet(path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    quiet.settled_routes(stream, gap="3 seconds").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.parquet(out).select("tab_id", F.timestamp_micros("at_us").alias("at"), "url").orderBy("at").collect()
    assert [tuple(r) for r in got] == [(1, at(0), "a"), (1, at(4), "b"), (1, at(8), "c"), (2, at(9), "x"), (2, at(100), "y")]


def test_changes_that_never_rest_leave_nothing_to_read(spark, tmp_path):
    """Changes a second apart with a quiet time of five minutes: no match, and no error."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(START + timedelta(seconds=n), "rules", 1) for n in range(900)], "ts timestamp, scope string, version int")
    rows.coalesce(1).write.parquet(path)
    settled = captures.settled_changes(read_stream(spark, path, rows.schema), gap="5 minutes")
    captures.rescan_stream(settled, None, RuleVersions(str(tmp_path / "rules")), out, str(tmp_path / "state"))
    assert captures.read_rescans(spark, out).collect() == []
