"""Implied names against a walk in breadth, and packs of unusual shape."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from sigweave.functions import hashing
from sigweave.operators import closure, favicons, probes, reports
from sigweave.sources import favicons as dictionaries
from sigweave.sources.pack import RulePack, probe_key
from sigweave.sources.rules import typed_rules

HITS = "capture_id long, rule_ord int, rule_id string, name string, confidence int, evidence array<struct<matcher_ix:int,pattern_ix:int,type:string,part:string,detail:string,pattern:string,version:string>>, version string"


def pack_of(edges):
    return RulePack([{"id": f"id{k}", "name": k, "implies": to, "matchers": [{"type": "word", "words": ["x"]}]} for k, to in edges.items()])


def hits_of(spark, pack, found):
    by_name = {r.name: r for r in pack.rules}
    return spark.createDataFrame([(c, by_name[n].rule_ord, by_name[n].rule_id, n, 50 + by_name[n].rule_ord % 9, [], "") for c, n in found], HITS)


def walked(pack, names):
    """(name, level, source, confidence) in order: what a queue finds from all hits at once."""
    start = sorted((pack.by_key[n.lower()].rule_ord, n) for n in names)
    seen, queue, out = {n.lower() for _, n in start}, deque((n, 0, n, 50 + o % 9) for o, n in start), []
    while queue:
        name, level, _, conf = queue.popleft()
        rule = pack.by_key.get(name.lower())
        for to in (pack.source[rule.rule_ord].get("implies") or []) if rule else []:
            if to.lower() not in seen:
                seen.add(to.lower())
                queue.append((to, level + 1, name, conf))
                out.append((to, level + 1, name, conf))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    names = [f"N{i}" for i in range(40)]
    spelt = lambda n: rng.choice([n, n.lower(), f"id{n}"]) if rng.random() < 0.3 else n
    ring = {f"R{i}": [f"R{(i + 1) % 11}"] for i in range(11)}
    edges = ring | {n: [spelt(x) for x in rng.choices([*names, "leaf one", "R3", n], k=rng.choice([0, 0, 1, 1, 2, 4]))] for n in names}
    pack = pack_of(edges)
    found = {c: rng.sample([*names, "R0", "R7"], rng.randint(1, 4)) for c in range(12)}
    got = closure.add_implied(hits_of(spark, pack, [(c, n) for c, ns in found.items() for n in ns]), pack).collect()
    for c, ns in found.items():
        mine = sorted((r for r in got if r.capture_id == c), key=lambda r: (r.level, list(r.way)))
        assert sorted(r.name for r in mine if r.level == 0) == sorted(ns)
        told = [(r.name, r.level, r.evidence[0].detail.removeprefix("derived from "), r.confidence) for r in mine if r.level]
        assert told == walked(pack, ns)


def test_a_long_chain_and_a_dense_family(spark):
    n = 20_000
    pack = pack_of({f"C{i}": [f"C{i + 1}"] for i in range(n)})
    got = closure.add_implied(hits_of(spark, pack, [(1, "C0"), (2, f"C{n - 3}")]), pack)
    told = got.where("level > 0").groupBy("capture_id").agg(F.count("*").alias("n"), F.max("level").alias("far"), F.max_by(F.col("evidence")[0]["detail"], "level").alias("from")).collect()
    assert sorted(map(tuple, told)) == [(1, n, n, f"derived from C{n - 1}"), (2, 3, 3, f"derived from C{n - 1}")]
    family = [f"F{i}" for i in range(120)]
    dense = pack_of({f: [g for g in family if g != f] for f in family})
    rows = closure.add_implied(hits_of(spark, dense, [(1, "F5")]), dense).where("level > 0").collect()
    assert len(rows) == 119 and {r.level for r in rows} == {1}


def test_targets_with_one_hot_address_and_mostly_invalid(spark):
    rows = spark.range(4_000).select(F.col("id").alias("ord"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("ftp://"), F.col("id").cast("string"))).when(
        F.col("id") % 20 == 0, "https://hot.example.com/#a").otherwise(F.concat(F.lit("https://c.example.com/"), F.col("id").cast("string"))).alias("url"))
    got = reports.classify_targets(rows)
    assert {r["verdict"]: r["count"] for r in got.groupBy("verdict").count().collect()} == {"invalid": 3_600, "kept": 201, "duplicate": 199}
    assert got.where("verdict = 'kept' AND target LIKE '%hot%'").first()["ord"] == 0
    assert got.columns == ["ord", "url", "target", "verdict"]


def _murmur(data):
    rotate = lambda v, r: (v << r | v >> (32 - r)) & 0xFFFFFFFF
    h = 0
    for at in range(0, len(data), 4):
        k = int.from_bytes(data[at:at + 4], "little")
        h ^= rotate(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        if at + 4 <= len(data):
            h = (rotate(h, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >= 1 << 31 else h


def test_murmur3_of_any_length(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("aZ9+/é漢🙂\n", k=n)) for n in [*range(0, 30), 1_000, 9_001]]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r.t: r.h for r in rows.select("t", hashing.murmur3_32(F.col("t")).alias("h")).collect()}
    assert got == {t: _murmur(t.encode()) for t in texts} | {None: None}


def test_icon_files(spark, tmp_path):
    for capture, content in ((3, bytes(range(256))), (70, b"\0")):
        (tmp_path / f"capture_id={capture}").mkdir()
        (tmp_path / f"capture_id={capture}" / "favicon.ico").write_bytes(content)
    (tmp_path / "stray.ico").write_bytes(b"no capture")
    assert {r.capture_id: bytes(r.content) for r in favicons.icon_files(spark, str(tmp_path)).collect()} == {3: bytes(range(256)), 70: b"\0"}


def test_icon_lines(spark, tmp_path):
    """Icons from lines, without a file each, hash as the same bytes from a table do."""
    contents = {n: bytes(range(256)) * (n % 5) + bytes([n % 256]) for n in range(400)}
    icons = spark.createDataFrame([*contents.items(), (900, b""), (901, None)], "capture_id long, content binary")
    folder = tmp_path / "lines"
    favicons.write_icon_lines(icons.repartition(4), str(folder))
    assert len(list(folder.glob("part-*"))) <= 4
    (folder / "odd.txt").write_text("x YQ==\n5\n\n6 %%\n")
    read = favicons.icon_lines(spark, str(folder))
    assert {r.capture_id: bytes(r.content) for r in read.collect()} == contents
    hashes = lambda rows: {r.capture_id: r.favicon_hashes for r in favicons.hash_icons(rows).collect()}
    assert hashes(read) == hashes(icons.where("capture_id < 900"))


def test_probes_with_equal_ids_are_all_planned(spark):
    """These two selectors share an id of 32 bits; attributes left out and empty ones are the same probe."""
    dom = [{"sel": "img", "attrs": {"src": "x", "alt": "y73745"}}, {"sel": "b"}, {"sel": "b", "attrs": {}}]
    rule = {"id": "r", "matchers": [{"type": "dom", "words": ["#a106755", "b", "b"], "dom": dom}]}
    assert probe_key("#a106755") == probe_key("img", "", dom[0]["attrs"])
    _, planned = probes.plan(typed_rules(spark.createDataFrame([(json.dumps(rule),)], "doc string")))
    assert sorted((r.sel, len(r.attrs or {})) for r in planned.collect()) == [("#a106755", 0), ("b", 0), ("img", 2)]


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for n in range(120):
        (tmp_path / f"source={n}").mkdir()
        (tmp_path / f"source={n}" / "names.json").write_text(json.dumps({str(n): f"name {n}"}))
    spark.sparkContext.setJobGroup("listing", "folders of dictionaries")
    read, bad = dictionaries.from_json_files(spark, f"{tmp_path}/*")
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(n) for n in tracker.getJobIdsForGroup("listing")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(n) for job in jobs for n in job.stageIds]
    assert stages and max(s.numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism < 120
    assert {(r.hash, r.name) for r in read.collect()} == {(n, f"name {n}") for n in range(120)} and bad.isEmpty()
