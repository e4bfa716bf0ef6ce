"""Files written and read back."""

from pathlib import Path

from sigweave.operators import rulesets
from sigweave.sources import favicons, rules, sinks


def test_csv_keeps_every_text(spark, tmp_path):
    odd = ['a "b", c\r\nd', "", '"', "  lead and trail\t", "x\ny", "漢字 é", "\\", '\\"', ",,", "'", "null"]
    rows = spark.createDataFrame([tuple(odd[(i + k) % len(odd)] for k in range(len(sinks.BATCH_CSV))) for i in range(len(odd))], list(sinks.BATCH_CSV))
    sinks.write_csv(rows, str(tmp_path / "csv"))
    got = sinks.read_csv(spark, str(tmp_path / "csv"), sinks.BATCH_CSV)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("part-*"))
    assert raw.startswith(b"requested_url,final_url") and b"\r\n" in raw


def test_only_sets_that_change_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "sets")
    kind = "set_id string, rule_id string, rule string"
    rulesets.write_sets(spark.createDataFrame([(f"s{i % 3}", f"r{i}", "old") for i in range(9)], kind), path)
    names = lambda: {p.parent.name: p.name for p in Path(path).glob("set_id=*/part-*")}
    before = names()
    rulesets.write_sets(spark.createDataFrame([("s1", "r1", "new")], kind), path)
    after = names()
    assert [k for k in before if before[k] != after[k]] == ["set_id=s1"] and len(after) == 3
    got = {(r.set_id, r.rule_id, r.rule) for r in rulesets.read_sets(spark, path).collect()}
    assert got == {("s1", "r1", "new")} | {(f"s{i % 3}", f"r{i}", "old") for i in range(9) if i % 3 != 1}


def test_broken_rule_files_show_up(spark, tmp_path):
    good = "- id: a\n  matchers: [{type: word, words: [x]}]\n---\nid: b\nmatchers: [{type: word, words: nothing}]\n"
    for name, text in (("good.yaml", good), ("broken.yaml", "- {id: ["), ("empty.yaml", "\n")):
        (tmp_path / name).write_text(text)
    files = rules.read_files(spark, str(tmp_path))
    assert [r["rule"]["id"] for r in rules.native_rules(files).collect()] == ["a"]
    left = {(r.source.rsplit("/", 1)[1], r.doc_ix, r.error.split(":")[0]) for r in rules.quarantine(files).collect()}
    assert left == {("broken.yaml", -1, "unreadable"), ("good.yaml", 1, "wrong types")}


def test_broken_dictionaries_show_up(spark, tmp_path):
    for name, text in (("a.json", '{"1": "One", "x": "no", "-2": "Two"}'), ("b.json", '{"1": '), ("c.json", "[1]")):
        (tmp_path / name).write_text(text)
    read, bad = favicons.from_json_files(spark, str(tmp_path))
    assert sorted(map(tuple, read.collect())) == [(-2, "Two"), (1, "One")]
    assert sorted(r.source.rsplit("/", 1)[1] for r in bad.collect()) == ["b.json", "c.json"]
