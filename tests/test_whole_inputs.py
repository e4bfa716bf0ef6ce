"""Nothing is lost past former limits."""

import json

import pytest
from pyspark.sql import functions as F

from sigweave.functions import patterns, urls
from sigweave.operators import crawl, reports, rulesets
from sigweave.plans import detect
from sigweave.sources import loose, pack
from sigweave.sources.captures import complete


def test_a_hit_at_the_end_of_a_long_body(spark):
    pages = spark.createDataFrame([(1, "https://a.example.com/", "x " * 150_000 + "lastword")], "capture_id long, url string, body string")
    rules = pack.RulePack.from_documents([{"id": "r", "name": "R", "matchers": [{"type": "word", "words": ["lastword"]}]}])
    assert [r["rule_id"] for r in detect.detect(complete(pages), rules).collect()] == ["r"]
    assert complete(pages, bounded=True).select(F.length("body")).first()[0] == 200_000


def test_pack_table_counts_usable_rules(spark, monkeypatch):
    monkeypatch.setattr(pack, "MAX_RULES", 3)
    schema = "rule_ord int, rule struct<id: string, name: string, matchers: array<struct<type: string, words: array<string>>>>"
    good = [(i, (f"r{i}", "N", [("word", ["a"])])) for i in range(5)]
    bad = [(-i, ("", "N", [])) for i in range(1, 9)]
    assert len(pack.RulePack.from_table(spark.createDataFrame(bad + good[:3], schema)).rules) == 3
    with pytest.raises(pack.PackTooLarge):
        pack.RulePack.from_table(spark.createDataFrame(bad + good, schema))


def test_lists_of_any_depth(spark):
    deep = [{"id": "a"}, [[[{"id": "b"}, [{"id": "c"}]]], None], []]
    docs = spark.createDataFrame([(1, json.dumps(deep)), (2, '{"id": "d"}'), (3, "[]")], "k int, j string").select("k", F.parse_json("j").alias("doc"))
    got = loose.flatten_lists(docs).select("k", F.expr("variant_get(doc, '$.id', 'string')").alias("id")).collect()
    assert sorted((r["k"], r["id"]) for r in got) == [(1, "a"), (1, "b"), (1, "c"), (2, "d")]


def test_crawl_goes_to_the_end_of_a_chain(spark):
    n = 20
    links = spark.createDataFrame([(f"https://a.example.com/{i}", f"https://a.example.com/{i + 1}", 0, "a.example.com") for i in range(n)], "src string, dst string, pos int, dst_host string")
    seeds = spark.createDataFrame([(1, "https://a.example.com/0")], "seed_id int, url string")
    got = crawl.frontier(links, seeds).select("level").collect()
    assert sorted(r["level"] for r in got) == list(range(n + 1))


def test_names_of_one_slug_get_ids_of_their_own(spark):
    names = spark.createDataFrame([("My Rules",), ("my-rules",), ("my rules!",), ("other",)], "set_name string")
    taken = spark.createDataFrame([("my-rules",), ("my-rules-3",)], "set_id string")
    got = {r["set_name"]: r["set_id"] for r in rulesets.new_set_ids(names, taken).collect()}
    assert sorted(got.values()) == ["my-rules-2", "my-rules-4", "my-rules-5", "other"]


@pytest.mark.parametrize("name,known", [("Tamil", True), ("Ethiopic", True), ("Old_Italic", True), ("Nosuch", False), ("Grek", False), ("Thai", True)])
def test_scripts(name, known):
    assert patterns.is_script(name) is known


def test_every_script_that_passes_is_one_of_the_jvm(spark):
    for name in ("Tamil", "Ethiopic", "Old_Italic", "Phags_Pa", "Nko", "Yezidi", "SignWriting"):
        assert patterns.is_script(name)
        assert spark.range(1).select(F.lit("a").rlike(f"\\p{{Is{name}}}")).first()[0] is False


def test_closed_address_blocks(spark):
    hosts = {"10.1.2.3": True, "11.1.2.3": False, "172.31.255.255": True, "172.32.0.0": False, "192.0.1.1": False, "192.0.2.9": True, "255.255.255.255": True, "300.1.1.1": False, "a.b.c.d": False}
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls.is_blocked_ipv4(F.col("h")).alias("b")).collect()
    assert {r["h"]: r["b"] for r in got} == hosts


def test_batch_rows_hold_all_hits_and_lists_the_first(spark):
    results = spark.createDataFrame([(list(range(25)),)], "hits array<int>")
    assert reports.batch_display(results).select(F.size("hits")).first()[0] == 20
