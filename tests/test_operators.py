"""Operators on small fixtures with known results."""

import random
import string
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigweave.functions import expressions, hashing, html, urls, versions
from sigweave.functions.text import lower_text
from sigweave.operators import candidates, closure, crawl, favicons, folding, matching, reports
from sigweave.plans import detect
from sigweave.sources.captures import complete
from sigweave.sources.pack import PackTooLarge, RulePack, probe_key


def one(df):
    return df.collect()[0][0]


def caps(spark, rows):
    return complete(spark.createDataFrame(rows, "capture_id long, url string, title string, body string, status int"))


def hits_of(spark, rules, body="the Body text", status=200, url="https://a.example.com/"):
    out = detect.detect(caps(spark, [(1, url, "Title", body, status)]), RulePack.from_documents(rules))
    return {r["rule_id"]: r for r in out.collect()}


def word(words, **more):
    return {"type": "word", "words": words, **more}


@pytest.mark.parametrize("text,digest", [("", 0), ("foo", -156908512), ("abc", -1277324294)])
def test_murmur3(spark, text, digest):
    assert one(spark.createDataFrame([(text,)], "t string").select(hashing.murmur3_32(F.col("t")))) == digest


def test_icon_text_lines(spark):
    rows = spark.createDataFrame([(bytearray(range(57)),), (bytearray(range(3)),)], "c binary")
    got = [r[0] for r in rows.select(hashing.icon_text(F.col("c"))).collect()]
    assert got[0].endswith("\n\n") and got[0].index("\n") == 76
    assert got[1] == "AAEC\n"


def test_probe_ids_agree(spark):
    rows = spark.createDataFrame([("img", "", {"b": "2", "a": "1"}), ("#x", "té", None), ("", "", None)], "s string, t string, a map<string,string>")
    got = [r[0] for r in rows.select(hashing.probe_id(F.col("s"), F.col("t"), F.col("a"))).collect()]
    assert got == [probe_key("img", "", {"a": "1", "b": "2"}), probe_key("#x", "té"), probe_key("")]


@pytest.mark.parametrize("template,groups,version", [
    ("r\\2-\\1", ["", "beta", "11"], "r11-beta"), ("\\3?lts:edge", ["", "q", "", ""], "edge"), ("\\3?lts:edge", ["", "q", "", "0"], "lts"), ("build \\4", ["", "z"], "build"),
    ("\\2?\\1:none", ["", "k", ""], "none"), ("\tq \n8", [], "q 8"), ("why?so", [], "why?so"), ("\\1?maybe", ["", "m"], "m?maybe"), ("yz" * 90, [], "yz" * 60),
])
def test_version_template(spark, template, groups, version):
    rows = spark.createDataFrame([(groups,)], "g array<string>")
    assert one(rows.select(versions.expand(template, F.col("g")))) == version


@pytest.mark.parametrize("pairs,mode,rule,want", [
    ([60, 90], "or", None, 90), ([60, 90], "and", None, 60), ([60, 90], "and", 50, 30), ([None], "or", None, None), ([None], "or", 70, 70), ([999], "or", None, None), ([33], "or", 50, 16),
])
def test_confidence(spark, pairs, mode, rule, want):
    matchers = [word(["body"], **({} if c is None else {"confidence": c})) for c in pairs]
    doc = {"id": "r", "matchers-condition": mode, "matchers": matchers, **({} if rule is None else {"confidence": rule})}
    assert hits_of(spark, [doc])["r"]["confidence"] == want


def test_three_outcomes(spark):
    bad = {"type": "regex", "regex": ["("]}
    rules = [
        {"id": "bad-negative", "matchers": [{**bad, "negative": True}]}, {"id": "bad-or-hit", "matchers": [{"type": "regex", "regex": ["(", "body"]}]},
        {"id": "empty-negative", "matchers": [word([], negative=True)]}, {"id": "unknown-negative", "matchers": [{"type": "odd", "negative": True}]},
        {"id": "and-miss-beats-invalid", "matchers": [{"type": "regex", "regex": ["(", "absent"], "condition": "and", "negative": True}]},
        {"id": "empty-word", "matchers": [word([""])]}, {"id": "partial", "matchers": [word(["body", "absent"], condition="and", version="9", negative=True)]},
        {"id": "branch", "matchers": [word(["body", "absent"], condition="and", version="wrong"), word(["text"], version="2")]},
    ]
    got = hits_of(spark, rules)
    assert set(got) == {"bad-or-hit", "empty-negative", "and-miss-beats-invalid", "empty-word", "partial", "branch"}
    assert got["branch"]["version"] == "2" and len(got["branch"]["evidence"]) == 1
    assert got["partial"]["version"] == "" and got["partial"]["evidence"][0]["detail"] == folding.NEGATIVE_DETAIL


def test_state_table(spark):
    rows = spark.createDataFrame([("or", 0, 0, 0), ("or", 1, 1, 2), ("or", 0, 1, 2), ("and", 1, 1, 2), ("and", 0, 1, 2), ("and", 2, 0, 2)], "c string, h int, i int, n int")
    got = [r[0] for r in rows.select(folding.matcher_state(F.col("c"), F.col("h"), F.col("i"), F.col("n"))).collect()]
    assert got == [False, True, None, None, False, True]


def test_closure_and_exclusion(spark):
    rules = [
        {"id": "a", "name": "A", "confidence": 40, "implies": ["B", "Self"], "matchers": [word(["body"])]}, {"id": "b", "name": "B", "implies": ["c", "A"], "matchers": [word(["absent"])]},
        {"id": "c", "name": "Cee", "implies": ["Dee"], "matchers": [word(["absent"])]}, {"id": "self", "name": "Self", "implies": ["Self"], "matchers": [word(["absent"])]},
        {"id": "x", "name": "X", "excludes": ["dee", "Y"], "matchers": [word(["text"])]}, {"id": "y", "name": "Y", "excludes": ["X"], "matchers": [word(["body"])]},
    ]
    rows = caps(spark, [(1, "u", "t", "the Body text", 200)])
    closed = closure.add_implied(detect.rule_hits(rows, RulePack.from_documents(rules)), RulePack.from_documents(rules))
    got = {r["name"]: (r["level"], r["evidence"][0]["detail"] if r["level"] else "", r["confidence"]) for r in closed.collect()}
    assert got == {"A": (0, "", 40), "X": (0, "", None), "Y": (0, "", None), "B": (1, "derived from A", 40), "Self": (1, "derived from A", 40),
                   "c": (2, "derived from B", 40), "Dee": (3, "derived from c", 40)}
    kept = closure.drop_excluded(closed, RulePack.from_documents(rules))
    assert {r["name"] for r in kept.collect()} == {"A", "B", "Self", "c"}


def test_icon_dictionary(spark):
    rows = caps(spark, [(1, "u", "t", "body", 200)]).withColumn("favicon_hashes", F.array(*map(F.lit, [0, 5, 5, 6, 7, 8])))
    names = spark.createDataFrame([(5, "UNKNOWN"), (6, "UNKNOWN"), (7, "Seven"), (0, "Zero")], "hash int, name string")
    custom = spark.createDataFrame([(7, "Mine"), (8, "Body rule")], "hash int, name string")
    hits = detect.detect(rows, RulePack.from_documents([{"id": "w", "name": "Body rule", "matchers": [word(["body"])]}]), names, custom)
    got = [(r["rule_id"], r["name"]) for r in detect.with_position(hits).orderBy("hit_ord").collect()]
    assert got == [("w", "Body rule"), ("icon-5", "UNKNOWN"), ("icon-7", "Mine")]
    assert favicons.ICON_LEVEL > 0


@pytest.mark.parametrize("text,value", [
    ('status == "200"', True), ("false || true && true", True), ("status == 200 || boom()", True), ("boom() || status == 200", None), ("nope && false", None), ("false && nope", False),
    ("!contains(body, 'zz')", True), ("contains(body, \"Body\")", True), ("matches(body, '\\\\d')", False), ("matches(body, title)", False), ("status = 200", None), ("a & b", None), ("'a' 'b'", None),
    ("(status == 200", None), ("contains(body,)", None), ("favicon_hash == 0", True), ("", None), ("status == -1", False), ("99999999999999999999 == 1", None), ("'it\\'s' != \"x\"", True),
])
def test_expressions(spark, text, value):
    rows = caps(spark, [(1, "u", "Title", "the Body text", 200)])
    assert one(rows.select(expressions.try_column(text))) is value


def test_html_features(spark):
    page = ("<TITLE lang=x>\n A  b \n</TITLE><meta name=a content=1><meta name='A' content=\"2\"><meta name=e content=''><meta property=og content=o>"
            "<link rel='shortcut icon' href=/1><link rel=apple-touch-icon href=/2><link rel=stylesheet href=/3><link rel=icon href=/4><a name=x><a href='/p' href=/q>")
    rows = spark.createDataFrame([(page,)], "h string")
    h = F.col("h")
    got = rows.select(html.title(h).alias("t"), html.meta(h).alias("m"), html.favicons(h).alias("i"), html.links(h).alias("l")).collect()[0]
    assert (got["t"], got["m"], got["i"], got["l"]) == ("A b", {"a": "2", "og": "o"}, ["/1", "/2", "/4"], ["/q"])


@pytest.mark.parametrize("url,norm", [
    ("http://a.com/x/", "http://a.com/x"), ("http://a.com/", "http://a.com/"), ("http://a.com", "http://a.com"), ("http://a.com/x/?q=/", "http://a.com/x?q=/"), ("http://a.com/x#f/", "http://a.com/x"),
    ("http://a.com/x//", "http://a.com/x/"), ("http://a.com?q=/x/", "http://a.com?q=/x/"),
])
def test_normalize(spark, url, norm):
    assert one(spark.createDataFrame([(url,)], "u string").select(urls.normalize(F.col("u")))) == norm


def test_batch_targets(spark):
    given = ["https://A.example.com", "https://a.example.com/", " https://a.example.com/#x ", "ftp://a.example.com", "nonsense", "https://u:p@a.example.com/", "https://a.example.com/" + "x" * 2100, "https://b.example.com/p?q#f"]
    rows = spark.createDataFrame(list(enumerate(given)), "ord int, url string")
    got = {r["ord"]: (r["verdict"], r["target"]) for r in reports.classify_targets(rows).collect()}
    assert [got[i][0] for i in range(8)] == ["kept", "duplicate", "duplicate", "invalid", "invalid", "invalid", "invalid", "kept"]
    assert got[7][1] == "https://b.example.com/p?q"


def test_crawl_feed(spark):
    links = ["/a", "/a/", "#x", "https://sub.example.com/b", "https://fakeexample.com/", "/i.PNG", "mailto:a@b.c", "/a?q=1#z"]
    body = "".join(f'<a href="{link}">' for link in links)
    pages = caps(spark, [(1, "https://www.example.com/", "t", body, 200)])
    seeds = spark.createDataFrame([(7, "https://www.example.com/")], "seed_id int, url string")
    reached = crawl.frontier(crawl.edges(pages), seeds)
    assert {(r["url"], r["level"]) for r in reached.collect()} == {
        ("https://www.example.com/", 0), ("https://www.example.com/a", 1), ("https://sub.example.com/b", 1), ("https://www.example.com/a?q=1", 1)}
    limited = crawl.status(crawl.frontier(crawl.edges(pages), seeds, max_pages=2)).collect()[0]
    assert (limited["visited"], limited["queued"]) == (2, 2)


def test_pruned_equals_unpruned(spark):
    rng = random.Random(5)
    alphabet = string.ascii_letters + " <>/=\"'中文ſKéß\n"
    bodies = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["ſcript Kelvin mask", "致远OA 系统 seeyon", "STRASSE ſ"]
    pieces = [b[i:i + rng.randint(1, 6)] for b in bodies for i in range(0, len(b), 37) if b[i:i + 6].strip()]
    rules = [{"id": f"w{i}", "matchers": [word([p, p.swapcase()], version="1")]} for i, p in enumerate(pieces)]
    rules += [{"id": f"r{i}", "matchers": [{"type": "regex", "regex": [rx], "version": "\\1"}]} for i, rx in enumerate(
        ["script", "(s)cript|mask", "k(elvin)", "[a-z]{2}([<>])", "(中|文).", "x*", "strasse|STRASSE", "(?:foo|[A-F]+)z", "致远(oa)", "é+", "mask$", "(?-i)Kelvin"])]
    rows = caps(spark, [(i, "u", "t", b, 200) for i, b in enumerate(bodies)])
    pack = RulePack.from_documents(rules)
    text = F.col("body")
    tried = [(p.pid, F.contains(lower_text(text), F.lit(p.lowered)) if p.type == "word" else F.rlike(text, F.lit(p.java))) for p in pack.patterns if p.valid]
    held = rows.select("capture_id", *[c.alias(f"p{pid}") for pid, c in tried]).collect()
    want = sorted((r["capture_id"], pid) for r in held for pid, _ in tried if r[f"p{pid}"])
    got = matching.text_hits(rows, pack).collect()
    assert sorted((r["capture_id"], r["pid"]) for r in got) == want
    assert len(want) > 100


def test_grams_of_pages(monkeypatch):
    monkeypatch.setattr(candidates, "SLICE", 50)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abé漢", k=rng.randint(0, 40))) for _ in range(80)] + ["", "abab" * 40, "a"]
    grams = {raw[i:i + 4] for t in texts[::3] for raw in [t.encode()] for i in range(len(raw) - 3)}
    codes = np.array(sorted(int.from_bytes(g, "little") for g in grams), np.uint32)
    for column in (pa.array(["x", *texts])[1:], pa.array(texts, pa.large_string())):
        row, code = candidates.page_grams(column, codes, candidates._marked(codes))
        want = sorted((n, c) for n, t in enumerate(texts) for c in {int.from_bytes(t.encode()[i:i + 4], "little") for i in range(len(t.encode()) - 3)} & set(codes.tolist()))
        assert list(zip(row.tolist(), code.tolist())) == want
    assert candidates.page_grams(pa.array(texts), codes[:0], candidates._marked(codes[:0]))[0].size == 0


@pytest.mark.parametrize("n", [1, 4, 16])
def test_same_hits_on_any_partitioning(spark, n):
    rows = caps(spark, [(i, f"https://a.example.com/{i}", "t", f"body {i} wp-content", 200 + i % 3) for i in range(40)])
    pack = RulePack.from_documents([
        {"id": "x", "implies": ["y"], "matchers": [word(["wp-content"]), {"type": "status", "status": [201]}]}, {"id": "n", "matchers": [word(["body 7"], negative=True)]}])
    columns = ["capture_id", "hit_ord", "rule_id", "evidence"]
    base = detect.with_position(detect.detect(rows.coalesce(1), pack)).select(*columns)
    other = detect.with_position(detect.detect(rows.repartition(n), pack)).select(*columns)
    assert sorted(map(repr, base.collect())) == sorted(map(repr, other.collect()))


def test_pack_bound():
    with pytest.raises(PackTooLarge):
        RulePack([{"id": str(i), "matchers": []} for i in range(100_001)])


def test_skewed_targets(spark):
    rows = spark.range(3000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "https://hot.example.com/").otherwise(
        F.concat(F.lit("https://c.example.com/"), F.col("id").cast("string"))).alias("url"))
    counts = {r["verdict"]: r["n"] for r in reports.classify_targets(rows).groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    assert counts == {"kept": 2001, "duplicate": 999}


def test_feed_refresh_and_rollback(spark):
    from sigweave.operators import rulesets
    from sigweave.plans.jobs import refresh_feed

    sets = spark.createDataFrame([("own", "Own", 0, 0, "a", "1")], "set_id string, set_name string, set_ord int, rule_ord long, rule_id string, rule string")
    versions = spark.createDataFrame([], "set_id string, rule_id string, rule string, version int")
    feed = lambda rows: spark.createDataFrame(rows, "rule_id string, rule_ord long, rule string")
    first = refresh_feed(sets, versions, "src", "Source", feed([("x", 0, "1"), ("y", 1, "1")]))
    again = refresh_feed(first.rule_sets, first.versions, "src", "Source", feed([("y", 1, "1"), ("x", 0, "1")]))
    second = refresh_feed(first.rule_sets, first.versions, "src", "Source", feed([("x", 0, "2"), ("z", 1, "1")]))
    assert (first.unchanged, again.unchanged, second.unchanged) == (False, True, False)
    assert second.summary.collect()[0].asDict() == {"added": 1, "removed": 1, "changed": 1, "unchanged": 0}
    back = rulesets.current_version(rulesets.rollback(second.versions))
    assert sorted(r["rule_id"] for r in back.collect()) == ["x", "y"]
    forth = rulesets.current_version(rulesets.rollback(rulesets.rollback(second.versions)))
    assert sorted(r["rule_id"] for r in forth.collect()) == ["x", "z"]


@pytest.mark.parametrize("host,blocked", [
    ("::", True), ("::1", True), ("0:0:0:0:0:0:0:1", True), ("fd12:3456::9", True), ("fe9f::1", True), ("fec0::1", False), ("ff02::fb", True), ("2001:db8:5::", True), ("2001:db9::1", False),
    ("::ffff:8.8.4.4", True), ("64:ff9b::10.1.1.1", True), ("64:ff9b::9.9.9.9", False), ("2606:4700::1", False), ("1:2:3:4:5:6:7:8", False), ("1:2:3", True), ("g::1", True), ("example.com", False),
])
def test_longer_addresses(spark, host, blocked):
    assert one(spark.createDataFrame([(host,)], "h string").select(urls.is_blocked_ipv6(F.col("h")))) is blocked


def test_grams_of_a_batch_take_little_memory():
    """What a batch of texts needs on top of itself follows the slice, not the batch."""
    texts = pa.array([f"<p>{n} wp-content {'x' * 2_000}</p>" for n in range(8_000)])
    codes = np.array(sorted(candidates.rarest_gram(t) for t in ("wp-content", "</p>")), np.uint32)
    seen = candidates._marked(codes)
    tracemalloc.start()
    rows, _ = candidates.page_grams(texts, codes, seen)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 16_000
    assert peak < 48 << 20
