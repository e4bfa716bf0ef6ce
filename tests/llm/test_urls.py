"""Rules against a plain reading, features, and what the trees learn."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigweave.llm import urls
from sigweave.llm.common import read_table
from sigweave.llm.queries import PAGE_RULES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MORE = [*PAGE_RULES, ("bare.example", "block"), ("a.b.c.example/x", "allow"), ("example/y", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
    path = rest[len(host) :]
    return host.translate(LOWER), path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def rule_of(host, path, rules):
    fits = []
    for rule, verdict in rules:
        of, slash, rest = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith(slash + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def odd_urls():
    rng = random.Random(1)
    out = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com", "http://example.com?x=/en/", "http://xexample.com/en/", "http://example.com.evil.org/en/",
           "http://ÉX.Example.net/es/", "http://bare.example", "http://deep.bare.example/#/", "a://b://example.com/en/", "http://example.com//en/", "x" * 400_000, "http://" + "a." * 20_000 + "example.com/en/" + "p" * 100_000]
    for _ in range(150):
        host = rng.choice(["", "www.", "m.", "WWW.", "a.b.c."]) + rng.choice(["example.com", "example.net", "example.org", "example", "com", "net"])
        out.append("http://" + host + rng.choice(["", "/", "/en/", "/es/", "/fr/", "/en", "/x", "/y/z", "?/en/", "#"]) + rng.choice(["", "1", "?a=1&b=2", "#t"]))
    return out + out[-5:]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(MORE + [MORE[0]], "rule string, verdict string")


def test_rules_equal_a_plain_reading(spark, rules):
    pages = spark.createDataFrame([(i if i % 9 else None, u, "x", "y") for i, u in enumerate(odd_urls())], "page_id long, url string, rule string, score string")
    got = urls.judge(pages.repartition(3), rules).collect()
    want = [(i if i % 9 else None, *parts(u), *rule_of(*parts(u), MORE)) for i, u in enumerate(odd_urls())]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=key) == sorted((w[:4] for w in want), key=key)
    assert all(r.verdict in ("allow", "block") and 0 <= r.score <= 1 for r in got)
    ruled = {(w[1], w[2]): w[4] for w in want}
    assert all(ruled[r.host, r.path] == r.verdict for r in got if r.rule)


def test_empty_table_and_no_rules(spark, rules):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (2, None)], "page_id long, url string")
    assert urls.judge(pages.limit(0), rules).count() == 0
    got = urls.judge(pages, rules.limit(0)).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")] * 2


def test_entropy_of_characters(spark):
    texts = ["", "a", "aaaa", "abab", "http://x.y/1?q=2", "ÉÉé漢", "x" * 5_000 + "y"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.entropy(F.col("t")).alias("e")).collect()
    for r in got:
        n = len(r.t)
        assert r.e == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(r.t).values()) if n else 0.0, abs=1e-9)


def test_held_out_accuracy(spark):
    pages = read_table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url")
    told = urls.decided(urls.with_parts(pages), spark.createDataFrame(PAGE_RULES, "rule string, verdict string")).where("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("int"))
    held = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(4)) == 0
    model = urls.fit(told.where(~held))
    got = urls.scored(told.where(held), model).select("label", (F.col("score") >= 0.5).cast("int").alias("said")).toPandas()
    assert (got.label == got.said).mean() > 0.93
    assert got[got.label == 1].said.mean() > 0.85


def test_copies_count_once_and_rows_without_label_do_not(spark):
    rows = [("http://good.example/%d" % i, 0) for i in range(60)] + [("http://bad.example/%d" % i, 1) for i in range(60)]
    rows += [("http://good.example/1", 0)] * 400 + [(None, 1), ("http://good.example/2", None)]
    model = urls.fit(spark.createDataFrame(rows, "url string, label int"))
    assert model.prior == 0.5
    tried = urls.with_parts(spark.createDataFrame([("http://good.example/new",), ("http://bad.example/new",)], "url string"))
    got = {r.url: r.score for r in urls.scored(tried, model).collect()}
    assert got["http://good.example/new"] < 0.5 < got["http://bad.example/new"]
