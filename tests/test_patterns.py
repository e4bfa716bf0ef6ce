"""Pattern loading: validity, meaning on both engines, required literals."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sigweave.functions.patterns import compile_pattern, loosen_repeats, nesting_depth
from sigweave.functions.text import extract

TEXTS = [
    "", "abc", "ABC\n", "a{", "server: nginx/1.25\nx-powered-by: PHP/8\n", "foo bar", "x\vy", "x y", "tab\there", "naïve Ünï 中文 text", "a\r\nb",
    "aaaa", "[x]", "a&&b", "line one\nline two", "foo_bar-baz", "1.2.3", "é", "<div class='x'>", "AbCdEf", "\\d+", "{}", "no-match",
]
PATTERNS = [
    "abc", "^abc$", "a{", "a{2}", "a{2,3}?", "[[]x", "[]x]", "[^a-c]+", "(?P<n>foo)\\s(bar)", "server:\\s(?:openresty|nginx)\\b/?([0-9]*)", "(?im)^x-powered-by:[^\\n]*php/([0-9]+)$",
    "x.y", "(?s)one.line", "(?m)^line two$", "\\bfoo\\b", "foo\\b", "\\Bar", "[\\w-]+", "\\W+", "\\S+", "[\\s\\d]+", "\\x41", "\\x{4e2d}", "中.", "(?U)a+", "(?-i)abc", "a|b|", "(?i:ABC)",
    "\\Qa{\\E", "[&&x]+", "\\pL+", "\\p{Han}+", "[[:alpha:]]+", "[^[:space:]]+", "()", "(a(b(c)))", "x*", "\\.", "\\141", "\\a?b", "é+", "[é-ü]", "foo$", "\\z", "\\Aabc", "\\{\\}", "(?:a|b)*c",
]
INVALID = ["(", ")", "[a", "a**", "a++", "*a", "+", "a{2}{3}", "(?=a)", "(?!a)", "(?<=a)b", "(?>a)", "\\1", "(a)\\1", "[b-a]", "\\Z", "\\k<n>", "a{1001}x{3,2}", "(?z)", "\\", "[[:nope:]]", "\\pX", "(?P<n", "x{5,2}"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_match_as_re2(spark, pattern):
    found = compile_pattern(pattern)
    assert found.valid, found.reason
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    java = F.lit(found.java)
    got = {r["i"]: (r["m"], r["d"]) for r in rows.select("i", F.rlike("t", java).alias("m"), extract(F.col("t"), java, 0).alias("d")).collect()}
    con = duckdb.connect()
    for i, text in enumerate(TEXTS):
        want = con.execute("SELECT regexp_matches(?, ?), regexp_extract(?, ?, 0)", [text, "(?i)" + pattern] * 2).fetchone()
        assert got[i] == want, (text, found.java)


@pytest.mark.parametrize("pattern", INVALID)
def test_invalid(pattern):
    assert not compile_pattern(pattern).valid


def test_repeats_and_depth():
    assert loosen_repeats("p{2,300}q{5}r{40}s{3,}t{1,9}") == "p{2,}q{5}r{40,}s{3,}t{1,9}"
    assert nesting_depth("((a)[(](b\\())") == 2
    assert not compile_pattern("(" * 33 + "a" + ")" * 33).valid
    assert compile_pattern("(" * 32 + "a" + ")" * 32).valid


@pytest.mark.parametrize("pattern,literals", [
    ("track\\((\\d+)\\)", {"track("}), ("foo|bar", {"foo", "bar"}), ("foo|[0-9]+", set()), ("(?:foo)?bar", {"bar"}), ("/(en|fr)/", {"/en/", "/fr/"}),
    ("a*", set()), ("(?:ab)+c", {"ab"}), ("中文abc", set()), ("x|", set()),
])
def test_required_literals(pattern, literals):
    assert set(compile_pattern(pattern).literals) == literals
