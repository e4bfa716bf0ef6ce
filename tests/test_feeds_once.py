"""Feed documents are read once, and each of their patterns is checked once."""

from sigweave.functions import patterns
from sigweave.sources import feeds


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_parsed_once_and_patterns_checked_once(spark):
    docs = spark.range(8).selectExpr("""concat('{"T', id, '": {"html": ["a', id, '"], "js": {"x": "("}, "dom": ["#a"], "implies": "B", "excludes": "C"}}') AS value""")
    techs = feeds.technologies(docs)
    rows = _plan(feeds.techmap_rows(techs))
    assert rows.count("parseJson") == 1
    assert rows.count("ArrowEvalPython [check") == 1
    assert _plan(feeds.relations(techs)).count("parseJson") == 1


def test_the_short_check_agrees_with_the_loader():
    texts = ["", "plain text", "a]", "a}", "ab{", "ab{2}", "ab{2,", "ab{1001}", "ab+c", "ab++", "(ab", "ab)", "[ab", "ab\\", "ab\\Q\\E*", "\\Qa(\\E", "é ü{3}", "a b|c d", "(" * 33 + ")" * 33]
    for text in texts:
        assert patterns.is_valid(text) == patterns.compile_pattern(text, False).valid, text


def test_runs_of_text_stay_single_characters_to_repeats():
    made = patterns.compile_pattern("abc d*ef{2}", False)
    assert made.java == "abc\\x{20}d*ef{2}"
    assert (made.anchor, made.literals) == ("abc ", ("abc ",))
