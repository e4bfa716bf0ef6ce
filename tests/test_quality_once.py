"""The rule check reads a document as few times as it can and keeps the shape of its lists."""

import json

import pyarrow as pa

from sigweave.operators import quality


def test_matchers_are_not_sought_in_the_document_again(spark, capfd):
    good = {"id": "a", "name": "A", "matchers-condition": "or", "matchers": [{"type": "word", "words": ["x"]}]}
    odd = [good, {**good, "matchers": None}, {**good, "matchers": [{"type": "regex", "regex": ["(", None, "a", "("]}]}, {**good, "name": "  \n"}]
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(odd)] + [(9, "{"), (10, None)], "n int, doc string")
    found = quality.check(docs)
    found.explain()
    assert "get_json_object" not in capfd.readouterr().out
    got = sorted((r.n, r.path, r.code) for r in found.collect())
    assert [g for g in got if g[0] in (0, 1, 3, 9, 10)] == [(1, "matchers", "invalid_list"), (3, "name", "invalid_string"), (9, "$", "invalid_json"), (10, "$", "invalid_json")]
    assert [g[1] for g in got if g[0] == 2 and g[2] == "invalid_regex"] == ["matchers[0].regex[0]", "matchers[0].regex[3]"]


def test_lists_keep_their_cuts_and_nulls():
    rows = pa.array([[["a", None], None, []], None, [], [["b"]]], pa.list_(pa.list_(pa.string())))
    flat = rows.values.values
    assert quality._listed(rows, quality._listed(rows.values, flat)).to_pylist() == rows.to_pylist()
