"""Loose rule documents are parsed and repaired once."""

from pyspark.sql import functions as F

from sigweave.sources import loose

DOCS = ['{"id": "a", "matchers": [{"type": "word", "words": ["w"]}]}', '[{"id": "b"}]', '"text"', "null", "7", None, '{"id": " ", "matchers": {"type": "word", "words": "w"}}', '{"id": "c", "matchers": {"type": " word ", "words": "w", "negative": "0"}}']


def test_repair_parses_once_and_keeps_objects_only(spark):
    docs = spark.createDataFrame([(d,) for d in DOCS], "value string").repartition(2).select(F.try_parse_json("value").alias("doc"))
    made = loose.repair(docs)
    assert made._jdf.queryExecution().executedPlan().toString().count("parseJson") == 1
    rows = {r["rule"]["id"]: r["rule"]["matchers"] for r in made.collect()}
    assert sorted(rows) == ["a", "c"]
    assert [(m["type"], m["words"], m["negative"]) for m in rows["c"]] == [("word", ["w"], True)]
