"""Native rule documents: read, split into documents, type, and check shape."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.schema import RULE
from sigweave.session import listing

try:
    import yaml
except ImportError:  # JSON documents still load; they are a subset of YAML
    yaml = None


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(source, content)``: one row per rule file."""
    with listing(spark):
        files = spark.read.text(path, wholetext=True)
    return files.select(F.input_file_name().alias("source"), F.col("value").alias("content"))


def _documents(text: str) -> list:
    if yaml is None:
        return [json.loads(text)]
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    return [doc for doc in yaml.load_all(text, Loader=loader) if doc]


def _load_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for source, content in zip(batch["source"], batch["content"]):
            try:
                docs = _documents(content or "")
            except Exception as broken:  # one broken file must not stop the load
                rows.append((source, -1, None, f"unreadable: {type(broken).__name__}"))
                continue
            rows += [(source, ix, json.dumps(doc, ensure_ascii=False, default=str), None) for ix, doc in enumerate(docs)]
        yield pd.DataFrame(rows, columns=["source", "doc_ix", "doc", "error"])


def split_documents(files: DataFrame) -> DataFrame:
    """YAML (or JSON) files to ``(source, doc_ix, doc, error)`` with ``doc`` as JSON. A file that
    cannot be read is one row with its error."""
    return files.select("source", "content").mapInPandas(_load_batches, "source string, doc_ix int, doc string, error string")


def _parsed(docs: DataFrame, doc: str) -> DataFrame:
    text = F.trim(F.col(doc))
    wrapped = F.concat(
        F.lit('{"rules":'), F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), F.lit("}")
    )
    kind = T.StructType([T.StructField("rules", T.ArrayType(RULE)), T.StructField("_broken", T.StringType())])
    return docs.withColumn("_parsed", F.from_json(wrapped, kind, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))


def quarantine(files: DataFrame) -> DataFrame:
    """``(source, doc_ix, error)`` of what ``native_rules`` leaves out: files that cannot be read
    and documents whose fields have wrong types."""
    docs = _parsed(split_documents(files), "doc")
    wrong = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("_parsed._broken").isNotNull(), "wrong types")
    return docs.select("source", "doc_ix", wrong.alias("error")).where("error IS NOT NULL")


def typed_rules(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Explode documents (a list or one object) into ``rule`` structs.

    A document whose fields have wrong types is dropped as a whole, and so is a
    rule without id or matchers; unknown fields are ignored.
    """
    parsed = _parsed(docs, doc).where(F.col("_parsed._broken").isNull())
    rows = parsed.select(
        *[c for c in docs.columns if c != doc], F.posexplode("_parsed.rules").alias("rule_ix", "rule")
    )
    return rows.where(
        (F.coalesce(F.col("rule.id"), F.lit("")) != "") & (F.size(F.coalesce("rule.matchers", F.array())) > 0)
    ).withColumn("rule", with_defaults(F.col("rule")))


def with_defaults(rule: Column) -> Column:
    """Name falls back to the id, the condition to ``or``."""
    return rule.withField(
        "name", F.coalesce(F.nullif(rule["name"], F.lit("")), rule["id"])
    ).withField(
        "`matchers-condition`", F.when(rule["matchers-condition"] == "and", "and").otherwise("or")
    )


def native_rules(files: DataFrame) -> DataFrame:
    """Files to ``(source, doc_ix, rule_ix, rule)``."""
    return typed_rules(split_documents(files).where("error IS NULL").drop("error"))


def matcher_rows(rules: DataFrame, *keys: str) -> DataFrame:
    """One row per matcher; ``rule`` must be a rule struct column."""
    return rules.select(*keys, F.posexplode("rule.matchers").alias("matcher_ix", "matcher"))


def payload_size(m: Column) -> Column:
    sizes = [F.size(F.coalesce(m[f], F.array())) for f in ("words", "regex", "status", "hash", "dsl", "js", "dom")]
    return sum(sizes[1:], sizes[0])


def to_export(rules: DataFrame, rule: str = "rule") -> DataFrame:
    """Rules as JSON text, ready for ``write.text``; JSON is valid YAML."""
    return rules.select(F.to_json(rule).alias("value"))
