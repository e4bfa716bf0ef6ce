"""Cleaning and packing of a corpus in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.llm.common import read_table, store
from sigweave.llm.queries import tokenizer_path

#: Documents of this score or more are rejected: those more likely toxic than not, so that
#: doubtful ones stay.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below ``TOXIC``; the classifier learns from the
    labelled rows of the documents table."""
    from sigweave.llm.toxicity import fit, score

    model = fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return score(docs, *model, keep=True).where(F.col("score") < TOXIC).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, counts of characters renewed."""
    from sigweave.llm.lines import remove_lines

    return _counted(remove_lines(docs), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of the least id."""
    from sigweave.llm.jaccard import near_duplicates

    # Ids may be null or repeated, so rows get numbers of their own for the time of the stage.
    numbered = store(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    classes = near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id")
    first = F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    kept = numbered.select("_row", "doc_id").join(classes, "_row").groupBy("class_id").agg(first.alias("_row"))
    return numbered.join(kept, "_row", "left_semi").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long byte strings that occur elsewhere. Where a cut splits a
    character, what is left of it becomes the replacement character."""
    from sigweave.llm.suffixes import remove_repeats

    out = remove_repeats(docs).withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.expr("make_valid_utf8(cast(kept AS string))")))
    return _counted(out, docs.columns)


def pack_curve(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in full sequences: their tokens (unsigned 32-bit,
    little-endian) and the checksum of these."""
    from sigweave.llm.packing import pack

    pieces = pack(docs, tokenizer_path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("token_ids"))


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*columns)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("packing", pack_curve),
]

#: The classifier, the byte strings and the curve have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
