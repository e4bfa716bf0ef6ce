"""Stages of the corpus pipeline."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from sigweave.llm import queries


def test_one_document_of_each_class_stays_whatever_its_id(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(5, text, "a"), (2, text, "b"), (2, text + " more", "c"), (2, "quite another text of its own making", "d"), (None, "first without an id at all here", "e"),
            (None, "second without an id and other words", "f"), (None, text, "g"), (7, None, "h"), (8, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    tags = sorted(r.class_id for r in got.collect())
    assert tags in (["b", "d", "e", "f", "h"], ["c", "d", "e", "f", "h"])
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


WORDS = "river stone market window garden letter bridge winter summer island forest yellow".split()


def _texts(n: int) -> list[str]:
    rng = random.Random(4)
    return [" ".join(rng.choices(WORDS, k=40)) + f" number {i}" for i in range(n)]


def test_run_goes_through_all_stages(spark, tmp_path):
    shared = "the very same line stands here in more than one of the documents we keep"
    clean = _texts(24)
    texts = [(t + "\n" + shared if i in (3, 9) else t) for i, t in enumerate(clean)]
    texts += [clean[5], None, "", *(f"you nasty horrid insult {w} horrid nasty" for w in WORDS)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i >= 27)) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    whole = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    read = {}
    for r in got.sort_values(["doc_id", "start"]).itertuples():
        assert len(r.token_ids) == 4 * r.length and zlib.crc32(r.token_ids) == r.ids_crc32
        read.setdefault(r.doc_id, []).extend(np.frombuffer(r.token_ids, "<u4").tolist())
    for i in (3, 4, 5, 9):
        want = texts[i] if i != 9 else clean[9]  # the line goes where it stands the second time
        assert read[i] == whole.encode(want, add_special_tokens=False).ids + [1]
    # The copy's only line has gone; of the texts that are empty by then, the first stays.
    assert read[24] == [1] and 25 not in read and 26 not in read


def test_lines_and_repeats_keep_columns(spark):
    passage = "".join(f"{i:04d} " for i in range(60))
    rows = [(1, "a" + passage + "b", 302, "k"), (2, "c" + passage + "d", 302, "k"), (3, "same\nsame\nend", 13, "k"), (None, None, None, None), (4, "", 0, "k"), (4, "", 0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept string")
    cut = corpus_pipeline.drop_repeats(spark, docs, "")
    assert cut.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.where("doc_id < 3").collect()} == {1: ("ab", 2), 2: ("cd", 2)}
    lined = corpus_pipeline.drop_lines(spark, docs, "")
    assert lined.columns == docs.columns and lined.count() == len(rows)
    assert [(r.text, r.n_chars) for r in lined.where("doc_id = 3").collect()] == [("same\nend", 8)]
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.drop_repeats, corpus_pipeline.pack_curve):
        assert stage(spark, docs.limit(0), "").count() == 0
