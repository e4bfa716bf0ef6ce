"""Merge-dropout is drawn at every occurrence of a word."""

import random

import numpy as np

from sigweave.llm import pieces, queries

MODEL = queries.tokenizer_path("piece_bpe_32k.model")


def test_occurrences_of_a_word_are_drawn_by_themselves(spark):
    docs = spark.createDataFrame([(i, " ".join(["international"] * 50)) for i in range(40)], "doc_id long, text string")
    rows = pieces.encode(docs, MODEL).collect()
    assert all(r["lossless"] for r in rows)
    # Four keys gave four different rows at most.
    assert len({bytes(r["ids"]) for r in rows}) == 40
    m = pieces.pieces(MODEL)
    lone = len(m.encode("international"))
    dropped = m.encode(" ".join(["international"] * 50), 0, 0.1, pieces.SEED, 1)
    assert len(dropped) > 50 * lone


def test_rounds_equal_an_agenda_of_each_word(monkeypatch):
    rng = random.Random(2)
    stock = ["international", "the", "houses", "a▁b", "x\0y", "", "naïve", "日本語", "unbelievably", "12,345", "🙂ü", "x" * 70, "\ud800"]
    texts = [" ".join(rng.choices(stock, k=60)) for _ in range(30)]
    m = pieces.Pieces(MODEL)
    monkeypatch.setattr(pieces, "AT_ONCE", 50)
    kept = m.encode_all(texts, [1] * 30, 0.3, 17, list(range(30)))
    monkeypatch.setattr(pieces, "LONG", -1)
    assert kept == [m.encode(t, 1, 0.3, 17, i) for i, t in enumerate(texts)]
    assert [m.decode(k) for k in kept] == texts


def test_without_dropout_equal_to_the_library():
    import sentencepiece

    rng = random.Random(5)
    stock = ["international", "the", "houses", "naïve", "日本語", "unbelievably", "12,345", "Größe", "🙂", "e.g.", "don't", "zebra-crossing"]
    texts = [" ".join(rng.choices(stock, k=rng.randint(1, 80))) for _ in range(60)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    m = pieces.pieces(MODEL)
    for text, ids in zip(texts, m.encode_all(texts, [0] * 60, 0.0, 17, [None] * 60), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)


def test_a_very_long_text_and_repeated_rows(spark):
    long = "some words of a text that goes on " * 40_000
    docs = spark.createDataFrame([(1, long), (1, long), (2, None), (3, ""), (None, "x"), (4, "y" * 30_000)], "doc_id long, text string")
    rows = pieces.encode(docs, MODEL).collect()
    assert len(rows) == 6 and all(r["lossless"] for r in rows)
    assert len({bytes(r["ids"]) for r in rows if r["doc_id"] == 1}) == 1
    assert all(bytes(r["ids"]) == b"" for r in rows if r["doc_id"] in (2, 3))
