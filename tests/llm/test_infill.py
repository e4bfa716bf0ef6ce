"""Fill-in-middle forms against a plain reading, and round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.llm import infill

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def plainly(doc, text):
    text = text or ""
    t = TOKEN.findall(text)
    n, h = len(t), hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(7)
    some = ["word", "Größe", "漢字", "🙂", " ", "\n", "<", "<P", "<S", ">", "x", "1", "\x00", "é", "ſ", "A"]
    rows = [None, "", "a", "é", "\n\n", "<P>", "x<M>y", "<<S", "a" * 3_000, "ab " * 70_000, "é" * 5_000, "x" * 1_200_000 + "."]
    rows += ["".join(rng.choices(some, k=rng.randint(1, 900))) for _ in range(150)]
    shared = "".join(rng.choices(some[:7], k=2_000)).replace("<", "")
    return rows + [rows[-1]] * 3 + ["z" * k + shared for k in range(5)] + [shared + "z" * k for k in range(5)]


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(odd_texts())] + [(None, "no id at all", "x", "y"), (3, "again the id of another", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, form string")
    return rows, docs


def test_equals_a_plain_reading_and_is_restored(made):
    rows, docs = made
    got = infill.fill_in_middle(docs).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    want = sorted(((d is None, d or 0, *plainly(d, t), t or "") for d, t, *_ in rows), key=str)
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=str)
    assert found == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(made):
    assert infill.fill_in_middle(made[1].limit(0)).count() == 0


def test_cuts_follow_content_and_keep_characters_whole():
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefgh éü漢", k=6_000)).encode()
    places = []
    for lead in (b"", b"some lead", "été".encode()):
        raw = lead + passage
        at = infill.cuts(np.frombuffer(raw, np.uint8), np.array([0]))
        assert all(raw[p] & 0xC0 != 0x80 for p in at)
        places.append([p - len(lead) for p in at.tolist() if p - len(lead) >= infill.WINDOW])
    assert places[0] == places[1] == places[2] and len(places[0]) > 10


def test_summaries_join_to_the_count_of_the_whole():
    rng = random.Random(5)
    for _ in range(200):
        raw = "".join(rng.choices("ab1 é\n漢", k=rng.randint(0, 60)))
        ends = sorted({rng.randint(0, len(raw)) for _ in range(rng.randint(0, 8))} | {0, len(raw)})
        parts = [raw[a:b].encode() for a, b in zip(ends, ends[1:])]
        bounds = [0, *np.cumsum([len(p) for p in parts]).tolist()]
        before, lettered = infill.token_counts(raw.encode(), bounds, infill.Memo(40))
        tokens = TOKEN.findall(raw)
        assert before[-1] == len(tokens)
        for k in range(len(tokens) + 1):
            assert infill.place_of(k, raw.encode(), bounds, before, lettered) == len("".join(tokens[:k]).encode())
