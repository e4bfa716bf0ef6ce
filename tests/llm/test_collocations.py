"""Mined phrases against a plain reading."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sigweave.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, least, best):
    seen, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                seen.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    kept = {key: f for key, f in seen.items() if f >= least}
    out = []
    for (lang, g), a in kept.items():
        if len(g) == 1:
            continue
        cut = [(2_000_000 * a // (kept[lang, g[:k]] + kept[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cut)
        longer = [f for (x, h), f in kept.items() if x == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
        if not any(100 * f >= 80 * a for f in longer):
            out.append((lang, " ".join(g), a, kept[lang, g[:k]], kept[lang, g[k:]], n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:best])]
    return ranked


def odd_rows():
    rng = random.Random(2)
    common = ["New", "york", "city", "hall", "the", "Größe", "漢字", "É", "of", "a", "x"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ", "\x1c"]
    rows = [(None, None), ("en", ""), ("en", " .. "), ("", "x"), ("und", "the end"), ("en", "a b c d " * 40), ("en", "no ends " * 3_000), ("fr", "new york city hall. " * 35)]
    for _ in range(120):
        rows.append((rng.choice(["en", "en", "en", "fr", None, ""]), "".join(rng.choice(common) + rng.choice(ends) for _ in range(rng.randint(1, 60)))))
    return rows + rows[-20:]


@pytest.mark.parametrize("least,best,block", [(30, 2_000, 6 << 20), (3, 7, 300), (2, 10_000, 1)])
def test_equals_a_plain_reading(spark, monkeypatch, least, best, block):
    rows = odd_rows()
    monkeypatch.setattr(collocations, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n long")
    got = [tuple(r) for r in collocations.mine(docs.repartition(3), least, best).collect()]
    assert sorted(got) == sorted(plainly(rows, least, best)) and got


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_words_and_gaps():
    numbers, words = collocations.words_of([b"", b"One two", b"", b"two. One", b"  ", "é,Ü x".encode()], ["en"] * 5 + ["de"])
    spelt = [None if i < 0 else words[i][:2] for i in numbers]
    assert spelt == [("en", "one"), ("en", "two"), None, ("en", "two"), None, ("en", "one"), None, ("de", "é"), None, ("de", "Ü"), ("de", "x")]


def test_pairs_are_told_apart():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 5, 400) << 32, rng.integers(0, 5, 400) << 40
    want = np.array([(h, m) in set(zip(hi[:9].tolist(), lo[:9].tolist())) for h, m in zip(hi.tolist(), lo.tolist())])
    assert (collocations._held(hi, lo, hi[:9], lo[:9]) == want).all()


def test_products_beyond_64_bits(spark):
    big = 4 * 10**18
    counted = spark.createDataFrame([([0], big), ([1], big), ([0, 1], big - 1), ([2], 100), ([1, 2], 40), ([0, 1, 2], 40)], "w array<int>, f long")
    names = spark.createDataFrame([(0, "en", "p"), (1, "en", "q"), (2, "en", "s")], "id long, lang string, word string")
    got = collocations._ranked(counted, names, spark.createDataFrame([("en", 5)], "lang string, n long"), 10).collect()
    assert [(r.phrase, r.score) for r in sorted(got, key=lambda r: r.rank)] == [("p q", 2_000_000 * (big - 1) // (2 * big)), ("p q s", 0)]
