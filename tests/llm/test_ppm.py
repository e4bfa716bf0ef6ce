"""Trie scores against a plain reading of the method."""

import math
import random
from collections import Counter, defaultdict

import pytest

from sigweave.llm import ppm


def plain_scores(train, texts, order):
    seen = defaultdict(Counter)
    for t in train:
        raw = b"\n" * order + ppm.canonical(t)[1]
        for at in range(order, len(raw)):
            for k in range(order + 1):
                seen[raw[at - k : at]][raw[at]] += 1
    out = []
    for t in texts:
        raw, total = b"\n" * order + ppm.canonical(t)[1], 0.0
        for at in range(order, len(raw)):
            taken = set()
            for k in range(order, -1, -1):
                after = {s: n for s, n in seen.get(raw[at - k : at], {}).items() if s not in taken}
                if not seen.get(raw[at - k : at]):
                    continue
                whole = sum(after.values()) + len(after)
                if raw[at] in after:
                    total += math.log10(after[raw[at]] / whole)
                    break
                total += math.log10(len(after) / whole) if after else 0.0
                taken |= after.keys()
            else:
                total -= math.log10(ppm.SYMBOLS - len(taken))
        out.append(total)
    return out


@pytest.mark.parametrize("order,chunk,per_copy", [(5, 6_000_000, 8_192), (3, 300, 2)])
def test_scores_equal_a_plain_reading(spark, monkeypatch, order, chunk, per_copy):
    rng = random.Random(4)
    words = ["alpha", "beta", "alphabet", "Größe", "漢字", "bet", "a"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(60)] + [(60, None), (61, "zz qq!"), (62, "alpha " * 200)]
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    monkeypatch.setattr(ppm, "CHUNKS_PER_COPY", per_copy)
    got = {r.doc_id: r for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order=order).collect()}
    assert len(got) == len(rows)
    train = [t or "" for i, t in rows if not got[i].held_out]
    want = plain_scores(train, [t or "" for _, t in rows], order)
    for (i, _), w in zip(rows, want, strict=True):
        assert got[i].score == pytest.approx(w, rel=1e-5, abs=1e-5)


def test_without_training_rows_every_symbol_is_alike(spark):
    held = [i for i in range(100) if __import__("zlib").crc32(str(i).encode()) % 10 == 0]
    got = ppm.score(spark.createDataFrame([(i, "abc") for i in held], "doc_id long, text string")).collect()
    assert got and all(r.score == pytest.approx(-4 * math.log10(ppm.SYMBOLS), rel=1e-6) for r in got)
