"""Repeated byte strings whose grams stand in many documents."""

import random
from collections import Counter

from sigweave.llm import suffixes


def _spread_passages():
    """400 documents share a passage and, too short to be removed, a boilerplate; all else differs."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage, short = letters(300), letters(150)
    return [(i, letters(250) + passage + letters(120) + short + letters(200)) for i in range(400)]


def _expected(texts):
    raws = [t.encode() for _, t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = {}
    for (doc, _), r in zip(texts, raws, strict=True):
        gone = [False] * len(r)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        out[doc] = bytes(b for b, g in zip(r, gone, strict=True) if not g)
    return out


def test_no_task_holds_a_gram_of_many_surroundings(spark, monkeypatch):
    made = suffixes._settle_rows

    def bounded(window):
        inner = made(window)

        def run(batches):
            held = []
            for batch in batches:
                held.append(batch)
            sizes = {}
            for batch in held:
                for h in batch.column("h").to_pylist():
                    sizes[h] = sizes.get(h, 0) + 1
            assert max(sizes.values(), default=0) <= 256, "a gram's surroundings all meet in one task"
            yield from inner(iter(held))

        return run

    monkeypatch.setattr(suffixes, "_settle_rows", bounded)
    texts = _spread_passages()
    got = suffixes.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", "kept").collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == _expected(texts)


def test_rows_follow_surroundings_not_their_windows(spark, monkeypatch):
    """Groups too large for a task are dealt in a few parts a member, in rounds (16 members here)."""
    rows, stored = {}, suffixes.store

    def counted(df, name):
        out = stored(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(suffixes, "store", counted)
    texts = _spread_passages()
    got = suffixes.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), many=16).select("doc_id", "kept").collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == _expected(texts)
    assert max(rows.values()) <= 4 * rows["surroundings"]


def test_parts_find_the_windows_of_the_whole(spark):
    """Overlapping copies of a text with edits: every range down to single windows gives what brute force gives."""
    rng = random.Random(9)
    base = "".join(rng.choices("abcdef", k=700))
    texts = []
    for i in range(60):
        chars = list(base[rng.randrange(0, 200) : rng.randrange(450, 700)])
        for _ in range(rng.randrange(0, 3)):
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
        texts.append((i, "".join(chars)))
    got = suffixes.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), many=1).select("doc_id", "kept").collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == _expected(texts)
