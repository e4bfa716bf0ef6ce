"""Likeness of texts whose copies are a large part of the rows."""

import hashlib
import random

import pytest

from sigweave.llm import imatch


def test_edited_copies_stay_alike(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    common = [word() for _ in range(60)]
    copied = " ".join(common)
    texts = [" ".join(word() for _ in range(60)) for _ in range(200)] + [copied] * 100
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {r["doc_id"]: r["near_edited"] for r in imatch.fingerprints(docs).select("doc_id", "near_edited").collect()}
    following = [i for i in range(1, len(texts)) if texts[i] == copied and texts[i - 1] != copied]
    # Half of such a text is its own still; it was compared by terms it had lost.
    assert len(following) > 20 and sum(near[i] for i in following) / len(following) > 0.04


def test_like_is_compared_with_like():
    codes = imatch._codes({}, {f"t{i}" for i in range(40)})
    # Three lexicon terms against four: the rest of both texts is the same.
    few, more = imatch.fingerprint(codes[:39], codes[36:]), imatch.fingerprint(codes, codes[36:])
    assert (few[1], more[1]) == (3, 4)
    assert imatch.likeness(few, more) > 0.5


@pytest.mark.parametrize("partitions,ids", [("2000", "some"), ("3", "some"), ("200", "null"), ("7", "one")])
def test_contract_columns_at_any_number_of_partitions(spark, partitions, ids):
    texts = [None, "", "a", "é漢🙂 x", "one two three " * 40] + [f"text number {i} of the lot " * (i % 7) for i in range(60)]
    rows = [(i * 3 - 20 if ids == "some" else None, t) for i, t in enumerate(texts)][: 1 if ids == "one" else None]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    if ids == "null":
        assert sorted(r.n_chars for r in got) == sorted(len(t or "") for t in texts)
        return
    down = sorted(rows, reverse=True)
    want = {}
    for (i, t), (_, following) in zip(down, down[1:] + down[:1], strict=True):
        t, following = t or "", following or ""
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        want[i] = (len(t), hashlib.sha256(new.encode()).hexdigest())
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
