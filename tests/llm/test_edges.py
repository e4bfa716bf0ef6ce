"""Odd rows, empty tables and clashing columns through every operator."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sigweave.llm import imatch, jaccard, lines, packing, pieces, ppm, queries, sharding, suffixes, topk, toxicity

LONG = "a long line of many words that says the same thing twice and then a third time over again " * 300
ROWS = [(0, None), (1, ""), (2, " \n\n "), (3, "one"), (3, "one"), (4, LONG), (5, LONG), (6, "Größe 漢字 🙂\tx\n" * 3), (7, "same words here for all of us\n"), (None, "no id"), (8, None)]
SCHEMA = "doc_id long, text string, n_removed string, kept string, key string, ids string, score string, class_id string"


@pytest.fixture(scope="module")
def tables(spark):
    odd = spark.createDataFrame([(*r, *"abcdef") for r in ROWS], SCHEMA)
    return {"odd": odd, "empty": odd.limit(0)}


RUNS = {
    "pack": lambda d: packing.pack(d, queries.tokenizer_path("byte_bpe_50k.json")),
    "jaccard": jaccard.near_duplicates,
    "imatch": imatch.fingerprints,
    "ppm": ppm.score,
    "suffixes": suffixes.remove_repeats,
    "lines": lines.remove_lines,
    "pieces": lambda d: pieces.encode(d, queries.tokenizer_path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_for_each_row(tables, name):
    got = RUNS[name](tables["odd"]).select("doc_id").toPandas()["doc_id"]
    want = sorted(-1 if i is None else i for i, _ in ROWS)
    found = sorted(got.fillna(-1).astype(int).tolist())
    assert (sorted(set(found)) == sorted(set(want))) if name == "pack" else found == want


@pytest.mark.parametrize("name", RUNS)
def test_empty_table_gives_no_rows(tables, name):
    assert RUNS[name](tables["empty"]).count() == 0


def test_packs_hold_every_id_once(tables):
    got = RUNS["pack"](tables["odd"]).toPandas()
    assert got[got.start == 0].groupby("doc_id", dropna=False).doc_tokens.first().notna().all()
    assert got.length.sum() == got[got.start == 0].doc_tokens.sum()
    for _, s in got.groupby("sequence_id"):
        s, size = s.sort_values("offset"), s.length.sum()
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist()
        assert size == 2048 or size & (size - 1) == 0


def test_equal_texts_share_a_class_and_copies_count(tables):
    got = jaccard.near_duplicates(tables["odd"]).where("doc_id in (4, 5)").toPandas()
    assert got.class_id.tolist() == [4, 4] and got.n_linked_rows.tolist() == [1, 1]


def test_removed_bytes_equal_brute_force(tables):
    raws = [(i, (t or "").encode()) for i, t in ROWS]
    seen = {}
    for _, raw in raws:
        for at in range(len(raw) - 199):
            seen[raw[at : at + 200]] = seen.get(raw[at : at + 200], 0) + 1
    want = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for at in range(len(raw) - 199):
            if seen[raw[at : at + 200]] > 1:
                gone[at : at + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want.append((-1 if i is None else i, sum(gone), hashlib.sha256(kept).hexdigest()))
    got = suffixes.remove_repeats(tables["odd"]).select("doc_id", "n_removed", F.sha2("kept", 256).alias("h")).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in got) == sorted(want)


def test_pieces_decode_to_the_text(tables):
    assert RUNS["pieces"](tables["odd"]).where("NOT lossless").count() == 0


def test_shards_are_gapless(spark, tables):
    for name, rows in (("odd", len(ROWS)), ("empty", 0)):
        got = sharding.shard(tables[name], shards=4).select("shard", "slot").toPandas()
        assert len(got) == rows
        counts = [sorted(got[got.shard == s].slot.tolist()) for s in range(4)]
        assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1


def test_top_k_skips_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, None), (3, [float("nan"), 1.0]), (50, [0.5, 0.5]), (51, [1.0, None]), (52, [1.0, 0.5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()]
    v = {i: [int(256 * x) for x in e] for i, e in rows if i in (0, 1, 50, 52)}
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_toxicity_learns_words_and_their_misspellings(spark):
    rows = [(i, ("you are a stupid fool " if i % 2 else "what a lovely day it is ") + str(zlib.crc32(b"%d" % i))) for i in range(200)]
    docs = spark.createDataFrame(rows + [(None, None), (900, ""), (901, "you stuppid fooll"), (902, "lovely lovelly day")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, *toxicity.fit(docs, labels)).collect()}
    assert got[901] > 0.5 > got[902] and 0 <= got[900] <= 1 and got[900] == got[None]
    kept = toxicity.score(docs, *toxicity.fit(docs, labels.limit(0)), keep=True)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 204
