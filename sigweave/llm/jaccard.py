"""N-gram Jaccard join by MinHash banding.

Equal texts form a class and go on as one representative. Representatives are hashed
into MinHash bands whose number and width follow from the wished recall; texts that
agree in a band are linked as candidates in a star, not in all pairs, and connected
candidates are brought together. There the full n-gram sets decide every pair, block
against block, with a count per text as the result instead of pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.common import arrow_map, id_and_text, partitions, store

GRAM_WORDS, SIMILARITY, RECALL, MAX_HASHES = 5, 0.8, 0.9999, 160
#: Texts of one block of a candidate group.
BLOCK = 1024

WORD = re.compile(r"\w+")


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """The widest bands that find a pair at ``similarity`` with probability ``recall``
    within ``hashes`` hash functions: (bands, rows)."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def shingles(text: str, size: int = GRAM_WORDS) -> np.ndarray:
    """Hashes of the distinct word n-grams of a text, in order. A text of fewer words is one
    n-gram of the words it has; a text without words has none."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_code, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ (codes[i : len(codes) - n + 1 + i])) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


_CODES: dict[str, int] = {}


def _code(word: str) -> int:
    code = _CODES.get(word)
    if code is None:
        if len(_CODES) > 500_000:
            _CODES.clear()
        code = _CODES[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return code


def _signatures(bands: int, rows: int, size: int, seed: int):
    rng = np.random.default_rng(seed)
    odd = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    mix = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                grams = shingles(text, size)
                if not len(grams):
                    found.append(None)
                    continue
                least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(grams), 256):
                    part = grams[at : at + 256]
                    least = np.minimum(least, ((odd[:, None] * part[None, :] + add[:, None]) >> np.uint64(16)).min(axis=1))
                keys = np.zeros(bands, np.uint64)
                for r in range(rows):
                    keys = (keys ^ least.reshape(bands, rows)[:, r]) * mix[r]
                    keys ^= keys >> np.uint64(31)
                found.append(keys.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "bands"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edge table (a, b), root the least node connected to it.

    Alternates between linking each node's greater neighbours to its least neighbour and
    its lesser ones likewise, until nothing changes: a logarithmic number of rounds,
    each written to the shared folder. A node of many neighbours costs a minimum per
    partition and a join, never a list.
    """
    links = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = store(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = store(small, "links")
        moved = small.exceptAll(links).limit(1).count() + links.exceptAll(small).limit(1).count()
        links = small
        if not moved:
            break
    return links.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).distinct()


def link_counts(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of n-gram sets at ``similarity`` or more; with ``right``
    None, of the pairs i < j within ``left``. Sets meet as 0/1 rows over the n-grams that
    more than one of them has, so shared sizes come from matrix products."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    kept = counts[where] > 1
    _, column = np.unique(where[kept], return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    order = np.argsort(column, kind="stable")
    rows, column = owner[kept][order], column[order]
    n = len(left)
    m = len(right) if right is not None else n
    shared = np.zeros((n, m), np.float32)
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        a = np.zeros((len(sets), min(4096, width - at)), np.float32)
        a[rows[lo:hi], column[lo:hi] - at] = 1
        shared += a[:n] @ (a[n:] if right is not None else a).T
    total = sizes[:n, None] + (sizes[n:] if right is not None else sizes)[None, :] - shared
    near = (shared > 0) & (shared >= similarity * total - 1e-6)
    i, j = np.nonzero(np.triu(near, 1) if right is None else near)
    return i, j


def _verify(size: int, similarity: float):
    """Counts of links and a spanning forest of each group, from its rows sorted by group and side."""

    def settle(group: list[tuple]) -> list[tuple]:
        left = [g for g in group if g[1] == 0]
        right = [g for g in group if g[1] == 1]
        if len(left) + len(right) < 2:
            return []
        i, j = link_counts([shingles(g[3], size) for g in left], [shingles(g[3], size) for g in right] if right else None, similarity)
        ids = [g[2] for g in left] + [g[2] for g in right]
        j = j + (len(left) if right else 0)
        n = len(ids)
        links = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        copies = np.array([g[4] for g in left] + [g[4] for g in right], np.int64)
        rows = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        root = np.arange(n)
        while True:  # least label of linked places, halving paths
            before = root.copy()
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (root == before).all():
                break
        return [(ids[k], int(links[k]), int(rows[k]), ids[root[k]]) for k in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "side", "rep", "text", "copies")), strict=True):
                if held and held[0][0] != row[0]:
                    out += settle(held)
                    held = []
                held.append(row)
            if len(out) > 1000:
                yield _links(out)
                out = []
        yield _links(out + settle(held))

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "links", "rows", "other"])


def near_duplicates(docs: DataFrame, size: int = GRAM_WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``rep_id`` (least id of its equal texts),
    ``class_id`` (least id of all texts linked to it, over any number of links),
    ``n_links`` (different texts whose word n-gram sets have Jaccard ``similarity`` or
    more with its own) and ``n_linked_rows`` (rows of those texts, and other rows of its
    own text).

    Words are runs of word characters, lower-cased. A null text is the empty text;
    texts without words are linked to equal texts only. Rows of one id and one text are
    counted as rows and share the result; an id with several texts gives one row per
    text. Null ids take no part in choosing representatives unless all are null. Other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(similarity, recall)
    plain = id_and_text(docs)
    digest = plain.select("doc_id", F.md5("text").alias("md5"))
    members = store(digest, "members")
    # One id per text: the least, and for texts of one id each its own negative number below all ids.
    texts = members.groupBy("md5").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    texts = store(texts.select("md5", "first", "copies", F.xxhash64("md5").alias("rep")), "texts")

    signed = store(arrow_map(plain.select(F.xxhash64(F.md5("text")).alias("doc_id"), "text"), _signatures(bands, rows, size, seed), "doc_id long, bands array<long>").where("bands is not null").dropDuplicates(["doc_id"]), "bands")
    places = signed.select(F.col("doc_id").alias("rep"), F.posexplode("bands").alias("band", "value")).select("rep", F.xxhash64("band", "value").alias("key"))
    meeting = places.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key", "low")
    edges = places.join(meeting, "key").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    groups = store(components(edges).select(F.col("node").alias("rep"), "root"), "candidates")

    # The text of each representative, once. Group by group, large groups in blocks of similar set sizes.
    once = plain.select("doc_id", "text", F.md5("text").alias("md5"))
    chosen = texts.join(groups, "rep").select("md5", "first", "rep", "copies", "root")
    brought = once.join(chosen, "md5").where(F.col("doc_id").eqNullSafe(F.col("first"))).dropDuplicates(["md5"])
    brought = brought.select("rep", "root", "copies", "text", F.size(F.split("text", r"\W+")).alias("n_words"))
    totals = groups.groupBy("root").agg(F.count("*").alias("members"))
    sized = brought.join(totals, "root")
    blocks = F.ceil(F.col("members") / block).cast("int")
    sized = sized.withColumn("of", blocks).withColumn("mine", F.pmod(F.xxhash64("rep", F.lit(seed)), F.col("of")).cast("int"))
    # Every pair of blocks is one cell; a text goes to the cells of its own block.
    cells = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda o: F.struct(
        F.xxhash64("root", F.least(o, F.col("mine")), F.greatest(o, F.col("mine"))).alias("cell"), F.when(o < F.col("mine"), 1).otherwise(0).alias("side")))
    dealt = sized.select("rep", "copies", "text", F.explode(cells).alias("c")).select("c.cell", "c.side", "rep", "text", "copies")
    n = partitions(spark)
    found = arrow_map(dealt.repartition(n, "cell").sortWithinPartitions("cell", "side", "rep"), _verify(size, similarity), "rep long, links long, rows long, other long")
    found = store(found, "links-found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("rows").alias("linked"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("rep"), "root")
    named = linked.join(texts.select("rep", "first"), "rep")
    heads = named.groupBy("root").agg(F.min("first").alias("class_id"))
    classes = named.join(heads, "root").select("rep", "class_id")
    table = texts.join(counts, "rep", "left").join(classes, "rep", "left").select(
        "md5", F.col("first").alias("rep_id"), F.coalesce("class_id", "first").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_linked_rows"))
    return members.join(table, "md5").select("doc_id", "rep_id", "class_id", "n_links", "n_linked_rows")
