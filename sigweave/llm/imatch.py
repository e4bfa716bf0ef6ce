"""I-Match fingerprints: terms within a band of document frequency form the lexicon, and
a text's distinct lexicon terms, sorted, are hashed once whole and once for each of
several randomised subsets of the lexicon. Small subsets survive small edits, so the
share of equal hashes says how alike two texts are. Frequencies count distinct texts, so
copies do not put their own terms out of the band.

All terms of a text are hashed likewise, in places of their own behind those of the
lexicon. Two texts are compared by the lexicon if both have enough terms in it, else by
all terms: always like with like.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sigweave.llm.common import arrow_map, id_and_text, partitions, store
from sigweave.llm.counting import count_keys

#: Lexicon terms stand in at least and at most this share of distinct texts. The lower bound
#: also bounds the lexicon: a text's distinct terms on average, divided by it.
LEAST, MOST = 2e-4, 0.1
#: Share of the lexicon in each subset; the first is the lexicon itself.
RATES = (1.0, *([1 / 8] * 5), *([1 / 32] * 8), *([1 / 128] * 9), *([1 / 512] * 9))
#: If either of two texts has fewer lexicon terms, they are compared by all terms.
FEWEST = 4
REMEMBERED = 500_000
BUCKETS = 256


def term_code(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _codes(known: dict[str, int], terms: set[str]) -> np.ndarray:
    if len(known) > REMEMBERED:
        known.clear()
    for t in terms.difference(known):
        known[t] = term_code(t)
    return np.sort(np.array([known[t] for t in terms], np.uint64))


def subsets(codes: np.ndarray) -> np.ndarray:
    """Which subsets hold each term: codes x subsets, by a keyed hash of the term."""
    mixed = codes[:, None] ^ (np.arange(1, len(RATES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53) < np.array(RATES)[None, :]


class Terms:
    """Codes of terms and the subsets that hold each, remembered by term."""

    def __init__(self) -> None:
        self.slots: dict[str, int] = {}
        self.codes, self.held = np.zeros(1 << 12, np.uint64), np.zeros((1 << 12, len(RATES)), bool)

    def read(self, terms: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted codes of the terms, and codes x subsets."""
        if len(self.slots) > REMEMBERED:
            self.slots.clear()
        new = list(terms.difference(self.slots))
        if new:
            first, last = len(self.slots), len(self.slots) + len(new)
            if last > len(self.codes):
                more = max(last, 2 * len(self.codes)) - len(self.codes)
                self.codes, self.held = np.pad(self.codes, (0, more)), np.pad(self.held, ((0, more), (0, 0)))
            self.codes[first:last] = [term_code(t) for t in new]
            self.held[first:last] = subsets(self.codes[first:last])
            self.slots.update(zip(new, range(first, last), strict=True))
        slots = np.fromiter(map(self.slots.__getitem__, terms), np.int64, len(terms))
        slots = slots[np.argsort(self.codes[slots])]
        return self.codes[slots], self.held[slots]


def _hashes(codes: np.ndarray, held: np.ndarray) -> list[str]:
    rows = codes[np.nonzero(held.T)[1]].tobytes()  # subset after subset
    ends = np.cumsum(held.sum(axis=0) * codes.itemsize).tolist()
    return [hashlib.blake2b(rows[s:e], digest_size=4).hexdigest() if s < e else "-" for s, e in zip([0, *ends], ends)]


def fingerprint(codes: np.ndarray, lexicon: np.ndarray, held: np.ndarray | None = None) -> tuple[list[str], int]:
    """One hash per subset of the sorted distinct term codes, "-" where the subset has no
    term: first of those in the lexicon, then of all. With the number of lexicon terms."""
    held = subsets(codes) if held is None else held
    at = np.minimum(np.searchsorted(lexicon, codes), max(0, len(lexicon) - 1))
    banded = lexicon[at] == codes if len(lexicon) and len(codes) else np.zeros(len(codes), bool)
    return _hashes(codes[banded], held[banded]) + _hashes(codes, held), int(banded.sum())


def likeness(a: tuple[list[str], int], b: tuple[list[str], int]) -> float:
    """Share of equal hashes among the subsets that either text has terms in; texts
    without any term are alike."""
    n = len(RATES)
    part = slice(0, n) if min(a[1], b[1]) >= FEWEST else slice(n, 2 * n)
    told = [(x, y) for x, y in zip(a[0][part], b[0][part], strict=True) if x != "-" or y != "-"]
    return sum(x == y for x, y in told) / len(told) if told else 1.0


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Sorted codes of the terms within the frequency band, counted over all distinct texts."""
    known: dict[str, int] = {}

    def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        codes = np.concatenate([_codes(known, set(t.lower().split())) for t in batch.column("text").to_pylist()] or [np.zeros(0, np.uint64)])
        keys, counts = np.unique(codes, return_counts=True)
        yield keys, counts.astype(np.int64)

    rows = id_and_text(docs).select("text", F.xxhash64("text").alias("_x"), F.hash("text").alias("_y"))
    # Only texts that have copies need an exchange.
    copied = store(rows.groupBy("_x", "_y").count().where(F.col("count") > 1), "copied")
    firsts = rows.join(copied, ["_x", "_y"], "left_semi").groupBy("_x", "_y").agg(F.first("text").alias("text"))
    distinct = rows.join(copied, ["_x", "_y"], "left_anti").select("text").unionByName(firsts.select("text"))
    counted = count_keys(distinct, found, lambda k: (k >> np.uint64(56)).astype(np.int32), "terms")
    extra = copied.agg(F.sum(F.col("count") - 1)).first()[0] or 0
    n = docs.count() - extra

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                c = np.frombuffer(counts, "<i8")
                kept.append(np.frombuffer(keys, "<u8")[(c >= least * n) & (c <= max(1.0, most * n))].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], ["keys"])

    rows = arrow_map(counted.select("keys", "counts"), within, "keys binary").toArrow().to_pylist()
    return np.sort(np.frombuffer(b"".join(r["keys"] for r in rows), "<u8"))


PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


def _range_of(cuts: list[int]) -> Callable[[Column], Column]:
    """Number of the range of an order value: how many cuts lie below it."""
    below = np.array(cuts, np.int64)
    return arrow_udf(lambda o: pa.array(np.searchsorted(below, o.to_numpy()).astype(np.int32)), "int")


def _sent(tops: dict[int, int], ranges: int) -> Callable[[Column, Column], Column]:
    """Where a row goes: to its range, and a range's first row also to the tail of the range
    of the next higher ids, whose last row it follows; the very first to that of the lowest."""
    order = sorted(tops, reverse=True)
    top, wants = np.full(ranges, np.iinfo(np.int64).max), np.full(ranges, -1)
    for i, r in enumerate(order):
        top[r], wants[r] = tops[r], order[i - 1]

    def places(at: pa.Array, o: pa.Array) -> pa.Array:
        at, first = at.to_numpy(), o.to_numpy() == top[at.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(1 + first)]).astype(np.int32)
        into, tail = np.empty(ends[-1], np.int32), np.zeros(ends[-1], np.int32)
        into[ends[:-1]] = at
        into[ends[1:][first] - 1], tail[ends[1:][first] - 1] = wants[at[first]], 1
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(into), pa.array(tail)], ["range", "tail"]))

    return arrow_udf(places, "array<struct<range:int,tail:int>>")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` of every row. The edited text has its last half replaced by the start of
    the next row's in descending id order (after the last row, the first's).

    A null text is empty; texts without terms have empty subsets only and are alike.
    Rows of one id follow one another in text-hash order; null ids come last. With one
    row the next row is itself. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    terms = lexicon(docs)
    shared = spark.sparkContext.broadcast(terms)
    plain = id_and_text(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"))
    # Ranges of ids, and the first row of each: it also closes the range before it.
    n = partitions(spark) * 2
    cuts = [] if plain.isEmpty() else plain.agg(F.percentile_approx("o", [i / n for i in range(1, n)], 10_000)).first()[0]
    cuts = sorted(set(cuts))
    ranged = plain.withColumn("range", _range_of(cuts)(F.col("o")))
    tops = {r["range"]: r["top"] for r in ranged.groupBy("range").agg(F.max("o").alias("top")).collect()}
    ranged = ranged.withColumn("sent", _sent(tops, len(cuts) + 1)(F.col("range"), F.col("o")))
    dealt = ranged.select("doc_id", "o", "text", F.explode("sent").alias("s")).select("doc_id", "o", "text", "s.range", "s.tail")
    sorted_rows = dealt.repartition(n, "range").sortWithinPartitions("range", "tail", F.desc("o"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, lex = Terms(), shared.value

        def read(text: str) -> tuple[list[str], int]:
            codes, held = terms.read(set(text.lower().split()))
            return fingerprint(codes, lex, held)

        held = None
        for batch in batches:
            out = []
            for doc, text, rng, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "tail")), strict=True):
                if held is not None and (held[2] != rng or held[3]):
                    held = None  # what followed a range's end is used already
                if tail and held is None:
                    continue
                own = read(text)
                if held is not None:
                    before = edited(held[1], text)
                    theirs = held[4]
                    changed = theirs if before == held[1] else read(before)
                    out.append((held[0], len(held[1]), hashlib.sha256(before.encode("utf-8", "surrogatepass")).hexdigest(), " ".join(theirs[0]), " ".join(changed[0]), likeness(theirs, changed), likeness(theirs, own)))
                held = None if tail else (doc, text, rng, tail, own)
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [f.split()[0] for f in PRINTS.split(", ")])

    return arrow_map(sorted_rows.select("doc_id", "text", "range", "tail"), run, PRINTS)
