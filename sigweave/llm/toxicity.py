"""Toxicity by subword bags: a word is the mean vector of its hashed character n-grams,
a text the mean of its words, and a softmax over two classes reads that mean. Vectors
and softmax are trained together in NumPy, in one task. A misspelling shares most of its n-grams
with the word it comes from, so it scores like it without having been seen.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.common import arrow_map, id_and_text, id_remainder, text_of

#: Hashed n-gram vectors, their width, lengths of the n-grams.
BUCKETS, WIDTH, SHORTEST, LONGEST = 1 << 17, 8, 3, 5
#: Means are small numbers; this factor brings them into the range the softmax learns in.
GAIN = 200.0
#: Labelled rows of each class that training reads at most.
SAMPLE = 2_000
#: Sampled texts an n-gram must occur in to get a vector; rarer ones count as zero.
LEAST_TEXTS = 10
EPOCHS, BATCH, RATE = 10, 64, 0.4
REMEMBERED = 300_000

WORD = re.compile(r"\w+")


def grams(word: str) -> list[int]:
    """Buckets of a word: the word itself and its character n-grams, ends marked."""
    marked = f"<{word}>"
    raw = [marked] + [marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1) if n < len(marked)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in raw]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share of each in the mean over words of the means over
    n-grams. The mean is linear in the vectors, so this is all that training needs."""
    counts = Counter(WORD.findall(text.lower()))
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    lists = [grams(w) for w in counts]
    sizes = np.array([len(g) for g in lists])
    shares = np.repeat(np.array(list(counts.values())) / counts.total() / sizes, sizes)
    buckets, place = np.unique(np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), return_inverse=True)
    return buckets, np.bincount(place, shares).astype(np.float32)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [bag(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array([b.tobytes() for b, _ in bags], pa.binary()), pa.array([s.tobytes() for _, s in bags], pa.binary())],
            ["doc_id", "toxic", "buckets", "shares"])


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, least: int = LEAST_TEXTS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Log-odds of each bucket and the bias. Two classes make the softmax read only the
    difference of its columns, so that is what remains of it after training."""
    rng = np.random.default_rng(seed)
    texts_with = np.zeros(BUCKETS, np.int64)
    for buckets, _ in bags:
        texts_with[buckets] += 1
    learnt = texts_with >= least
    docs = [(b[learnt[b]], s[learnt[b]] * GAIN) for b, s in bags]
    vectors = rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    soft = rng.uniform(-1, 1, (WIDTH, 2)) / WIDTH
    bias = np.zeros(2)
    seen = [np.full(x.shape, 1e-3) for x in (vectors, soft, bias)]
    usable = np.array([i for i, (b, _) in enumerate(docs) if len(b)], np.int64)
    batches = max(1, math.ceil(len(usable) / BATCH))
    for epoch in range(EPOCHS):
        for number, take in enumerate(np.array_split(rng.permutation(usable), batches)):
            if not len(take):
                continue
            rate = RATE * (1 - (epoch * batches + number) / (EPOCHS * batches))
            rows = np.concatenate([docs[i][0] for i in take])
            shares = np.concatenate([docs[i][1] for i in take])
            sizes = np.array([len(docs[i][0]) for i in take])
            owner = np.repeat(np.arange(len(take)), sizes)
            text = np.add.reduceat(vectors[rows] * shares[:, None], np.cumsum(sizes) - sizes)
            logits = text @ soft + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            slope = chance / chance.sum(axis=1, keepdims=True)
            slope[np.arange(len(take)), labels[take]] -= 1
            slope *= weights[take][:, None] / len(take)
            back = slope @ soft.T
            touched, spot = np.unique(rows, return_inverse=True)
            pull = np.stack([np.bincount(spot, back[owner, d] * shares, len(touched)) for d in range(WIDTH)], axis=1)
            for value, memory, place, step in (
                (vectors, seen[0], touched, pull), (soft, seen[1], slice(None), text.T @ slope), (bias, seen[2], slice(None), slope.sum(axis=0))):
                memory[place] += step**2
                value[place] -= rate * step / np.sqrt(memory[place])
    return np.where(learnt, (vectors @ (soft[:, 1] - soft[:, 0])) * GAIN, 0.0), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: int = 2, modulus: int = 4, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on labelled rows outside the held-out fold. At most ``sample`` rows of each
    class are read, those of the smallest id hash, and weighted back to the class sizes.
    Rows of no id or of another label than 0 and 1 teach nothing; of repeated ids one text
    counts. With fewer than two classes the score is the share of the class there is."""
    known = (
        labels.where(labels["doc_id"].isNotNull() & labels[label].isin(0, 1)).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("toxic"))
        .where(id_remainder(F.col("doc_id"), modulus) != held_out)
    )
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    ranked = known.withColumn("_o", F.xxhash64("doc_id"))
    chosen = ranked.where("toxic = 0").orderBy("_o", "doc_id").limit(sample).unionByName(ranked.where("toxic = 1").orderBy("_o", "doc_id").limit(sample))
    # Two ids per sampled row: at most 2 x sample rows.
    texts = id_and_text(docs).join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    bags = arrow_map(texts, _bags, "doc_id long, toxic int, buckets binary, shares binary")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: (r["doc_id"], r["buckets"], r["shares"]))
        rows = [r for i, r in enumerate(rows) if not i or rows[i - 1]["doc_id"] != r["doc_id"]]
        y = np.array([r["toxic"] for r in rows], np.int64)
        if len(set(y.tolist())) < 2:
            return
        weight = np.array([sizes[k] / max(1, int((y == k).sum())) for k in (0, 1)])[y]
        bags = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows]
        odds, bias = train(bags, y, weight / weight.mean(), min(LEAST_TEXTS, max(1, len(bags) // 50)))
        yield pa.RecordBatch.from_arrays([pa.array([odds.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["odds", "bias"])

    # The sample is bounded, so one task holds it; the driver gets BUCKETS numbers.
    model = bags.repartition(1).mapInArrow(learn, "odds binary, bias double").first()
    if model is None:
        # One class or none: the prior is all there is to learn.
        total, ones = sum(sizes.values()), sizes.get(1, 0)
        return np.zeros(BUCKETS), math.log((ones + 0.5) / (total - ones + 0.5))
    return np.frombuffer(model["odds"]), model["bias"]


_WORDS: dict[str, dict[str, float]] = {}


def score(docs: DataFrame, odds: np.ndarray, bias: float, keep: bool = False) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row. A text without words, or a null one,
    gets the score of the bias alone; equal texts get equal scores. Only ``doc_id`` and
    ``text`` are read; ``doc_id`` is handed through. With ``keep`` all columns of ``docs``
    come along unchanged beside ``score``, which replaces a column of that name."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(odds.astype(np.float32))  # BUCKETS numbers
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        if key not in _WORDS:
            _WORDS.clear()
        known = _WORDS.setdefault(key, {})
        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            out = []
            for text in batch.column("text").to_pylist():
                words = WORD.findall(text.lower())
                for w in set(words).difference(known):
                    known[w] = float(weights[grams(w)].mean())
                z = math.fsum(map(known.__getitem__, words)) / max(1, len(words)) + bias
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.float64())], [*names, "score"])

    if not keep:
        return arrow_map(id_and_text(docs), run, "doc_id long, score double")
    kept = F.struct(*[c for c in docs.columns if c.lower() != "score"]).alias("kept")
    rows = docs.select(kept, text_of(docs))
    return arrow_map(rows, run, f"kept {rows.schema['kept'].dataType.simpleString()}, score double").select("kept.*", "score")
