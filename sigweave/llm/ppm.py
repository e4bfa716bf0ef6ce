"""Language-model scores by prediction by partial matching over bytes.

Training counts every byte after its last ``ORDER`` bytes, over all training texts. The
counts become a context trie: a node per context, with the bytes seen after it. A byte
is coded in the longest known context; if it was not seen there, the code escapes to
the next shorter one, where the bytes of the longer context are excluded. Bytes seen
after a context were also seen after its shorter ones, so what is excluded depends on
the one longer context only, and each node's escape and total after exclusion are
known when the trie is built.

The trie holds every context of the training texts, so it grows with them and lives in no
one place: it is dealt out by the two bytes before the symbol, which fix all contexts of
two bytes and more; the two shortest levels, at most 65,536 pairs of bytes, go to all.
Texts are scored in chunks. A chunk asks each part of the trie for its distinct windows,
once each, and adds up the answers along its texts.

A text's symbols are its words, A-Z lowered, one space between two words, and an end.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.common import arrow_map, id_remainder, partitions, store, text_of
from sigweave.llm.counting import count_keys, merge

ORDER = 5
#: Bytes a canonical text can hold: all but tab, vertical tab, form feed and return; the
#: line feed is the end.
SYMBOLS = 252
#: Words that make up this share of the training tokens are sent to all tasks, at most
#: 1 / WORD_SHARE; the others are joined.
WORD_SHARE = 1e-7
REMEMBERED = 400_000
#: Bytes of text that ask for their windows together.
CHUNK = 6_000_000
#: Chunks that ask one copy of a part of the trie. More chunks, more copies of it.
CHUNKS_PER_COPY = 8_192


def canonical(text: str) -> tuple[list[bytes], bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return words, b" ".join(words) + b"\n"


def windows(streams: list[bytes], order: int = ORDER) -> np.ndarray:
    """Each symbol with the ``order`` symbols before it, as one number; a text starts after ends."""
    pad = b"\n" * order
    raw = np.frombuffer(b"".join([pad + s for s in streams]), np.uint8).astype(np.uint64)
    if not len(raw):
        return raw
    out = np.zeros(len(raw) - order, np.uint64)
    for i in range(order + 1):
        out |= raw[i : len(raw) - order + i] << np.uint64(8 * (order - i))
    sizes = np.array([len(s) for s in streams])
    starts = np.concatenate([[0], np.cumsum(sizes + order)[:-1]])
    own = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return out[own]


class Lookup:
    """Places of 64-bit keys in a sorted array, through an open hash table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not held."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[out[wrong]] != keys[wrong])]
        return out


class Trie:
    """Levels of (context + symbol) keys and counts, level k + 1 for contexts of k bytes."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = levels
        self.order = len(levels) - 1
        self.grams = [Lookup(k) for k, _ in levels]
        self.logs = [np.log10(c.astype(np.float64)) for _, c in levels]
        self.contexts: list[Lookup] = []
        self.top_total: list[np.ndarray] = []
        self.top_escape: list[np.ndarray] = []
        self.low_total: list[np.ndarray] = []
        self.low_escape: list[np.ndarray] = []
        self.kinds0 = len(levels[0][0]) if levels else 0
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        for k, (keys, counts) in enumerate(levels):
            names, first = np.unique(keys >> np.uint64(8), return_index=True) if len(keys) else (keys, np.zeros(0, np.int64))
            total = np.add.reduceat(counts, first).astype(np.float64) if len(keys) else np.zeros(0)
            kinds = np.diff(np.append(first, len(keys))).astype(np.float64)
            self.contexts.append(Lookup(names))
            self.top_total.append(np.log10(total + kinds))
            self.top_escape.append(np.log10(kinds / (total + kinds)))
            sums.append((total, kinds))
            if not k:
                self.low_total.append(np.zeros(0))
                self.low_escape.append(np.zeros(0))
                continue
            # The shorter context, and how much of it the symbols of this one take away.
            short = self.contexts[k - 1].find(names & np.uint64((1 << 8 * (k - 1)) - 1))
            below = levels[k - 1][1][self.grams[k - 1].find(keys & np.uint64((1 << 8 * k) - 1))]
            taken = np.add.reduceat(below, first).astype(np.float64) if len(keys) else np.zeros(0)
            rest, left = sums[k - 1][0][short] - taken, sums[k - 1][1][short] - kinds
            whole = np.maximum(rest + left, 1e-300)
            self.low_total.append(np.log10(whole))
            self.low_escape.append(np.where(left > 0, np.log10(np.maximum(left, 1) / whole), 0.0))

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        came = np.full(len(keys), -1, np.int64)  # the longer context the code escaped from
        for k in range(self.order, -1, -1):
            window = keys[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            gram = self.grams[k].find(window)
            node = self.contexts[k].find(window >> np.uint64(8))
            known, after = node >= 0, came >= 0
            hit, miss = gram >= 0, (gram < 0) & known
            if k < self.order:
                a = hit & after
                out[left[a]] += self.logs[k][gram[a]] - self.low_total[k + 1][came[a]]
                a = miss & after
                out[left[a]] += self.low_escape[k + 1][came[a]]
            a = hit & ~after
            out[left[a]] += self.logs[k][gram[a]] - self.top_total[k][node[a]]
            a = miss & ~after
            out[left[a]] += self.top_escape[k][node[a]]
            came = np.where(known, node, -1)[~hit]
            left = left[~hit]
        out[left] -= math.log10(max(1, SYMBOLS - self.kinds0))
        return out


def _train_grams(order: int):
    def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, counts = np.unique(windows([canonical(t)[1] for t in batch.column("text").to_pylist()], order), return_counts=True)
        yield keys, counts.astype(np.int64)

    return found


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.update(canonical(text)[0])
            held[b"\n"] += 1  # the end; no word holds a line feed
        if len(held) > 300_000:
            yield out(held)
            held = Counter()
    yield out(held)


def part_of(windows_: np.ndarray) -> np.ndarray:
    """The part of the trie that knows a window: by the two bytes before its symbol."""
    return ((((windows_ >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int32)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            k, c = merge(np.frombuffer(keys, "<u8") & np.uint64(0xFFFF), np.frombuffer(counts, "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(c)], ["pair", "n"])


Level = tuple[np.ndarray, np.ndarray]


def short_levels(counted: DataFrame) -> list[Level]:
    """The levels of no and of one byte of context: at most 65,536 pairs of bytes."""
    found = arrow_map(counted, _pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    k, c = merge(found.column("pair").to_numpy().astype(np.uint64), found.column("n").to_numpy().astype(np.int64))
    return [merge(k & np.uint64(0xFF), c), (k, c)]


def part_trie(short: list[Level], keys: np.ndarray, counts: np.ndarray, order: int) -> Trie:
    """The trie of the windows of one part; ``short`` counts those of all parts."""
    return Trie([*short, *(merge(keys & np.uint64((1 << 8 * (level + 1)) - 1), counts) for level in range(2, order + 1))])


def _squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys as steps, equal places of the bytes together: mostly zeros, which compress well."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unsqueeze(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _by_part(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of distinct windows, and the order that puts the windows of each part together."""
    parts = part_of(found)
    return parts, np.argsort(parts, kind="stable")


def _questions(chunk: int, streams: list[bytes], order: int) -> Iterator[tuple[int, int, bytes]]:
    found = np.unique(windows(streams, order))
    parts, together = _by_part(found)
    found, parts = found[together], parts[together]
    starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
    for s, e in zip(starts, [*starts[1:], len(parts)], strict=True):
        yield chunk, int(parts[s]), _squeeze(found[s:e])


def _answers(short: list[Level], order: int):
    """Scores of the windows asked for, from rows sorted by part, the part's counts first."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, None
        for batch in batches:
            out: list[tuple] = []
            for part, copy, chunk, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "copy", "chunk", "keys", "counts")), strict=True):
                if counts is not None:
                    now, trie = (part, copy), part_trie(short, np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8"), order)
                    continue
                if now != (part, copy):  # a part that no training text reached
                    now, trie = (part, copy), part_trie(short, *none, order)
                out.append((chunk, part, trie.score(_unsqueeze(keys)).astype("<f4").tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["chunk", "bucket", "scores"])

    return run


def _sums(order: int):
    """Scores of texts, from rows sorted by chunk, the chunk's answers by part before its texts."""

    def settle(answers: list[bytes], rows: list[int], streams: list[bytes]) -> pa.RecordBatch:
        each = np.zeros(0)
        if streams:
            found, place = np.unique(windows(streams, order), return_inverse=True)
            score = np.zeros(len(found))
            score[_by_part(found)[1]] = np.frombuffer(b"".join(answers), "<f4")
            each = np.add.reduceat(score[place], np.concatenate([[0], np.cumsum([len(s) for s in streams])[:-1]]).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(each)], ["row", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        answers: list[bytes] = []
        rows: list[int] = []
        streams: list[bytes] = []
        for batch in batches:
            for chunk, scores, row, stream in zip(*(batch.column(c).to_pylist() for c in ("chunk", "scores", "row", "stream")), strict=True):
                if chunk != now:
                    yield settle(answers, rows, streams)
                    now, answers, rows, streams = chunk, [], [], []
                if stream is None:
                    answers.append(scores)
                else:
                    rows.append(row)
                    streams.append(stream)
        yield settle(answers, rows, streams)

    return run


def sum_scores(asked: DataFrame, counted: DataFrame, order: int) -> DataFrame:
    """``row, score`` of the texts of ``asked``, which holds texts and the questions of their chunks."""
    n = partitions(asked.sparkSession)
    questions = asked.where("bucket is not null")
    copies = 1 + questions.select("chunk").distinct().count() // CHUNKS_PER_COPY
    trie = counted.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(None).cast("long").alias("chunk"), "keys", "counts")
    questions = questions.select("bucket", F.pmod(F.xxhash64("chunk"), F.lit(copies)).cast("int").alias("copy"), "chunk", "keys", F.lit(None).cast("binary").alias("counts"))
    met = trie.unionByName(questions).repartition(n, "bucket", "copy").sortWithinPartitions("bucket", "copy", F.col("chunk").asc_nulls_first())
    answers = store(arrow_map(met, _answers(short_levels(counted), order), "chunk long, bucket int, scores binary"), "answers")
    texts = asked.where("bucket is null").select("chunk", "bucket", F.lit(None).cast("binary").alias("scores"), "row", "stream")
    replies = answers.select("chunk", "bucket", "scores", F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("stream"))
    whole = texts.unionByName(replies).repartition(n, "chunk").sortWithinPartitions("chunk", F.col("bucket").asc_nulls_last())
    return arrow_map(whole, _sums(order), "row long, score double")


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


_KEPT: dict[str, tuple] = {}

ASKED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
    ("rare", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))), ("stream", pa.binary()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary())])
ASKED_DDL = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare array<struct<word: binary, n: long>>, stream binary, chunk long, bucket int, keys binary"


def score(docs: DataFrame, held_out: int = 0, modulus: int = 10, order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from rows whose id does not hash to ``held_out``; a null id is held
    out of nothing and learnt from. ``score`` is the model's log10 probability of the text's
    symbols, ``base_score`` that of its tokens under smoothed word frequencies. A null or
    empty text is its end alone. Repeated rows are learnt and scored each. Without training
    rows the trie is empty and every symbol has probability 1 / SYMBOLS. Only ``doc_id``
    and ``text`` are read; an empty table gives no rows. ``order`` is 2 to 7.
    """
    spark = docs.sparkSession
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs), (id_remainder(docs["doc_id"], modulus) == held_out).alias("held_out"))
    train = plain.where("not held_out")
    counted = count_keys(train.select("text"), _train_grams(order), part_of, "windows")
    words = store(arrow_map(train.select("text"), _words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = int(totals["n"] or 0), int(totals["v"])
    floor = max(1.0, WORD_SHARE * tokens)
    # At most 1 / WORD_SHARE words.
    often = words.where(F.col("n") >= floor).select("word", "n").toArrow()
    table = merge(np.array([_hash(w) for w in often.column("word").to_pylist()], np.uint64), np.array(often.column("n").to_pylist(), np.int64))
    shared = spark.sparkContext.broadcast(table)
    name = f"{spark.sparkContext.applicationId}-{id(shared)}"
    unit = math.log10(tokens + 0.1 * (kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = (Lookup(shared.value[0]), np.log10(shared.value[1] + 0.1), {})
        places, logs, known = _KEPT[name]
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            texts = [canonical(t) for t in batch.column("text").to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            new = list(set().union([b"\n"], *(w for w, _ in texts)).difference(known))
            at = places.find(np.array([_hash(w) for w in new], np.uint64))
            # 0 marks a word that is not among the frequent ones; no count has that logarithm.
            known.update(zip(new, np.where(at >= 0, logs[at] if len(logs) else 0.0, 0.0).tolist(), strict=True))
            rows: list[dict] = []
            for row, doc_id, apart, (w, stream) in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "held_out")), texts, strict=True):
                values = list(map(known.__getitem__, w))
                values.append(known[b"\n"])
                seldom = Counter([x for x, v in zip(w, values) if v == 0.0])
                if values[-1] == 0.0:
                    seldom[b"\n"] += 1
                rows.append({
                    "row": row, "doc_id": doc_id, "held_out": apart, "n_tokens": len(values), "n_known": len(values) - sum(seldom.values()), "base": math.fsum(values) - len(values) * unit,
                    "rare": [{"word": x, "n": n} for x, n in seldom.items()], "stream": stream, "chunk": chunk})
                held.append(stream)
                size += len(stream)
                if size >= CHUNK:
                    rows += [{"chunk": c, "bucket": b, "keys": k} for c, b, k in _questions(chunk, held, order)]
                    chunk, held, size = chunk + 1, [], 0
            yield pa.RecordBatch.from_pylist(rows, ASKED)
        if held:
            yield pa.RecordBatch.from_pylist([{"chunk": c, "bucket": b, "keys": k} for c, b, k in _questions(chunk, held, order)], ASKED)

    asked = store(arrow_map(plain.withColumn("row", F.monotonically_increasing_id()), run, ASKED_DDL), "asked")
    scored = asked.where("bucket is null")
    sums = sum_scores(asked, counted, order)
    seldom = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("tf"))
    found = seldom.join(words.where(F.col("n") < floor), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("more"), F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("add"))
    return scored.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base").join(sums, "row").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0))).alias("base_score"), "score")
