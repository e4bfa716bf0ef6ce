"""Phrases that occur more often than their parts suggest, mined relation by relation.

The occurrence relation of phrases of length k says at which places a frequent one
begins. It is stored sorted by piece and position, many pieces to a row (a block). Two
neighbouring places join into a candidate of length k + 1; candidates are counted over
all blocks, and only places whose candidate is frequent stay for the next length.

A block adds each of its phrases once, with a count. So however common a phrase is, it has
no more rows than there are blocks, and both the counting and the way back to the blocks
are exchanges without hot keys; nothing is broadcast and nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigweave.llm.common import arrow_map, partitions, store, text_of

#: Bytes of text in a block; a text is never divided, so a longer one is a block of its own.
BLOCK = 6 << 20
LONGEST = 4
#: What ends a piece, and what parts the words in it.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ENDS = np.isin(np.arange(256), list(PIECE_ENDS))
_WORD = ~(_ENDS | np.isin(np.arange(256), list(BLANKS)))
_HALF = np.int64((1 << 32) - 1)


def words_of(texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, list[tuple[str, str, int]]]:
    """Words of the texts in order as numbers, -1 between pieces; and language, word and
    count behind each number."""
    raw = b"".join(texts).translate(_LOWER)
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    opens = np.cumsum(sizes) - sizes
    inside = _WORD[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[opens[opens < len(data)]] = False
    after[opens[opens > 0] - 1] = False
    begins = np.flatnonzero(inside & ~before)
    lengths = np.flatnonzero(inside & ~after) + 1 - begins
    if not len(begins):
        return np.zeros(0, np.int32), []
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    known = column.dictionary
    kinds = sorted(set(langs))
    lang = np.array([kinds.index(x) for x in langs], np.int64)[np.searchsorted(opens, begins, "right") - 1]
    pairs, numbers, counts = np.unique(lang * len(known) + column.indices.to_numpy(), return_inverse=True, return_counts=True)
    spelt = pc.cast(known, options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)).take(pa.array(pairs % len(known))).to_pylist()
    listed = [(kinds[k], w, c) for k, w, c in zip((pairs // len(known)).tolist(), spelt, counts.tolist(), strict=True)]
    piece = np.searchsorted(np.sort(np.concatenate([np.flatnonzero(_ENDS[data]), opens])), begins, "right")
    gaps = np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    out = np.full(len(begins) + gaps[-1], -1, np.int32)
    out[np.arange(len(begins)) + gaps] = numbers
    return out, listed


def word_blocks(docs: DataFrame) -> DataFrame:
    """``block, numbers, words``: the sorted relation of single words, a row per block."""
    kind = pa.list_(pa.struct([("lang", pa.string()), ("word", pa.string()), ("c", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, texts, langs, held = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def block() -> pa.RecordBatch:
            numbers, words = words_of(texts, langs)
            rows = pa.array([[dict(zip(("lang", "word", "c"), w)) for w in words]], kind)
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([numbers.tobytes()], pa.binary()), rows], ["block", "numbers", "words"])

        for batch in batches:
            for text, lang in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist(), strict=True):
                texts.append(text)
                langs.append(lang)
                held += len(text)
                if held >= BLOCK:
                    yield block()
                    made, texts, langs, held = made + 1, [], [], 0
        if texts:
            yield block()

    rows = docs.select(text_of(docs), F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"))
    return store(arrow_map(rows, run, "block long, numbers binary, words array<struct<lang:string,word:string,c:long>>"), "words")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows with an ``id`` counted from 0: the place in the partition behind the sizes of
    the partitions before. Ids must fit 31 bits, two of them one key."""
    row = F.monotonically_increasing_id()
    rows = store(df.withColumn("_part", F.shiftright(row, 33)).withColumn("_row", row.bitwiseAND(F.lit((1 << 33) - 1))), name)
    offsets, total = [], 0
    for part, n in sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect()):
        offsets.append((part, total))
        total += n
    if total >= 1 << 31:
        raise ValueError(f"{total} frequent words do not fit 31 bits")
    by_part = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return rows.join(F.broadcast(by_part), "_part").withColumn("id", F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def _compact(ids: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Only places inside a frequent phrase, with one -1 for all between two of them."""
    kept = begins.copy()
    for j in range(1, k):
        kept[j:] |= begins[:-j]
    stays = kept.copy()
    stays[1:] |= kept[:-1]
    return np.where(kept, ids, -1)[stays], (begins & kept)[stays]


def _row(block: int, ids: np.ndarray, begins: np.ndarray) -> pa.Table:
    return pa.table({"block": pa.array([block], pa.int64()), "ids": pa.array([ids.astype(np.int32).tobytes()], pa.binary()), "begins": pa.array([begins.astype(np.uint8).tobytes()], pa.binary())})


RELATION = "block long, ids binary, begins binary"


def single_words(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    """The relation of length 1 without rare words: semi-join of the blocks with the
    frequent words each of them holds."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _row(0, np.zeros(0), np.zeros(0)).slice(0, 0)
        numbers = np.frombuffer(left.column("numbers")[0].as_py(), np.int32)
        place = right.column("number").to_numpy()
        ids = np.full(max(int(numbers.max()), int(place.max())) + 2, -1, np.int64)  # the last stays -1, so that -1 finds it
        ids[place] = right.column("id").to_numpy()
        found = ids[numbers]
        return _row(left.column("block")[0].as_py(), *_compact(found, found >= 0, 1))

    return blocks.select("block", "numbers").groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(run, RELATION)


def _joined(ids: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a candidate of length ``k`` begins (there and one further a frequent
    one of length k - 1 begins), and the keys of the candidates."""
    at = np.flatnonzero(begins[:-1] & begins[1:])
    word = lambda j: ids[at + j].astype(np.int64) if j < k else np.zeros(len(at), np.int64)
    return at, word(0) << 32 | word(1), word(2) << 32 | word(3)


def _read(row: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int32), np.frombuffer(row["begins"], np.uint8).astype(bool)


def candidates(relation: DataFrame, k: int) -> DataFrame:
    """``block, hi, lo, c``: the candidates of length ``k`` in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, hi, lo = _joined(*_read(row), k)
                his, hi = np.unique(hi, return_inverse=True)
                los, lo = np.unique(lo, return_inverse=True)
                codes, counts = np.unique(hi.astype(np.int64) << 32 | lo, return_counts=True)
                for s in range(0, len(codes), 100_000):
                    part = codes[s : s + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), row["block"], np.int64)), pa.array(his[part >> 32]), pa.array(los[part & _HALF]), pa.array(counts[s : s + 100_000].astype(np.int64))],
                        ["block", "hi", "lo", "c"])

    return arrow_map(relation, run, "block long, hi long, lo long, c long")


def frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows whose key occurs ``least`` times or more over all blocks, with that count ``f``.
    A key has one row a block, so a window over it is short."""
    return rows.withColumn("f", F.sum("c").over(Window.partitionBy(*keys))).where(F.col("f") >= least)


def longer_phrases(relation: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The relation of length ``k``: places of the one before whose candidate is frequent."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _row(0, np.zeros(0), np.zeros(0)).slice(0, 0)
        row = left.to_pylist()[0]
        ids, before = _read(row)
        at, hi, lo = _joined(ids, before, k)
        begins = np.zeros(len(ids), bool)
        begins[at[_held(hi, lo, right.column("hi").to_numpy(), right.column("lo").to_numpy())]] = True
        return _row(row["block"], *_compact(ids, begins, k))

    return relation.groupBy("block").cogroup(found.select("block", "hi", "lo").groupBy("block")).applyInArrow(run, RELATION)


def _held(hi: np.ndarray, lo: np.ndarray, some_hi: np.ndarray, some_lo: np.ndarray) -> np.ndarray:
    """Which pairs are among some pairs; ranks stand in for keys, two of them fit 64 bits."""
    his, los = np.unique(some_hi), np.unique(some_lo)
    h, m = np.searchsorted(his, hi).clip(max=len(his) - 1), np.searchsorted(los, lo).clip(max=len(los) - 1)
    wanted = np.searchsorted(his, some_hi).astype(np.int64) << 32 | np.searchsorted(los, some_lo)
    return (his[h] == hi) & (los[m] == lo) & np.isin(h.astype(np.int64) << 32 | m, wanted)


def _key_words(k: int) -> Column:
    halves = [F.shiftright("hi", 32), F.col("hi").bitwiseAND(F.lit(int(_HALF))), F.shiftright("lo", 32), F.col("lo").bitwiseAND(F.lit(int(_HALF)))]
    return F.array(*[h.cast("int") for h in halves[:k]]).alias("w")


def mine(docs: DataFrame, least: int = 30, best: int = 2_000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: in each language the ``best`` phrases of
    2 to 4 words that occur ``least`` times or more.

    Texts are lower-cased (A-Z) and divided into pieces at ``.,;:!?`` and line ends, pieces
    into words at blanks and tabs. ``a`` counts a phrase, overlaps included, ``n`` all
    words. Of the ways to cut it in two, the one of the lowest floor(2000000 a / (l + r))
    gives ``l``, ``r`` and ``score``; the first of equal ones. A phrase that lies in a longer
    candidate with four fifths of its count or more is left out.

    A null text is empty, a null language is ``und``. Repeated rows count each time. Equal
    scores go by ``a``, then by the phrase's bytes. A text of any length is one block's
    content. Other columns are not read; an empty table gives no rows.
    """
    blocks = word_blocks(docs)
    words = blocks.select("block", F.posexplode("words").alias("number", "w")).select("block", "number", "w.lang", "w.word", "w.c")
    total = words.groupBy("lang").agg(F.sum("c").alias("n"))
    held = store(frequent(words, ["lang", "word"], least), "frequent")
    names = store(numbered(held.groupBy("lang", "word").agg(F.max("f").alias("f")), "names"), "numbered")
    relation = store(single_words(blocks, held.join(names.select("lang", "word", "id"), ["lang", "word"]).select("block", "number", F.col("id").cast("int").alias("id"))), "relation")
    counted = names.select(F.array(F.col("id").cast("int")).alias("w"), "f")
    for k in range(2, LONGEST + 1):
        found = store(frequent(candidates(relation, k), ["hi", "lo"], least).select("block", "hi", "lo", "f"), f"frequent-{k}")
        counted = counted.unionByName(found.groupBy("hi", "lo").agg(F.max("f").alias("f")).select(_key_words(k), "f"))
        if k < LONGEST:
            relation = store(longer_phrases(relation, found, k), f"relation-{k}")
    return _ranked(store(counted, "phrases"), names, total, best)


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def _ranked(counted: DataFrame, names: DataFrame, total: DataFrame, best: int) -> DataFrame:
    phrases = counted.where(F.size("w") > 1).select("w", F.col("f").alias("a"))
    cut = phrases.select("w", "a", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cut = cut.select("w", "a", "k", F.expr("slice(w, 1, k)").alias("left"), F.expr("slice(w, k + 1, size(w) - k)").alias("rest"))
    cut = cut.join(counted.select(F.col("w").alias("left"), F.col("f").alias("l")), "left").join(counted.select(F.col("w").alias("rest"), F.col("f").alias("r")), "rest")
    scored = cut.withColumn("score", F.expr("CAST(2000000 * CAST(a AS decimal(20,0)) AS decimal(38,0)) div CAST(CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0)) AS decimal(38,0))"))
    lowest = scored.groupBy("w", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("s")).select("w", "a", "s.*")
    spans = F.expr("filter(flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), s -> slice(w, s, m)))), x -> size(x) > 1)")
    inner = phrases.where(F.size("w") > 2).select(F.explode(spans).alias("w"), F.col("a").alias("longer")).groupBy("w").agg(F.max("longer").alias("longer"))
    alone = lowest.join(inner, "w", "left").where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * 80))
    spelt = alone.select("w", "a", "l", "r", "score", F.posexplode("w").alias("at", "id")).join(names.select(F.col("id").cast("int").alias("id"), "lang", "word"), "id")
    whole = spelt.groupBy("w", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    rows = whole.select("lang", F.array_join("words.word", " ").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First among a share of a language's phrases, then among the shares' firsts.
    share = F.pmod(F.xxhash64("phrase"), F.lit(partitions(counted.sparkSession))).alias("_share")
    firsts = rows.select("*", share).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_rank") <= best)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
