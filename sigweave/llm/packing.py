"""Packing along a space-filling curve.

Every document becomes token ids; the ids are hashed into a vector, projected to a
few dimensions and put on a Hilbert curve. The corpus is range-sorted by curve key,
and neighbours along the curve share sequences.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from sigweave.llm.common import arrow_map, id_and_text, partitions, store

#: Curve dimensions, bits of a coordinate, buckets of the hashed vector.
DIMS, BITS, BUCKETS = 4, 8, 512
#: Words whose ids a worker remembers.
REMEMBERED = 600_000

#: Words of characters below this are split here.
LATIN_END = 0x250
LATIN = chr(LATIN_END)

PIECES = "doc_id long, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells`` (n x d, 0 <= cell < 2**bits)."""
    x = [c.astype(np.int64) for c in np.asarray(cells).T]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = x[0] ^ np.where(high, q - 1, swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ turn) >> bit) & 1)
    return key


class WordEncoder:
    """Token ids of texts, exactly those of the whole-text encoder.

    The encoder's splitter never joins a space that a visible character follows to
    what stands before it, so a text may be cut there and the parts encoded apart.
    Most parts are words seen before. New words of Latin letters are split here, by the
    splitter's own pattern, and their pieces given to the merge model; all others go
    through the whole encoder.
    """

    # A space that no other white space follows, and a text that has other spaces.
    CUT = re.compile(r" (?=\S)")
    ODD = re.compile(r" (?=\s|$)")
    # Fixed value: the published splitting pattern of the byte-level encoder.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.code = self.kind[1:].replace("u2", "H").replace("u4", "I")
        self.model = self.tokenizer.model
        self.split = regex.compile(self.SPLIT).findall
        # How the encoder writes each byte as a character: learnt from it, not repeated here.
        show = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.shown: dict[int, str] = {}
        for c in map(chr, range(LATIN_END)):
            written = "".join(part for part, _ in show(c))
            self.shown.update(zip(c.encode(), written, strict=True))
        self.plain = all(self.shown[c] == chr(c) for c in range(0x21, 0x7F))
        self.space = self.shown[ord(" ")]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in out]

    def _ids(self, piece: str) -> bytes:
        if self.plain and piece.isascii() and piece.isprintable():
            written = piece.replace(" ", self.space)
        else:
            written = piece.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.model.tokenize(written)]).tobytes()

    def _learn(self, new: Iterable[str], special: bool) -> None:
        """Remember the ids of words, each with the space before it."""
        split, words, pieces, ids = self.split, self.words, self.pieces, self._ids
        odd = []
        for w in new:
            if not (w.isascii() or max(w) < LATIN) or (special and any(t in w for t in self.special)):
                odd.append(w)
            elif w.isalpha():  # the pattern takes letters, and one space before them, as one piece
                words[w] = ids(" " + w)
            elif w.isprintable() or w.replace("\n", "").isprintable():
                found = []
                for piece in split(" " + w):
                    known = pieces.get(piece)
                    if known is None:
                        known = pieces[piece] = ids(piece)
                    found.append(known)
                words[w] = b"".join(found)
            else:
                odd.append(w)
        if odd:
            words.update(zip(odd, self._whole([" " + w for w in odd]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of the type ``kind``."""
        parts = [self.CUT.split(t) if self.ODD.search(t) else t.split(" ") for t in texts]
        for kept in (self.words, self.heads, self.pieces):
            if len(kept) > REMEMBERED:
                kept.clear()
        words = self.words
        new: set[str] = set().union(*(p[1:] for p in parts)).difference(words)
        self._learn(new, any(t in x for x in texts for t in self.special))
        heads = self.heads
        first = list({p[0] for p in parts}.difference(heads))
        heads.update(zip(first, self._whole(first), strict=True))
        return [heads[p[0]] + b"".join(map(words.__getitem__, p[1:])) for p in parts]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _projection(ids_range: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, BUCKETS, ids_range).astype(np.int64), rng.standard_normal((BUCKETS, DIMS)).astype(np.float32)


def tokenized(docs: DataFrame, tokenizer: str, seed: int) -> DataFrame:
    """doc_id, ids (binary), width of an id in bytes, and the projected vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = np.dtype(enc.kind).itemsize
        bucket, axes = _projection(50_021, seed)
        bucket = bucket[np.arange(enc.tokenizer.get_vocab_size(with_added_tokens=True)) % len(bucket)]
        for batch in batches:
            ids = enc.encode(batch.column("text").to_pylist())
            vectors = np.zeros((len(ids), BUCKETS), np.float32)
            for row, raw in enumerate(ids):
                vectors[row] = np.bincount(bucket[np.frombuffer(raw, enc.kind)], minlength=BUCKETS)
            vectors = np.sqrt(vectors)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            spot = (vectors @ axes).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32()), *(pa.array(spot[:, i]) for i in range(DIMS))],
                ["doc_id", "ids", "width", *(f"p{i}" for i in range(DIMS))])

    return arrow_map(id_and_text(docs), run, "doc_id long, ids binary, width int, " + ", ".join(f"p{i} double" for i in range(DIMS)))


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, seed: int = 7, partition_count: int | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens.

    Returns ``doc_id, start, length, token_ids (unsigned 32-bit, little-endian),
    doc_tokens, sequence_id, offset``. Every sequence of a partition is full; what is
    left at its end is cut into sequences whose lengths are powers of two, so nothing
    is padded. A null or empty text is the end token alone. Equal rows are packed once
    each; equal curve keys are ordered by id and then by tokens, so a hot key is spread
    over partitions as its ids are. Other columns are not read; an empty table gives
    no rows.
    """
    table = store(tokenized(docs, tokenizer, seed), "tokens")
    spots = [f"p{i}" for i in range(DIMS)]
    stats = table.agg(*(f(p).alias(f"{n}{p}") for p in spots for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    middle = np.array([stats[f"m{p}"] or 0.0 for p in spots])
    spread = np.array([stats[f"s{p}"] or 1.0 for p in spots])

    @pandas_udf("long")
    def curve(*p):
        grid = (np.stack([c.to_numpy() for c in p], axis=1) - middle) / (6 * spread) + 0.5
        return __import__("pandas").Series(hilbert_key(np.clip(grid * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS))

    n = partition_count or partitions(docs.sparkSession)
    ordered = table.select("doc_id", "ids", "width", curve(*spots).alias("key")).repartitionByRange(n, "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []  # pieces of the sequence that is being filled
        used = 0
        for batch in batches:
            out: list[tuple] = []
            for doc, raw, width in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True):
                ids = np.append(np.frombuffer(raw, f"<u{width}").astype("<u4"), np.array([end_id], "<u4"))
                at = 0
                while at < len(ids):
                    take = min(length - used, len(ids) - at)
                    waiting.append((doc, at, take, ids[at : at + take].tobytes(), len(ids), number, used))
                    used, at = used + take, at + take
                    if used == length:
                        out += waiting
                        waiting, used, number = [], 0, number + 1
            yield _pieces(out)
        yield _pieces(_powers(waiting, used, number))

    return arrow_map(ordered, run, PIECES)


def _powers(pieces: list[tuple], total: int, number: int) -> list[tuple]:
    """The last, unfilled sequence, cut into sequences of lengths that are powers of two."""
    out: list[tuple] = []
    room, used = (1 << total.bit_length() >> 1), 0
    for doc, start, size, raw, doc_tokens, _, _ in pieces:
        at = 0
        while at < size:
            take = min(room - used, size - at)
            out.append((doc, start + at, take, raw[4 * at : 4 * (at + take)], doc_tokens, number, used))
            used, at = used + take, at + take
            if used == room:
                total -= room
                room, used, number = (1 << total.bit_length() >> 1), 0, number + 1
    return out


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(columns)],
        ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"])
