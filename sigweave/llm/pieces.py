"""Encoding with a published piece model under seeded merge-dropout, and decoding.

Characters are merged by an agenda of neighbouring pairs, best score first. Each
candidate merge is skipped when a hash of its place in the word, keyed by seed, variant,
document and place of the word in the text, says so: every occurrence of a word is drawn
by itself, and all segmentations decode to the same text.

All words of a stretch of text go through the agenda together, as arrays of symbols: in
each round every word takes its best neighbouring pair that was not skipped, until no
word has one. A round's work is a few array operations, however many words it moves.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigweave.llm.common import arrow_map, id_and_text

DROPOUT, VARIANTS, SEED = 0.1, 4, 17
SPACE = "▁"
#: Rounds cost a word its length squared, so longer words keep an agenda of their own.
LONG = 64
#: Words that go through the rounds together.
AT_ONCE = 16_384
#: The rank of a pair that is no piece, or was skipped.
NONE = 1 << 30
ALL64, ODD, FIRST, SECOND = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x94D049BB133111EB


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(FIRST)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(32))


def _mixed_one(x: int) -> int:
    x = (x ^ (x >> 31)) * FIRST & ALL64
    x = (x ^ (x >> 29)) * SECOND & ALL64
    return x ^ (x >> 32)


def _never(code: int) -> bool:
    return False


def _split(text: str) -> list[str]:
    """Words of a text. A word after more than one space, or with a zero character, is
    written as the further spaces, a zero character and the word."""
    if not text:
        return []
    parts = text.split(" ")
    if "\0" not in text and all(parts):
        return parts
    words = []
    gap = 1
    for i, part in enumerate(parts):
        if not part and i + 1 < len(parts):
            gap += 1
            continue
        words.append(part if gap == 1 and "\0" not in part else SPACE * (gap - 1) + "\0" + part)
        gap = 1
    return words


class Pieces:
    """Pieces, scores and bytes of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: list[int] = [0] * 256
        self.raw: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self._tables()

    def _tables(self) -> None:
        """Symbols as numbers: a piece by its id, any other character by its code above all
        ids; and the pairs of symbols that make a piece, sorted, with its rank and id."""
        self.first_code = len(self.raw)
        self.symbol = np.arange(self.first_code, self.first_code + 0x110000, dtype=np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.span = self.first_code + 0x110000
        order = {score: rank for rank, score in enumerate(sorted(set(self.scores.values()), reverse=True))}

        def number(part: str) -> int | None:
            return int(self.symbol[ord(part)]) if len(part) == 1 else self.ids.get(part)

        found = []
        for piece, score in self.scores.items():
            for cut in range(1, len(piece)):
                left, right = number(piece[:cut]), number(piece[cut:])
                if left is not None and right is not None:
                    found.append((left * self.span + right, order[score], self.ids[piece]))
        found.append((1 << 62, NONE, 0))
        self.pairs, self.ranks, self.joins = (np.array(column, np.int64) for column in zip(*sorted(found), strict=True))
        self.byte_ids = np.array(self.bytes, "<u4")
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.raw_begin = np.cumsum(self.raw_size) - self.raw_size

    def merge(self, word: str, skip: Callable[[int], bool] = _never, base: int = 0) -> list[int]:
        """Ids of one word with the spaces before it written as ``SPACE``. ``skip`` says of
        a merge, as its start and end counted from ``base``, whether it is left out."""
        symbols: list[str | None] = list(word)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, str]] = []
        scores = self.scores

        def offer(left: int) -> None:
            right = after[left]
            if left < 0 or right >= n:
                return
            joined = symbols[left] + symbols[right]
            score = scores.get(joined)
            if score is None:
                return
            code = (base + left) << 32 | (base + after[right])
            if not skip(code):
                heapq.heappush(agenda, (-score, left, right, joined))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(joined):
                continue
            symbols[left], symbols[right] = joined, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            i = self.ids.get(s)
            out += [i] if i is not None else [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
        return out

    def whole(self, word: str, skip: Callable[[int], bool] = _never) -> list[int]:
        """Ids of a word as ``encode`` names it. A space mark that stands in the text itself
        is written in bytes, so that it comes back as it was."""
        spaces, _, part = word.partition("\0") if "\0" in word else ("", "", word)
        found: list[int] = []
        at = 0
        for j, plain in enumerate(part.split(SPACE)):
            if j:
                found += [self.bytes[b] for b in SPACE.encode()]
            plain = plain if j else SPACE + spaces + plain
            found += self.merge(plain, skip, at)
            at += len(plain) + 1
        return found

    def _offer(self, left: np.ndarray, right: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and ids of what the pairs make, ``NONE`` where that is no piece or is skipped."""
        asked = left * self.span + right
        at = np.searchsorted(self.pairs, asked)
        rank = np.where(self.pairs[at] == asked, self.ranks[at], NONE)
        if limit:
            made = np.flatnonzero(rank < NONE)
            codes = start[made].astype(np.uint64) << np.uint64(32) | end[made].astype(np.uint64)
            drawn = _mixed(codes * np.uint64(ODD) + keys[made]) >> np.uint64(32)
            rank[made[drawn < np.uint64(limit)]] = NONE
        return rank, self.joins[at]

    def rounds(self, words: list[str], keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        count = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        word, length = np.arange(len(words)), count
        starts = np.cumsum(count) - count
        place = np.arange(len(symbol)) - np.repeat(starts, count)
        rank, into = np.full(len(symbol), NONE, np.int64), np.zeros(len(symbol), np.int64)
        inner = np.ones(len(symbol), bool)
        inner[starts + count - 1] = False
        left = np.flatnonzero(inner)
        rank[left], into[left] = self._offer(symbol[left], symbol[left + 1], place[left], place[left] + 2, np.repeat(keys, count)[left], limit)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            live = best < NONE << 32
            keep = np.repeat(live, count)
            if not live.all():
                done.append((word[~live], count[~live], symbol[~keep]))
            at = best[live] & 0xFFFFFFFF
            symbol[at] = into[at]
            keep[at + 1] = False
            # Where the joined symbols come to stand: words that are done and one symbol a word go before them.
            at -= (np.cumsum(np.where(live, 0, count)) - np.where(live, 0, count))[live] + np.arange(len(at))
            symbol, place, rank, into = symbol[keep], place[keep], rank[keep], into[keep]
            word, length, keys, count = word[live], length[live], keys[live], count[live] - 1
            starts = np.cumsum(count) - count
            after = starts + count
            # The joined symbol is offered with the one after it and with the one before it.
            last = at + 1 == after
            rank[at[last]] = NONE
            i, j = np.flatnonzero(~last), np.flatnonzero(at > starts)
            own = np.concatenate([i, j])
            pair = np.concatenate([at[i], at[j] - 1])
            beyond = np.minimum(pair + 2, len(place) - 1)
            end = np.where(pair + 2 == after[own], length[own], place[beyond])
            rank[pair], into[pair] = self._offer(symbol[pair], symbol[pair + 1], place[pair], end, keys[own], limit)
        word, count, symbol = (np.concatenate(column) for column in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        begins, count = (np.cumsum(count) - count)[order], count[order]
        symbol = symbol[np.repeat(begins - (np.cumsum(count) - count), count) + np.arange(len(symbol))]
        return self._written(symbol, count)

    def _written(self, symbol: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the ids of their bytes in UTF-8."""
        if not len(symbol) or symbol.max() < self.first_code:
            return symbol.astype("<u4"), count
        code = symbol - self.first_code
        n = np.where(code < 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        first = np.cumsum(n) - n
        code, size = np.repeat(code, n), np.repeat(n, n)
        nth = np.arange(len(code)) - np.repeat(first, n)
        low = np.maximum(code, 0) >> 6 * (size - 1 - nth)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
        value = np.where(nth == 0, low | lead, low & 0x3F | 0x80)
        ids = np.where(code < 0, np.repeat(symbol, n), self.byte_ids[value & 0xFF])
        return ids.astype("<u4"), np.add.reduceat(n, np.cumsum(count) - count)

    def _stretch(self, words: list[str], keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words as ``_split`` names them, and how many each word has. Long words, and
        those with a space mark of their own, are merged one by one."""
        joined = "".join(words)
        if "\0" not in joined and SPACE not in joined and max(map(len, words)) <= LONG:
            return self.rounds(list(map(SPACE.__add__, words)), keys, limit)
        alone = {}
        plain = []
        for i, word in enumerate(words):
            spaces, _, part = word.partition("\0") if "\0" in word else ("", "", word)
            if len(word) > LONG or SPACE in part:
                own = int(keys[i])
                skip = (lambda code, own=own: _mixed_one(code * ODD + own & ALL64) >> 32 < limit) if limit else _never
                alone[i] = self.whole(word, skip)
            else:
                plain.append(SPACE + spaces + part)
        if not alone:
            return self.rounds(plain, keys, limit)
        at = np.setdiff1d(np.arange(len(words)), list(alone))
        ids, some = self.rounds(plain, keys[at], limit) if plain else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        count = np.zeros(len(words), np.int64)
        count[at] = some
        for i, found in alone.items():
            count[i] = len(found)
        out = np.zeros(int(count.sum()), "<u4")
        owner = np.zeros(len(words), bool)
        owner[at] = True
        out[np.repeat(owner, count)] = ids
        out[np.repeat(~owner, count)] = [i for found in alone.values() for i in found]
        return out, count

    def encode(self, text: str, variant: int = 0, dropout: float = 0.0, seed: int = SEED, doc: object = None) -> bytes:
        """Little-endian 32-bit ids. The draws of a word depend on ``seed``, ``variant``,
        ``doc`` and the number of the word in the text."""
        return self.encode_all([text], [variant], dropout, seed, [doc])[0]

    def encode_all(self, texts: list[str], variants: list[int], dropout: float, seed: int, docs: list[object]) -> list[bytes]:
        """The ids of each text. Words of several texts share the rounds, and a long text
        takes several stretches of them."""
        limit = int(dropout * (1 << 32))
        out: list[list[bytes]] = [[] for _ in texts]
        words: list[str] = []
        keys: list[np.ndarray] = []
        parts: list[tuple[int, int]] = []

        def flush() -> None:
            ids, count = self._stretch(words, np.concatenate(keys), limit)
            edges = np.concatenate([[0], np.cumsum(count)])
            begin = 0
            for t, n in parts:
                out[t].append(ids[edges[begin] : edges[begin + n]].tobytes())
                begin += n
            words.clear(), keys.clear(), parts.clear()

        for t, (text, variant, doc) in enumerate(zip(texts, variants, docs, strict=True)):
            key = int.from_bytes(hashlib.blake2b(f"{seed} {variant} {doc}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            found = _split(text)
            for i in range(0, len(found), AT_ONCE):
                some = found[i : i + AT_ONCE]
                words += some
                keys.append(_mixed(np.uint64(key) ^ (np.arange(i + 1, i + 1 + len(some), dtype=np.uint64)) * np.uint64(ODD)))
                parts.append((t, len(some)))
                if len(words) >= AT_ONCE:
                    flush()
        if words:
            flush()
        return [b"".join(p) for p in out]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the model writes one space before it, which is taken away."""
        found = np.frombuffer(ids, "<u4")
        size = self.raw_size[found]
        begin = np.repeat(self.raw_begin[found] - (np.cumsum(size) - size), size)
        return self.raw_bytes[begin + np.arange(len(begin))][1:].tobytes().decode("utf-8", "surrogatepass")


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, model: str, dropout: float = DROPOUT, variants: int = VARIANTS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``variant`` (int), ``ids`` (binary, unsigned 32-bit, little-endian) and
    ``lossless`` (whether decoding gives the text back) of every row. A document draws one
    of ``variants`` from its id, and every occurrence of a word is drawn by itself.
    A null text is empty and has no ids; a null id draws like the text "None". Repeated
    rows get equal ids. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for batch in batches:
            docs_, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            drawn = [zlib.crc32(str(d).encode(), seed) % variants for d in docs_]
            ids = m.encode_all(texts, drawn, dropout, seed, docs_)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(drawn, pa.int32()), pa.array(ids, pa.binary()), pa.array([m.decode(i) == t for i, t in zip(ids, texts, strict=True)])],
                ["doc_id", "variant", "ids", "lossless"])

    return arrow_map(id_and_text(docs), run, "doc_id long, variant int, ids binary, lossless boolean")
