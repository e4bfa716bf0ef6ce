"""Fill-in-middle forms of texts. Where a text is cut is a matter of counting its tokens,
and texts share much: a rolling hash cuts each text into chunks where its content says
so, so that equal passages give equal chunks wherever they stand. What a chunk adds to
the count (its tokens, and whether it begins and ends inside a word) is remembered by
its content. Summing the chunks gives the count of the text, and the sums tell in which
chunk a cut lies; only that chunk is read token by token.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.llm.common import arrow_map, id_and_text

#: Fixed values of the output forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes the rolling hash looks at, and the bits of it that are zero at a cut: chunks are
#: of 2**ZEROS bytes on average.
WINDOW, ZEROS = 16, 8
#: Bytes of chunks that a task remembers, in each of two generations.
REMEMBERED = 32 << 20

_CONTINUED = bytes(range(0x80, 0xC0))
_IS_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
#: Letters become "a", all else " ".
_SHAPE = bytes(0x61 if x else 0x20 for x in _IS_LETTER)
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where a chunk begins inside the texts that ``data`` joins; ``starts`` are the
    first bytes of the texts. A cut depends on the ``WINDOW`` bytes of its own text before
    it alone, and never splits a character."""
    if not len(data):
        return np.zeros(0, np.int64)
    rolled, width = _GEAR[data], 1
    while width < WINDOW:
        moved = np.zeros_like(rolled)
        moved[width:] = rolled[:-width] << np.uint32(width)
        rolled, width = rolled + moved, width * 2
    at = np.flatnonzero(rolled[:-1] >> np.uint32(32 - ZEROS) == 0) + 1
    at = at[(data[at] & 0xC0) != 0x80]
    return at[at - starts[np.searchsorted(starts, at, "right") - 1] >= WINDOW]


Summary = tuple[int, bool, bool]


def summary(chunk: bytes) -> Summary:
    """Tokens of a chunk read by itself, and whether it begins and ends with a letter."""
    shape = chunk.translate(_SHAPE, _CONTINUED)
    first, last = shape[:1] == b"a", shape[-1:] == b"a"
    return shape.count(b" ") + shape.count(b" a") + first, first, last


class Memo:
    """Summaries by content. Equal hashes do not count as equal chunks: a dictionary
    compares the bytes. The older half is forgotten when the newer is full."""

    def __init__(self, most: int = REMEMBERED) -> None:
        self.new: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}
        self.held, self.most = 0, most

    def __call__(self, chunk: bytes) -> Summary:
        known = self.new.get(chunk)
        if known is None:
            known = self.old.get(chunk) or summary(chunk)
            self.held += len(chunk)
            if self.held > self.most:
                self.old, self.new, self.held = self.new, {}, len(chunk)
            self.new[chunk] = known
        return known


def token_counts(raw: bytes, bounds: list[int], memo: Memo) -> tuple[list[int], list[bool]]:
    """Tokens that begin before each chunk and before the end, and whether the byte before
    each chunk is a letter. A word that runs over a bound counts where it begins."""
    before, lettered, n, inside = [0], [False], 0, False
    for s, e in zip(bounds, bounds[1:]):
        tokens, first, last = memo(raw[s:e])
        n += tokens - (inside and first)
        inside = last
        before.append(n)
        lettered.append(inside)
    return before, lettered


def place_of(token: int, raw: bytes, bounds: list[int], before: list[int], lettered: list[bool]) -> int:
    """Byte at which the token of this number begins; the end for the one past the last."""
    if token >= before[-1]:
        return len(raw)
    c = bisect_right(before, token) - 1
    chunk = np.frombuffer(raw, np.uint8, bounds[c + 1] - bounds[c], bounds[c])
    letter = _IS_LETTER[chunk]
    left = np.concatenate([[lettered[c]], letter[:-1]])
    begins = (letter & ~left) | (~letter & ((chunk & 0xC0) != 0x80))
    return bounds[c] + int(np.flatnonzero(begins)[token - before[c]])


FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row.

    Tokens are runs of the letters A-Z and a-z, and every other character. ``seed`` and the
    id draw both cuts, whether the text stays ``plain`` (``plain_from`` of 100 do not) and,
    if not, whether the suffix comes first (``spm``, ``spm_below`` of 100) or the prefix
    (``psm``). Empty texts and texts that hold a mark stay plain and have null lengths.

    A null text is empty; a null id draws like the empty id. Rows of equal ids are cut
    alike if their texts are equal. Texts of any length are cut at the same cost a byte.
    Other columns are not read; an empty table gives no rows.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            raws = batch.column("text").cast(pa.binary()).to_pylist()
            ends = np.cumsum([len(r) for r in raws], dtype=np.int64)
            starts = ends - np.array([len(r) for r in raws], np.int64)
            found = cuts(np.frombuffer(b"".join(raws), np.uint8), starts)
            spans = np.searchsorted(found, [starts, ends]).T
            out = []
            for doc, raw, start, (a, b) in zip(batch.column("doc_id").to_pylist(), raws, starts.tolist(), spans.tolist(), strict=True):
                bounds = [0, *(found[a:b] - start).tolist(), len(raw)] if raw else [0]
                before, lettered = token_counts(raw, bounds, memo)
                n = before[-1]
                drawn = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
                h1, h2, h3, h4 = (int(drawn[i : i + 8], 16) for i in (0, 8, 16, 24))
                if not raw or h3 % 100 >= plain_from or any(m in raw for m in marks):
                    out.append((n, "plain", None, None, raw))
                    continue
                one, two = (place_of(t, raw, bounds, before, lettered) for t in sorted((h1 % (n + 1), h2 % (n + 1))))
                prefix, middle, suffix = raw[:one], raw[one:two], raw[two:]
                p, s, m = marks
                form = "spm" if h4 % 100 < spm_below else "psm"
                whole = [s, suffix, p, prefix, m, middle] if form == "spm" else [p, prefix, s, suffix, m, middle]
                out.append((n, form, len(prefix.translate(None, _CONTINUED)), len(middle.translate(None, _CONTINUED)), b"".join(whole)))
            n, form, prefix, middle, text = zip(*out, strict=True) if out else ([],) * 5
            texts = pc.cast(pa.array(text, pa.binary()), options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), texts],
                [f.split()[0] for f in FORMS.split(", ")])

    return arrow_map(id_and_text(docs), run, FORMS)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of. No mark stands in a text that is not plain, so the
    first of each kind is the one that was put there."""
    between = lambda after, until: F.substring_index(F.substring_index(output, until, 1), after, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
