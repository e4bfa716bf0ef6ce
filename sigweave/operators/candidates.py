"""Which patterns of a pack are worth trying on a page, as a join.

Every word, and every literal a regular expression cannot match without, gives up one
four-byte gram: its key. A page gives the keys that any pattern has, and an equi-join of
page keys with pattern keys leaves the pairs to try. A pattern is never dropped that
could match: literals too short for a gram, and expressions without a literal, have a
key that every page gives.

Python only turns texts into keys, many texts at once; what matches is decided by the
conditions behind the join.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

GRAM = 4
#: Bytes of text whose grams are looked at together; working arrays take some sixteen times that.
SLICE = 1 << 20
_BITS = 22
# How ordinary a byte is in page text; grams of rare bytes prune better.
_COMMON = {b: 26 - i for i, b in enumerate(b" etaoinshrdlcum<>/=\"-.wfgypbvk")}


@dataclass(frozen=True)
class Unit:
    """One distinct pattern of one part; any number of rules may share it."""

    ix: int
    part: str
    type: str
    pattern: str
    java: str | None
    groups: int
    lowered: str
    literals: tuple[str, ...]


def fold(text: str) -> str:
    """The long s counts as s where case is ignored."""
    return text.replace("ſ", "s")


def folded(lowered: Column) -> Column:
    return F.replace(lowered, F.lit("ſ"), F.lit("s"))


def rarest_gram(literal: str) -> int | None:
    raw = fold(literal).encode("utf-8")
    grams = [raw[i:i + GRAM] for i in range(len(raw) - GRAM + 1)]
    best = min(grams, key=lambda g: (sum(_COMMON.get(b, 0) for b in g), g), default=None)
    return None if best is None else int.from_bytes(best, "little")


def _slot(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (codes * np.uint32(2654435761)) >> np.uint32(32 - _BITS)


def _marked(codes: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << _BITS, bool)
    seen[_slot(codes)] = True
    return seen


def page_grams(texts: pa.Array, codes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, code)`` of each text and each of the sorted ``codes`` among its grams, once."""
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    places = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    found = []
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(places, places[first] + SLICE, "right")) - 1)
        part = raw[places[first] : places[last]].astype(np.uint32)
        if len(part) >= GRAM:
            grams = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
            at = np.flatnonzero(seen[_slot(grams)])
            row = np.searchsorted(places[first : last + 1] - places[first], at, "right") - 1 + first
            whole = at + GRAM <= places[row + 1] - places[first]  # not over the end of the text
            found.append(np.unique(row[whole] << 32 | grams[at[whole]].astype(np.int64)))
        first = last
    both = np.concatenate(found) if found else np.zeros(0, np.int64)
    code = (both & 0xFFFFFFFF).astype(np.uint32)
    known = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code if len(codes) else np.zeros(len(code), bool)
    return (both >> 32)[known], code[known].astype(np.int64)


def gram_keys(texts: dict[int, Column], codes: dict[int, Iterable[int]]) -> Column:
    """``array<bigint>`` of the keys a page gives: kind of text in the upper half, gram in the
    lower. ``texts`` are folded lower-case texts by kind, ``codes`` the grams asked for."""
    kinds = sorted(texts)
    asked = {k: np.array(sorted(codes[k]), np.uint32) for k in kinds}

    @arrow_udf("array<bigint>")
    def find(*columns: pa.Array) -> pa.Array:
        rows, keys = [], []
        for kind, column in zip(kinds, columns, strict=True):
            row, code = page_grams(column, asked[kind], _marked(asked[kind]))
            rows.append(row)
            keys.append(code | kind << 32)
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.argsort(row, kind="stable")
        sizes = np.bincount(row, minlength=len(columns[0]))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[order]))

    # Marked so that the optimizer does not run it a second time in a filter.
    return find.asNondeterministic()(*[texts[k] for k in kinds])
