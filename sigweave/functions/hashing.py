"""The two hashes that identify icons and DOM probes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv1a_hex(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as eight hexadecimal digits."""
    digits = F.hex(F.encode(text, "UTF-8"))
    total = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) / 2, F.lit(1)).cast("int")),
                    lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")),
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, byte: (h.bitwiseXOR(byte) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)),
    )
    return F.lower(F.lpad(F.hex(F.when(digits == "", F.lit(FNV_OFFSET).cast("bigint")).otherwise(total)), 8, "0"))


def probe_id(sel: Column, text: Column | None = None, attrs: Column | None = None) -> Column:
    """Stable identity of a DOM probe from selector, text and attributes."""
    pairs = F.lit("") if attrs is None else F.coalesce(
        F.array_join(F.transform(F.array_sort(F.map_keys(attrs)),
                                 lambda k: F.concat(k, F.lit("="), F.try_element_at(attrs, k))), "\x01"), F.lit(""))
    extra = F.lit("") if text is None else F.coalesce(text, F.lit(""))
    return F.concat(F.lit("dom:"), fnv1a_hex(F.concat(sel, F.lit("\x00"), extra, F.lit("\x00"), pairs)))


def _rotate(values: np.ndarray, bits: int) -> np.ndarray:
    return values << np.uint32(bits) | values >> np.uint32(32 - bits)


def _mixed(blocks: np.ndarray) -> np.ndarray:
    return _rotate(blocks * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def _little(raw: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Numbers in the bytes from each place, the lowest byte first."""
    out = raw[at].astype(np.uint32)
    for i in range(1, size):
        out |= raw[at + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def _murmur3(texts: pa.Array) -> pa.Array:
    """All texts of a batch advance by one block of four bytes at a time; the longest come
    first, so that those with a block left are the head of the arrays."""
    _, ends, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    places = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(places)
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = places[:-1][order], sizes[order]
    h = np.zeros(len(order), np.uint32)
    blocks = lengths // 4
    steps = int(blocks[0]) if len(blocks) else 0
    left = np.searchsorted(-blocks, -np.arange(steps), "left")  # texts with more than so many blocks
    for step, n in enumerate(left.tolist()):
        h[:n] = _rotate(h[:n] ^ _mixed(_little(raw, starts[:n] + 4 * step, 4)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    for rest in (1, 2, 3):
        at = np.flatnonzero(lengths % 4 == rest)
        if len(at):
            h[at] ^= _mixed(_little(raw, starts[at] + 4 * blocks[at], rest))
    h ^= lengths.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    out = np.empty(len(order), np.uint32)
    out[order] = h ^ h >> np.uint32(16)
    return pa.array(out.view(np.int32), mask=texts.is_null().to_numpy(zero_copy_only=False))


def murmur3_32(text: Column) -> Column:
    """Murmur3 (x86, 32 bit, seed 0) of the UTF-8 text, a batch of texts at a time."""

    @arrow_udf("int")
    def digest(texts: pa.Array) -> pa.Array:
        return _murmur3(texts)

    return digest(text)


def icon_text(content: Column) -> Column:
    """Icon bytes as base64 in 76-character lines, then a final newline."""
    flat = F.regexp_replace(F.base64(content), "[\\r\\n]", "")
    return F.concat(F.regexp_replace(flat, "(.{76})", "$1\n"), F.lit("\n"))


def favicon_hash(content: Column) -> Column:
    return murmur3_32(icon_text(content))
