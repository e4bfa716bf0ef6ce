"""Removal of repeated byte strings through suffix arrays.

Every window of ``WINDOW`` bytes has an anchor, the least k-gram hash in it; equal
windows have equal anchors at equal places. Anchors whose k-gram is unique in the corpus
end there. The surroundings of the others, as far as their windows reach, are brought
together by k-gram, equal ones as one with a count. What differs is cut to the bytes
that some other shares, and a suffix array of the distinct strings decides: a window is
repeated if the suffix that starts it agrees with a neighbour for ``WINDOW`` bytes.
The surroundings of a gram that has many are dealt by ranges of their windows first, by the
bytes that all windows of a range cover, so that no task holds such a gram.

The suffix array is built by grouping: suffixes are put into groups by their Lyndon
prefixes, and groups are settled in descending order, following pointers to the previous
smaller suffix; a second pass emits every group's order, without recursion or renaming.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.llm.common import arrow_map, partitions, store, text_of

WINDOW, GRAM = 200, 48
#: More different surroundings than this do not meet in a task, but are dealt by ranges of windows.
KINDS = 256
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order, shorter before longer."""
    n = len(text)
    if n == 0:
        return []
    # Phase 1. Groups start as equal first symbols. A group's start and size in the order
    # are known; prev[s] is the start of the nearest smaller suffix left of s found so far.
    order = sorted(range(n), key=text.__getitem__)
    group = [0] * n  # first place of the group of a suffix
    size = [0] * n  # by first place
    at = 0
    for place, s in enumerate(order):
        if place and text[order[place - 1]] != text[s]:
            at = place
        group[s] = at
        size[at] += 1
    spot = [0] * n  # place of a suffix
    for place, s in enumerate(order):
        spot[s] = place
    prev = [-2] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        members = order[start:end]
        # Every member's pointer: the nearest suffix to the left in a lower group.
        for s in sorted(members):
            p = s - 1
            while p >= 0 and group[p] >= start:
                # A suffix of this group is no answer but leads on: its own pointer is set already.
                if group[p] == start:
                    if prev[p] != -2:
                        p = prev[p]
                        continue
                    p -= 1
                    continue
                p = prev[p]
            prev[s] = p
        # Suffixes that point here gain the prefix of this group: each leaves its group for
        # a new one right behind it. Those met by more members go further behind.
        times: dict[int, int] = {}
        for s in members:
            p = prev[s]
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        rounds: dict[int, list[int]] = {}
        for p, k in times.items():
            rounds.setdefault(k, []).append(p)
        for k in sorted(rounds, reverse=True):
            touched: dict[int, list[int]] = {}
            for p in rounds[k]:
                touched.setdefault(group[p], []).append(p)
            for g, ps in touched.items():
                last = g + size[g]
                if len(ps) == size[g]:
                    continue  # all of them move on together
                head = last - len(ps)
                for offset, p in enumerate(ps):
                    target = head + offset
                    other = order[target]
                    here = spot[p]
                    order[here], order[target] = other, p
                    spot[other], spot[p] = here, target
                for p in ps:
                    group[p] = head
                size[g] -= len(ps)
                size[head] = len(ps)
        end = start
    # Phase 2. In ascending order of suffixes, the suffix left of the one just placed, and
    # the suffixes its pointers lead to, are next in their groups.
    out = [-1] * n
    used = [0] * n
    done = [False] * n

    def settle(s: int) -> None:
        p = s - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[g + used[g]] = p
            used[g] += 1
            done[p] = True
            p = prev[p]

    settle(n)
    for place in range(n):
        if out[place] >= 0:
            settle(out[place])
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


#: Windows handled at once; a longer text goes piece by piece, so positions fit 24 bits.
PIECE = 1 << 20
_UP, _DOWN = _powers(PIECE + WINDOW + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * BASE
    return x ^ (x >> np.uint64(32))


def anchors(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Arrays (gram hash, hash of the surroundings, anchor, first window, last window):
    the anchors of all windows of ``raw``, each with the run of windows it stands for."""
    parts = []
    for base in range(0, max(0, len(raw) - window + 1), PIECE):
        b = np.frombuffer(raw[base : base + PIECE + window - 1], np.uint8).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * _UP[: len(b)], dtype=np.uint64)])
        grams = _mixed((sums[gram:] - sums[:-gram]) * _DOWN[: len(b) - gram + 1])
        wide = window - gram + 1
        tagged = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
        full = np.full(-(-len(tagged) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        full[: len(tagged)] = tagged
        blocks = full.reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(b) - window + 1
        place = (np.minimum(behind[:count], ahead[wide - 1 : wide - 1 + count]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:] - 1, [count - 1]])
        a = place[first]
        around = (sums[last + window] - sums[first]) * _DOWN[first]
        around = _mixed(around ^ _mixed((a - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)))
        parts.append((grams[a].astype(np.int64), around.astype(np.int64), a + base, first + base, last + base))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


def repeated_windows(strings: list[bytes], counts: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For each of distinct strings, which of its windows occur at two places or more,
    an occurrence in a string of count c standing for c places."""
    text: list[int] = []
    starts = []
    for i, s in enumerate(strings):
        starts.append(len(text))
        text += s
        text.append(256 + i)  # an end of its own, so matches stop there
    raw = [bytes(s) for s in strings]
    flags = [np.full(max(0, len(s) - window + 1), c > 1) for s, c in zip(strings, counts, strict=True)]
    if len(strings) == 1 and counts[0] > 1:
        return flags
    owner = np.repeat(np.arange(len(strings)), [len(s) + 1 for s in strings])
    before: tuple[int, int] | None = None
    for place in suffix_array(text):
        i = int(owner[place])
        at = place - starts[i]
        if at < len(flags[i]):
            if before and raw[before[0]][before[1] : before[1] + window] == raw[i][at : at + window]:
                flags[i][at] = flags[before[0]][before[1]] = True
            before = (i, at)
    return flags


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _shared(sides: list[bytes]) -> list[int]:
    """How far each string agrees with some other from its start."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    far = [0] * len(sides)
    for x, y in zip(order, order[1:], strict=False):
        n = _common(sides[x], sides[y])
        far[x], far[y] = max(far[x], n), max(far[y], n)
    return far


def settle(members: list[tuple[int, bytes, int]], window: int = WINDOW) -> list[np.ndarray]:
    """Which windows of each member (anchor place, bytes, count) of one gram are repeated.
    Members are cut to what some other shares on either side of the anchor; equal cuts
    meet as one string with the sum of their counts."""
    right = _shared([s[a:] for a, s, _ in members])
    left = _shared([s[:a][::-1] for a, s, _ in members])
    out = [np.full(max(0, len(s) - window + 1), c > 1) for _, s, c in members]
    cuts: dict[bytes, list[tuple[int, int]]] = {}
    for i, (a, s, c) in enumerate(members):
        lo, hi = (0, len(s)) if c > 1 else (a - left[i], a + right[i])
        if hi - lo >= window:
            cuts.setdefault(s[lo:hi], []).append((i, lo))
    strings = list(cuts)
    flags = repeated_windows(strings, [sum(members[i][2] for i, _ in cuts[s]) for s in strings], window)
    for s, f in zip(strings, flags, strict=True):
        for i, lo in cuts[s]:
            out[i][lo : lo + len(f)] |= f
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


ANCHORS = "id long, k long, h long, v long, a int, lo int, hi int"


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ks = batch.column("id").to_pylist(), batch.column("k").to_pylist()
            found = [anchors(t.encode("utf-8", "surrogatepass"), window, gram) for t in batch.column("text").to_pylist()]
            sizes = [len(f[0]) for f in found]
            cols = [np.concatenate([f[j] for f in found]) for j in range(5)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(np.repeat(np.array(ks, np.int64), sizes)), *(pa.array(c) for c in cols[:2]), *(pa.array(c.astype(np.int32)) for c in cols[2:])],
                ["id", "k", "h", "v", "a", "lo", "hi"])

    return run


def _surroundings(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(p["h"], p["v"], p["c"], p["a"] - p["lo"], raw[p["lo"] : p["hi"] + window], p["large"]) for p in at]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], ["h", "v", "c", "a", "bytes", "large"])

    return run


def _settle_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[tuple]) -> list[tuple]:
            flags = settle([(a, s, c) for _, _, c, a, s in held], window)
            return [(h, v, [{"f": x, "l": y} for x, y in _runs(f)]) for (h, v, *_), f in zip(held, flags, strict=True) if f.any()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.struct([("f", pa.int32()), ("l", pa.int32())])))], ["h", "v", "runs"])

        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "v", "c", "a", "bytes")), strict=True):
                if held and held[0][0] != row[0]:
                    out += emit(held)
                    held = []
                held.append(row)
            if len(out) > 2000:
                yield made(out)
                out = []
        yield made(out + (emit(held) if held else []))

    return run


#: Ranges into which the windows of a group are dealt when it is too large.
RANGES = 4


def _part_rows(window: int):
    """The members of large groups, once for each range of their windows.

    Window ``j`` has ``j`` bytes before its anchor. Windows ``x`` to ``y`` all cover the bytes
    from ``x`` before the anchor to ``window - y`` behind its start, so members that share one
    of them agree there: these bytes name the group of the range. A member comes into it cut
    to what these windows cover, with the place of its first window in the whole (``shift``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, v, c, a, s, x, y in zip(*(batch.column(n).to_pylist() for n in ("h", "v", "c", "a", "bytes", "x", "y")), strict=True):
                step = -(-(y - x + 1) // RANGES)
                for first in range(x, y + 1, step):
                    last = min(first + step - 1, y)
                    lo, hi = max(first, a + window - len(s)), min(last, a)
                    if lo <= hi:
                        cut = s[a - hi : a - lo + window]
                        group = b"%d %d %d " % (h, first, last) + s[a - first : a + window - last]
                        rows.append((h, v, a - hi, c, _digest(group), _digest(b"%d " % hi + cut), hi, cut, first, last))
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["in_h", "in_v", "shift", "c", "h", "v", "a", "bytes", "x", "y"])

    return run


PARTS = "in_h long, in_v long, shift int, c long, h long, v long, a int, bytes binary, x int, y int"


def _digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _shifted(by: str) -> Column:
    """The runs of all rows of a group, each moved by the column ``by`` of its row."""
    return F.flatten(F.collect_list(F.transform("runs", lambda r: F.struct((r["f"] + F.col(by)).alias("f"), (r["l"] + F.col(by)).alias("l")))))


def _settled(around: DataFrame, window: int, gram: int, many: int) -> DataFrame:
    """(h, v, runs) of the members that have repeated windows. Groups of more than ``many``
    members are dealt by ranges of windows into smaller ones, equal cuts meeting as one with
    the sum of their counts, until none is too large; a range of one window has one member."""

    def solved(level: DataFrame) -> DataFrame:
        small = level.where("not large").select("h", "v", "c", "a", "bytes")
        dealt = small.repartition(partitions(around.sparkSession), "h").sortWithinPartitions("h", "v")
        return store(dealt.mapInArrow(_settle_rows(window), "h long, v long, runs array<struct<f: int, l: int>>"), "settled")

    level = around.withColumns({"x": F.lit(0), "y": F.lit(window - gram)})
    found, dealt = [solved(level)], []
    while not level.where("large").isEmpty():
        parts = store(arrow_map(level.where("large").drop("large"), _part_rows(window), PARTS), "parts")
        kinds = store(parts.groupBy("h", "v").agg(F.sum("c").alias("c"), F.first(F.struct("a", "bytes", "x", "y")).alias("p")).select("h", "v", "c", "p.*"), "part-kinds")
        # A range that one place alone has holds nothing repeated.
        groups = store(kinds.groupBy("h").agg(F.count("*").alias("n"), F.sum("c").alias("c")).where("c > 1").select("h", (F.col("n") > many).alias("large")), "part-groups")
        level = store(kinds.join(groups, "h"), "part-members")
        dealt.append(parts.select("in_h", "in_v", "shift", "h", "v"))
        found.append(solved(level))
    out = found.pop()
    while dealt:
        back = dealt.pop().join(out, ["h", "v"]).groupBy(F.col("in_h").alias("h"), F.col("in_v").alias("v")).agg(_shifted("shift").alias("runs"))
        out = found.pop().unionByName(store(back, "runs-of-parts"))
    return out


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for f, last in sorted((r["f"], r["l"]) for r in runs or []):
                    if spans and f <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last + window)
                    else:
                        spans.append([f, last + window])
                kept, at = [], 0
                for f, e in spans:
                    kept.append(raw[at:f])
                    at = e
                kept.append(raw[at:])
                out.append((len(raw), sum(e - f for f, e in spans), len(spans), b"".join(kept)))
            cols = list(zip(*out, strict=True)) or [()] * 4
            names = [n for n in batch.schema.names if n != "runs"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, many: int = KINDS) -> DataFrame:
    """All columns of ``docs`` and ``n_bytes, n_removed, n_spans`` (long) and ``kept``
    (binary: the text's UTF-8 bytes without every byte that a ``window``-byte string
    covers which also starts anywhere else in the corpus, the same text included).

    Matches never cross documents and are judged on the input. A null text is empty and
    returned as empty. Repeated rows are places of their own, so all their bytes go if
    the text has ``window`` bytes. Texts shorter than ``window`` stay. Input columns with
    the added names are replaced; ids may be null. An empty table gives no rows. Of a
    gram's different surroundings, at most ``many`` meet in one suffix array.
    """
    extra = [c for c in docs.columns if c.lower() not in ("text", "n_bytes", "n_removed", "n_spans", "kept")]
    plain = docs.select(F.struct(*extra).alias("extra"), text_of(docs), F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("id"))
    plain = plain.withColumn("k", F.xxhash64("id", "text"))
    found = arrow_map(plain.select("id", "k", "text"), _anchor_rows(window, gram), ANCHORS)
    met = store(found.groupBy("h").agg(F.count("*").alias("n"), F.min("v").alias("v1"), F.max("v").alias("v2")).where("n > 1").select("h", (F.col("v1") != F.col("v2")).alias("mixed")), "grams")
    hits = store(found.join(met, "h"), "anchors")
    kinds = hits.groupBy("h", "v", "mixed").agg(F.count("*").alias("c"), F.min(F.struct("id", "k", "a", "lo", "hi")).alias("p"))
    # Surroundings of one place stand for all equal ones.
    mixed = store(kinds.where("mixed").select("h", "v", "c", "p.*"), "kinds")
    large = store(mixed.groupBy("h").count().where(F.col("count") > many).select("h", F.lit(True).alias("large")), "large-grams")
    ask = mixed.join(large, "h", "left").groupBy("id", "k").agg(F.collect_list(F.struct("h", "v", "c", "a", "lo", "hi", F.coalesce("large", F.lit(False)).alias("large"))).alias("at"))
    asked = plain.select("id", "k", "text").join(ask, ["id", "k"]).dropDuplicates(["id", "k"]).select("text", "at")
    around = store(arrow_map(asked, _surroundings(window), "h long, v long, c long, a int, bytes binary, large boolean"), "surroundings")
    solved = _settled(around, window, gram, many)
    whole = kinds.where("not mixed and c > 1").select("h", "v", F.array(F.struct(F.lit(0).alias("f"), (F.col("p.hi") - F.col("p.lo")).alias("l"))).alias("runs"))
    spans = hits.join(solved.unionByName(whole), ["h", "v"]).groupBy("id", "k").agg(_shifted("lo").alias("runs"))
    joined = plain.join(store(spans, "spans"), ["id", "k"], "left").select("extra", "text", "runs")
    shape = joined.schema
    out = arrow_map(joined, _cut(window), f"extra {shape['extra'].dataType.simpleString()}, text string, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select("extra.*", "text", "n_bytes", "n_removed", "n_spans", "kept")
