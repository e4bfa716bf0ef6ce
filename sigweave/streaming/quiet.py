"""Events of a tab that count once the tab comes to rest.

Each tab has a small state and one timer. Events are held until the watermark has
passed them and then read in order of time, so a stream gives the same rows however
its events are dealt out to micro-batches. Timers run on event time. A tab without
events for ``idle`` is forgotten; the next event finds a tab that is new.

Held events are byte strings: time, then value, written so that their order as bytes is
that of time, pages before icons, and value. They are read one at a time.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Quiet times after which collected events count.
ICON_GAP, ROUTE_GAP = "800 milliseconds", "600 milliseconds"
IDLE = "1 day"
#: Rows a tab reports at a time.
REPORTED = 10_000


def micros(interval: str) -> int:
    return round(pd.Timedelta(interval).total_seconds() * 1_000_000)


class Route:
    """Last address of a tab, and since when a new one waits to be reported."""

    empty: tuple = (None, None)
    schema = "url string, since long"

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def due(self, own: tuple) -> int | None:
        return None if own[1] is None else own[1] + self.gap

    def fire(self, own: tuple) -> tuple[tuple, tuple]:
        """(state afterwards, row to report): the tab rests on its address."""
        return (own[0], None), (own[1], own[0])

    def step(self, own: tuple, ts: int, value: Any) -> tuple:
        """An address that does not differ from the last one neither counts nor waits."""
        return own if value == own[0] else (value, ts)

    def pack(self, value: str) -> bytes:
        return value.encode("utf-8", "surrogatepass")

    def unpack(self, packed: bytes) -> str:
        return packed.decode("utf-8", "surrogatepass")


class Icons:
    """Hashes a page is known to have, and new ones that wait for the tab to rest."""

    empty: tuple = (None, [], [], None, None)
    schema = "capture_id long, known array<int>, fresh array<int>, opened long, last long"

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def due(self, own: tuple) -> int | None:
        return None if own[4] is None else own[4] + self.gap

    def fire(self, own: tuple) -> tuple[tuple, tuple | None]:
        capture, known, fresh, opened, last = own
        both = [*known, *sorted(fresh)]
        row = None if capture is None else (capture, opened, last + self.gap, sorted(fresh), both)
        return (capture, both, [], None, None), row

    def step(self, own: tuple, ts: int, value: Any) -> tuple:
        """A page starts over with its own hashes; a hash that is known changes nothing."""
        capture, hashes = value
        if capture is not None:
            return (capture, list(dict.fromkeys(hashes)), [], None, None)
        page, known, fresh, opened, last = own
        new = [h for h in dict.fromkeys(hashes) if h != 0 and h not in known and h not in fresh]
        return (page, known, [*fresh, *new], ts if opened is None else opened, ts) if new else own

    def pack(self, value: tuple) -> bytes:
        capture, hashes = value
        head = b"\1" if capture is None else b"\0" + _ordered(capture)
        return head + struct.pack(f">{len(hashes)}I", *(h + (1 << 31) for h in hashes))

    def unpack(self, packed: bytes) -> tuple:
        capture, start = (None, 1) if packed[0] else (_number(packed[1:9]), 9)
        return capture, [h - (1 << 31) for h in struct.unpack(f">{(len(packed) - start) // 4}I", packed[start:])]


def _ordered(number: int) -> bytes:
    """A long as eight bytes of the same order."""
    return (number + (1 << 63)).to_bytes(8, "big")


def _number(packed: bytes) -> int:
    return int.from_bytes(packed, "big") - (1 << 63)


def _joined(events: list[bytes]) -> bytes:
    """Held events as one value, each with its length before it."""
    held = bytearray()
    for e in events:
        held += len(e).to_bytes(4, "big")
        held += e
    return bytes(held)


def _parted(held: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(held):
        start = at + 4
        at = start + int.from_bytes(held[at:start], "big")
        yield bytes(held[start:at])


def _timeline(kind: Route | Icons, idle: int, values: Callable[[pd.DataFrame], list], out: list[str]):
    """Function of ``applyInPandasWithState``: holds events, hands them on in order of time,
    fires what is due in between, sets the timer for what comes next."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held, *own = state.get if state.exists else (None, b"", *kind.empty)
        events = list(_parted(held))
        for frame in frames:
            events += [_ordered(us) + kind.pack(value) for us, value in zip(frame["us"].tolist(), values(frame), strict=True)]
        own, now = tuple(own), state.getCurrentWatermarkMs() * 1_000
        rows: list[tuple] = []

        def settle(until: int) -> None:
            nonlocal own
            due = kind.due(own)
            if due is not None and due <= until:
                own, row = kind.fire(own)
                if row is not None:
                    rows.append((*key, *row))

        events.sort()
        ready = bisect_left(events, _ordered(now + 1_000))  # the watermark has passed their millisecond
        for place in range(ready):
            ts, value = _number(events[place][:8]), kind.unpack(events[place][8:])
            settle(ts)
            if seen is not None and ts - seen > idle:
                own = kind.empty
            own, seen = kind.step(own, ts, value), ts
            if len(rows) >= REPORTED:
                yield pd.DataFrame(rows, columns=out)
                rows.clear()
        del events[:ready]
        settle(now)
        due = kind.due(own)
        if not events and due is None and now > seen + idle:
            state.remove()
        else:
            # A timer runs out when the watermark is past it, so each is set one below.
            waits = [_number(events[0][:8]) // 1_000 if events else None, None if due is None else -(-due // 1_000), None if seen is None else (seen + idle) // 1_000 + 1]
            state.update((seen, _joined(events), *own))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), min(w for w in waits if w is not None) - 1))
        yield pd.DataFrame(rows, columns=out)

    return run


def settled_routes(routes: DataFrame, late: str = "10 seconds", gap: str = ROUTE_GAP, idle: str = IDLE) -> DataFrame:
    """``(tab_id, ts, url)`` to ``(tab_id, at_us, url)``: each change of address that the tab
    rested on for ``gap``. An event with the address the tab already has is ignored and
    does not restart the wait."""
    rows = routes.withWatermark("ts", late).select("tab_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("url", F.lit("")).alias("url"))
    run = _timeline(Route(micros(gap)), micros(idle), lambda f: f["url"].tolist(), ["tab_id", "at_us", "url"])
    return rows.groupBy("tab_id").applyInPandasWithState(
        run, "tab_id long, at_us long, url string", f"seen long, held binary, {Route.schema}", "append", GroupStateTimeout.EventTimeTimeout)


def settled_icons(events: DataFrame, late: str = "10 seconds", gap: str = ICON_GAP, idle: str = IDLE) -> DataFrame:
    """``(tab_id, ts, capture_id, hashes)`` to ``(tab_id, capture_id, opened_us, closed_us, fresh,
    favicon_hashes)``: what a tab at rest has gathered beyond the hashes of its page.

    Rows with a ``capture_id`` are pages and bring the page's own hashes; the others are
    icons seen later. A new page drops what was still waiting; icons of a tab without a
    page are not reported.
    """
    rows = events.withWatermark("ts", late).select("tab_id", "ts", F.unix_micros("ts").alias("us"), "capture_id", F.coalesce("hashes", F.array().cast("array<int>")).alias("hashes"))

    def values(frame: pd.DataFrame) -> list:
        return [(None if pd.isna(c) else int(c), [int(x) for x in h]) for c, h in zip(frame["capture_id"], frame["hashes"], strict=True)]

    run = _timeline(Icons(micros(gap)), micros(idle), values, ["tab_id", "capture_id", "opened_us", "closed_us", "fresh", "favicon_hashes"])
    return rows.groupBy("tab_id").applyInPandasWithState(
        run, "tab_id long, capture_id long, opened_us long, closed_us long, fresh array<int>, favicon_hashes array<int>",
        f"seen long, held binary, {Icons.schema}", "append", GroupStateTimeout.EventTimeTimeout)
