"""Events that wait for the watermark are held narrow, whatever a micro-batch brings."""

import random
import tracemalloc

import pandas as pd

from sigweave.streaming import quiet
from tests.test_streams import State, drain


def test_a_held_event_takes_few_bytes():
    n, state = 30_000, State()
    values = lambda f: [(None if c < 0 else int(c), [int(c) % 7]) for c in f["capture_id"].tolist()]
    run = quiet._timeline(quiet.Icons(800_000), 10**12, values, [f"c{i}" for i in range(6)])
    frames = (pd.DataFrame({"us": range(at, at + 1_000), "capture_id": [i if i % 10 == 0 else -i for i in range(at, at + 1_000)]}) for at in range(0, n, 1_000))
    tracemalloc.start()
    for _ in run((7,), frames, state):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert state.exists and most < 200 * n


def test_order_and_values_survive_packing():
    rng = random.Random(2)
    icons = quiet.Icons(0)
    some = [(rng.choice([None, -5, 0, 3, 2**62]), [rng.choice([-(2**31), -1, 0, 1, 2**31 - 1]) for _ in range(rng.randrange(4))]) for _ in range(300)]
    assert [icons.unpack(icons.pack(v)) for v in some] == some
    assert sorted(some, key=icons.pack) == sorted(some, key=lambda v: (v[0] is None, v[0] or 0, tuple(v[1])))
    texts = ["", "a", "é", "z", "\U0001f600", "￿"]
    assert sorted(texts, key=quiet.Route(0).pack) == sorted(texts) and [quiet.Route(0).unpack(quiet.Route(0).pack(t)) for t in texts] == texts


def test_rows_are_reported_in_parts(monkeypatch):
    events = [(n * 1_000_000, f"/{n}") for n in range(50)]
    values = lambda f: f["value"].tolist()
    whole = drain(quiet.Route(600_000), 10**12, events, values, [])
    monkeypatch.setattr(quiet, "REPORTED", 7)
    assert drain(quiet.Route(600_000), 10**12, events, values, []) == whole == [(7, n * 1_000_000, f"/{n}") for n in range(50)]
