"""Core steps against brute force."""

import random

import numpy as np

from sigweave.llm import jaccard, packing, sharding, suffixes


def test_suffix_array_orders_all_suffixes():
    rng = random.Random(1)
    for _ in range(500):
        x = [rng.randint(0, rng.randint(1, 4)) for _ in range(rng.randint(0, 30))]
        assert suffixes.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_curve_steps_to_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort(packing.hilbert_key(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_matrix_has_exact_margins():
    m = np.array(sharding.draw_matrix([10, 0, 37, 5], 4, 3))
    assert m.sum(axis=1).tolist() == [10, 0, 37, 5] and set(m.sum(axis=0)) == {13}


def test_bands_reach_recall():
    b, r = jaccard.choose_bands()
    assert 1 - (1 - 0.8**r) ** b >= 0.9999
