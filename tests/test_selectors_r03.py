"""Selectors hold blocks of cosines, not all of a group (round 3)."""

import tracemalloc

import numpy as np
import pytest

from rowforge.operators import vision as V


@pytest.mark.parametrize("method", ["divprune", "mmtok", "scope_l2"])
def test_a_selector_holds_no_matrix_of_all_pairs(monkeypatch, method):
    x = np.random.default_rng(1).standard_normal((1500, 8))
    want = V.PRUNERS[method](x, 6)
    monkeypatch.setattr(V, "_COSINES", 30_000)
    tracemalloc.start()
    got = V.PRUNERS[method](x, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 1500 * 1500 * 8 / 4
