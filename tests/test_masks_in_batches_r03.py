"""Masks of one size are measured at once (round 3)."""

import numpy as np

from rowforge.operators import masks as K
from rowforge.operators import vision as V


def test_masks_measured_at_once_are_those_of_each():
    r = np.random.default_rng(7)
    a, b = ((r.random((40, 9, 11)) < 0.4) for _ in range(2))
    a[3] = b[4] = False
    got = K._measure([V.rle_encode(x) for x in a], [V.rle_encode(x) for x in b], 9, 11, 1)
    near = lambda e: np.array([[e[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2].any() for j in range(11)] for i in range(9)])
    for k, (x, y) in enumerate(zip(a, b)):
        ex, ey = K.boundary(x), K.boundary(y)
        assert got[k].tolist() == [v.sum() for v in (x, y, x & y, ex, ey, ex & near(ey), ey & near(ex))]
