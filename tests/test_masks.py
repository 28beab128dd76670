"""Boundaries and dilations against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from rowforge.operators import masks as M
from rowforge.operators import vision as V


def plain_boundary(m):
    h, w = m.shape
    at = lambda y, x: bool(m[y, x]) if y < h and x < w else False
    out = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            e, s, se = at(y, x) != at(y, x + 1), at(y, x) != at(y + 1, x), at(y, x) != at(y + 1, x + 1)
            out[y, x] = False if (y, x) == (h - 1, w - 1) else e if y == h - 1 else s if x == w - 1 else e or s or se
    return out


def near(m, r):
    return np.array([[m[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].any() for x in range(m.shape[1])] for y in range(m.shape[0])])


def test_measures(spark):
    r = random.Random(1)
    rows, want = [], []
    for i in range(60):
        h, w, k = r.randrange(1, 9), r.randrange(1, 9), r.choice([0, 1, 2, None])
        a, b = (np.array([[r.random() < p for _ in range(w)] for _ in range(h)]) for p in (r.choice([0, 0.3, 0.8, 1]), r.choice([0, 0.5, 1])))
        rows.append((i, [int(x) for x in V.rle_encode(a)], [int(x) for x in V.rle_encode(b)], h, w, k))
        edge, other, radius = plain_boundary(a), plain_boundary(b), int(np.ceil(0.02 * np.hypot(h, w))) if k is None else k
        n = [int(x.sum()) for x in (a, b, a & b, edge, other, edge & near(other, radius), other & near(edge, radius))]
        p, q = (1, 0) if n[4] == 0 < n[3] else (0, 1) if n[3] == 0 < n[4] else (1, 1) if n[3] == n[4] == 0 else (n[6] / n[4], n[5] / n[3])
        want.append((*n, 2 * p * q / (p + q) if p + q else 0.0, n[2] / min(n[:2]) if min(n[:2]) else 0.0))
    df = spark.createDataFrame([*rows, (99, None, [4], 2, 2, 1)], "i long, a array<long>, b array<long>, h int, w int, r int")
    got = {x["i"]: tuple(x["m"]) + (x["f"], x["iom"]) for x in df.withColumn("m", M.mask_measures("a", "b", "h", "w", F.col("r"))).select("i", "m", M.boundary_f(F.col("m")).alias("f"), M.mask_iom(F.col("m")).alias("iom")).collect()}
    for i, w in enumerate(want):
        assert np.allclose(got[i], w), (i, got[i], w)
    assert got[99] == (None,) * 9


def test_polygons(spark):
    rows = [(0, [0.0, 0.0, 4.0, 0.0, 0.0, 4.0]), (1, None), (2, [1.0, 1.0])]
    got = {x["i"]: [int(v) for v in x["r"]] for x in spark.createDataFrame(rows, "i int, p array<double>").select("i", M.polygon_runs("p", F.lit(4), F.lit(5)).alias("r")).collect()}
    assert V.rle_decode(got[0], 4, 5).astype(int).tolist() == V.polygon_mask(rows[0][1], 4, 5).tolist() and got[1] == got[2] == [20]
