"""Suppression and matching of many small groups at once (round 3)."""

import numpy as np

from rowforge.operators import detection as D


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_groups_are_suppressed_side_by_side(spark):
    r = np.random.default_rng(4)
    rows = []
    for g in range(40):
        score = {i: None if r.random() < 0.1 else float(r.integers(0, 4)) for i in range(12)}
        rows += [(g or None, f"k{i:02d}", f"k{j:02d}", score[i], score[j]) for i in range(12) for j in range(i) if r.random() < 0.25]
    # a chain longer than the rounds
    rows += [(99, f"k{i:03d}", f"k{i + 1:03d}", float(-i), float(-i - 1)) for i in range(300)]
    got = D.suppressed(spark.createDataFrame(rows, "g long, a string, b string, score_a double, score_b double"), ["g"])
    assert "FlatMapGroups" not in plan(got)
    want = set()
    for g in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == g]
        score = {x[1]: x[3] for x in mine} | {x[2]: x[4] for x in mine}
        gone = set()
        for k in sorted(score, key=lambda k: (-(float("-inf") if score[k] is None else score[k]), k)):
            if k not in gone:
                gone |= {b if a == k else a for _, a, b, *_ in mine if k in (a, b)}
        want |= {(g, k) for k in gone}
    assert {tuple(x) for x in got.collect()} == want and len(want) > 150


def test_padding_matches_nothing():
    """Images of other sizes beside it change nothing for one."""
    r = np.random.default_rng(6)
    box = lambda k: (lambda x: np.concatenate([x, x + r.integers(5, 60, (k, 2))], 1))(r.integers(0, 30, (k, 2)).astype(float))
    n, m, levels = np.array([0, 3, 9, 5, 9]), np.array([4, 0, 2, 8, 8]), np.array(D.LEVELS)
    p, t, area, crowd = np.zeros((5, 9, 4)), np.zeros((5, 8, 4)), np.zeros((5, 8)), np.zeros((5, 8), bool)
    for k in range(5):
        p[k, : n[k]], t[k, : m[k]] = box(n[k]), box(m[k])
        area[k, : m[k]], crowd[k, : m[k]] = r.integers(10, 3000, m[k]), r.random(m[k]) < 0.3
    got = D.match_images(p, t, area, crowd, n, m, levels)
    for k in range(5):
        assert (got[k, : n[k]] == D.match_image(p[k, : n[k]], t[k, : m[k]], area[k, : m[k]], crowd[k, : m[k]], levels)).all()
