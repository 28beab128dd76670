"""Balanced partitions and dynamic batches: plans against a plain differencing, and what they have to hold."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from rowforge.operators import batch as W


def plain_differencing(weights, parts, equal):
    """Largest differencing over sorted lists: always joins the two solutions that differ most."""
    order = sorted((w, i) for i, w in enumerate(weights))
    empty = (0, 0, ())
    one = lambda w, i: (w, 1, ((i, w),))
    step = parts if equal else 1
    states = [sorted([one(w, i) for w, i in order[k : k + step]] + [empty] * (parts - step), reverse=True) for k in range(0, len(order), step)]
    while len(states) > 1:
        states.sort(key=lambda s: (s[0][0] - s[-1][0], s[0]), reverse=True)
        a, b, rest = states[0], states[1], states[2:]
        joined = [(x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x, y in zip(a, b[::-1])]
        states = [*rest, sorted(joined, reverse=True)]
    return [sorted(i for i, _ in p[2]) for p in states[0]]


@pytest.mark.parametrize("equal", [False, True])
def test_differencing(equal):
    r = random.Random(5)
    for n in (4, 8, 12, 40):
        for _ in range(6):
            w = [r.choice([1, 5, 5, 7, r.randrange(1000)]) for _ in range(n)]
            assert W.karmarkar_karp(w, 4, equal) == plain_differencing(w, 4, equal)


def test_greedy_takes_rows_in_their_order():
    assert W.greedy_partition([1, 9, 1, 1, 9], 2) == [[0, 2, 3, 4], [1]]
    assert W.greedy_partition([1, 9, 1, 1, 9, 2], 2, equal=True) == [[0, 2, 4], [1, 3, 5]]
    with pytest.raises(ValueError, match="divides"):
        W.greedy_partition([1, 2, 3], 2, equal=True)


def table(spark, batches=5, seed=3):
    r = random.Random(seed)
    rows = [(f"b{b}", 100 * b + i, r.choice([0, 3, 80, r.randrange(300)]) if i else None, f"u{i // 3}", i) for b in range(batches) for i in range(12 + 3 * b)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "batch string, id long, n long, uid string, part_of int")


def groups(rows, key="batch"):
    out = collections.defaultdict(list)
    for x in sorted(rows, key=lambda x: x["id"]):
        out[x[key]].append(x)
    return out


def test_balanced_batches(spark):
    rows, df = table(spark)
    got = groups(W.balanced_batches(df, "batch", "id", "n", 3).collect())
    for b, items in groups([{"batch": x[0], "id": x[1], "n": x[2] or 0} for x in rows]).items():
        want = plain_differencing([x["n"] for x in items], 3, False)
        assert [[i for i, x in enumerate(got[b]) if x["part"] == k] for k in range(3)] == want
    for x in groups(W.balanced_batches(df, "batch", "id", "n", 3, equal=True).collect()).values():
        assert set(collections.Counter(y["part"] for y in x).values()) == {len(x) // 3}
    assert W.balanced_batches(df.limit(0), "batch", "id", "n", 3).count() == 0
    with pytest.raises(Exception, match="can't be dealt"):
        W.balanced_batches(df, "batch", "id", "n", 13).collect()


def test_rows_that_belong_together(spark):
    _, df = table(spark, 1)
    got = W.balanced_batches(df, "batch", "id", "n", 2, together="uid").collect()
    of = collections.defaultdict(set)
    for x in got:
        of[x["uid"]].add(x["part"])
    assert all(len(v) == 1 for v in of.values()) and collections.Counter(next(iter(v)) for v in of.values()) == {0: 2, 1: 2}
    with pytest.raises(Exception, match="divides"):
        W.balanced_batches(df, "batch", "id", "n", 3, together="uid").collect()


@pytest.mark.parametrize("least, multiple, same", [(1, 1, False), (3, 2, False), (1, 3, True)])
def test_dynamic_batches(spark, least, multiple, same):
    _, df = table(spark)
    cost = lambda n: 24576 * n + n * n
    got = groups(W.dynamic_batches(df, "batch", "id", "n", 400, least, multiple, same).collect())
    need = {b: max(least, min(len(x), -(-sum(y["n"] or 0 for y in x) // 400))) for b, x in got.items()}
    need = {b: -(-(max(need.values()) if same else k) // multiple) * multiple for b, k in need.items()}
    for b, x in got.items():
        n = [y["n"] or 0 for y in x]
        bins = [[i for i, y in enumerate(x) if y["bin"] == k] for k in range(need[b])]
        plan = plain_differencing([cost(v) for v in n], need[b], False)
        heavy = sorted(plan, key=lambda g: (sum(cost(n[i]) for i in g), g[0] if g else 0), reverse=True)
        assert bins == heavy[::2][::-1] + heavy[1::2]
        assert [y["back"] for y in x] == list(range(len(x)))
        flat = sorted(x, key=lambda y: y["place"])
        assert [y["back"] for y in flat] == [i for g in bins for i in g] and [y["id"] for y in sorted(flat, key=lambda y: y["back"])] == [y["id"] for y in x]
    assert W.dynamic_batches(df.limit(0), "batch", "id", "n", 400).count() == 0
    with pytest.raises(Exception, match="longer than"):
        W.dynamic_batches(df.withColumn("n", F.lit(500)), "batch", "id", "n", 400).collect()
    with pytest.raises(Exception, match="can't fill"):
        W.dynamic_batches(df, "batch", "id", "n", 400, least=50).collect()
