"""Aggregations that share a group between tasks, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowforge.operators import aggregate as A


@pytest.mark.parametrize("few", [10**6, 0])
def test_average_precision_by_ranges(spark, monkeypatch, few):
    monkeypatch.setattr(A, "FEW_GROUPS", few)
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, 0.5, 0.5, float(r.randrange(20)), r.random()]), r.choice([True, False, None])) for i in range(600)] + [(1000, "none", 0.1, False)]
    df = spark.createDataFrame(rows, "id long, g string, score double, hit boolean")
    got = {x["g"]: (x["precision_sum"], x["hits"], x["ap"]) for x in A.average_precision(df, ["g"], "score", "hit", F.count("*"), ["id"], bins=8).collect()}
    for g in ("a", "b", None, "none"):
        mine = sorted((x for x in rows if x[1] == g), key=lambda x: (x[2] is None, -(x[2] or 0), x[0]))
        hits, total = 0, 0.0
        for n, x in enumerate(mine, 1):
            if x[3]:
                hits += 1
                total += hits / n
        assert got[g] == (pytest.approx(total), hits, pytest.approx(total / len(mine)))


def test_bootstrap_of_groups(spark):
    r = np.random.default_rng(2)
    rows = [(i, ["x", "y", None][i % 3], float(v)) for i, v in enumerate(r.normal(size=900))] + [(5000, "empty", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    one = {x["g"]: tuple(x)[1:] for x in A.bootstrap_ci(df, ["g"], "v", "id", 400, linear=True).collect()}
    two = {x["g"]: tuple(x)[1:] for x in A.bootstrap_ci(df.repartition(7), ["g"], "v", "id", 400, linear=True).collect()}
    assert set(one) == {"x", "y", None, "empty"} and one["empty"] == (None, 0, None, None)
    for g in ("x", "y", None):
        v = np.array([x[2] for x in rows if x[1] == g])
        mean, n, low, high = one[g]
        assert two[g] == pytest.approx(one[g]) and n == 300 and mean == pytest.approx(v.mean())
        assert abs((high - low) / (2 * 1.96 * v.std() / 300**0.5) - 1) < 0.25 and low < mean < high


def test_majority_of_drawn_answers(spark):
    r = random.Random(4)
    rows = [("s", "u", r.random(), r.choice("abc"), i) for i in range(7)]
    df = spark.createDataFrame(rows, "source string, uid string, v double, a string, pos long")
    got = {x["metric"]: x["value"] for x in A.validation_metrics(df, "source", "uid", "v", "a", "pos", repeats=60, seed=5).collect()}
    rng = np.random.default_rng(5)
    for m in (2, 4, 7):
        said = []
        for p in rng.integers(0, 7, (60, m)):
            answers = [rows[i][3] for i in p]
            best = max(dict.fromkeys(answers), key=lambda x: (answers.count(x), -answers.index(x)))
            said.append(rows[p[answers.index(best)]][2])
        assert got[f"maj@{m}/mean"] == pytest.approx(np.mean(said)) and got[f"maj@{m}/std"] == pytest.approx(np.std(said))
