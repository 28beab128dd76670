"""Findings of round 3: steps that took a group, or a small one each, to Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowforge.operators import vision as V


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_assignments_side_by_side_are_those_of_each():
    r = np.random.default_rng(5)
    for digits in (0, 1, 6):  # few digits: many ties
        n, m = r.integers(0, 7, 80), r.integers(0, 7, 80)
        cost = r.random((80, 7, 7)).round(digits)
        got = V.assign_many(cost, n, m)
        for k in range(80):
            i, j = V.assign(cost[k, : n[k], : m[k]])
            want = np.full(7, -1)
            want[i] = j
            assert (got[k] == want).all()
    assert sorted(np.concatenate(V.alike(n, m, 50))) == list(range(80)) and all(len(k) * n[k].max(initial=1) * m[k].max(initial=1) <= 50 or len(k) == 1 for k in V.alike(n, m, 50))


def test_images_are_matched_in_batches(spark):
    box = lambda x: [x, 0.0, x + 10, 10.0]
    truths = [(1, box(0.0)), (1, box(100.0)), (2, box(0.0)), (None, box(5.0))]
    preds = [(1, box(1.0), 0.9), (1, box(50.0), 0.8), (1, box(100.0), 0.1), (3, box(0.0), 0.2), (2, box(0.0), None), (2, box(0.0), float("nan")), (None, box(5.0), 0.5)]
    got = V.cgf1_images(spark.createDataFrame(truths, "image long, box array<double>"), spark.createDataFrame(preds, "image long, box array<double>, score double"), "image", 0.5, [0.5, 0.9])
    assert "FlatMapGroups" not in plan(got)
    assert {tuple(x) for x in got.collect()} == {(1, 0.5, 1, 1, 1, 2, 2), (1, 0.9, 0, 2, 2, 2, 2), (2, 0.5, 0, 0, 1, 1, 0), (2, 0.9, 0, 0, 1, 1, 0), (3, 0.5, 0, 0, 0, 0, 0), (3, 0.9, 0, 0, 0, 0, 0), (None, 0.5, 1, 0, 0, 1, 1), (None, 0.9, 1, 0, 0, 1, 1)}
    with pytest.raises(Exception, match="four numbers"):
        V.cgf1_images(spark.createDataFrame([(1, None)], "image long, box array<double>"), spark.createDataFrame(preds, "image long, box array<double>, score double"), "image").count()


def test_the_best_annotation_reads_its_rows_once(spark):
    rows = spark.range(12).select(F.floor(F.col("id") / 4).alias("image"), F.when(F.col("id") % 4 < 2, "a").otherwise("b").alias("who"), (F.col("id") % 2 / 2).alias("level"), *[(F.col("id") % 3).alias(c) for c in ("tp", "fp", "fn")])
    best = V.oracle_best(rows, "image", "who")
    assert plan(best).count("Range (") == 1 and best.columns == rows.columns
    assert best.count() == 6 and {x["image"] for x in best.collect()} == {0, 1, 2}


def test_sequences_are_matched_by_frames(spark):
    """No task gets a sequence; a null one counts, and frames without similarities do too."""
    truths = spark.createDataFrame([(s, t, i) for s in (1, None) for t in range(3) for i in range(2)], "seq long, t long, gt_id long")
    tracks = truths.withColumnRenamed("gt_id", "tr_id").where("t < 2")
    sims = truths.where("t < 1").select("seq", "t", "gt_id", F.col("gt_id").alias("tr_id"), F.lit(0.5).alias("sim"))
    got = V.hota_sequences(sims, truths, tracks, "seq")
    assert "FlatMapGroups" not in plan(got) and "FlatMapGroups" not in plan(V.matched_tracks(sims, truths, tracks, ["seq"]))
    rows = {(x["seq"], x["alpha"]): tuple(x)[2:] for x in got.collect()}
    # each truth is in three frames, each track in two, and they meet in one
    assert len(rows) == 38 and all(rows[s, 0.5] == (2.0, 4.0, 2.0, 1.0, 0.5) and rows[s, 0.55] == (0.0, 6.0, 4.0, 0.0, 0.0) for s in (1, None))


def test_teta_holds_no_sequence(spark):
    from rowforge.operators import tracking as K

    truths = spark.createDataFrame([(1, t, i, c) for t in range(3) for i, c in ((0, "a"), (1, None))], "seq long, t long, gt_id long, cls string")
    tracks = spark.createDataFrame([(1, t, 0, "b" if t else None) for t in range(3)], "seq long, t long, tr_id long, cls string")
    sims = truths.select("seq", "t", "gt_id", F.lit(0).cast("long").alias("tr_id"), F.lit(0.9).alias("sim"))
    counts = K.teta_counts(truths, tracks, sims, "seq")
    assert "FlatMapGroups" not in plan(counts)
    got = {(x["cls"], x["alpha"]): tuple(x)[2:] for x in counts.collect()}
    # b's two detections beside its truths, and twice as a wrong class; the one without a class is no class' false one
    assert {c for c, _ in got} == {"a", "b"} and got["a", 0.5] == (3.0, 0.0, 0.0, 3.0, 3.0, 3.0, 0.0, 3.0, 0.0) and got["b", 0.5] == (0.0,) * 8 + (4.0,) and got["b", 0.45] == (0.0,) * 9
