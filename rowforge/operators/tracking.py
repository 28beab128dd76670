"""Tracking every thing everywhere: localisation, association and classification scores from detections.

Tracks of all classes are matched to the truths of each class, so a right track with a wrong class still counts as localised and
associated. A group is one sequence and class: its truths, and the detections that overlap one of them or are of that class. Frames are
matched in batches; all sums over a group are Spark's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.tables import written

from .vision import ALPHAS, alphas_reached, matched_tracks, track_frames

COUNTS = ["loc_tp", "loc_fn", "loc_fp", "ass_sum", "ass_re_sum", "ass_pr_sum", "cls_tp", "cls_fn", "cls_fp"]


def teta_counts(truths: DataFrame, tracks: DataFrame, similarities: DataFrame, seq: str, threshold: float = 0.5, exhaustive: bool = True) -> DataFrame:
    """(cls, alpha, COUNTS), summed over sequences.

    truths: seq, t, gt_id (long), cls (string); tracks: seq, t, tr_id (long), cls; similarities: seq, t, gt_id, tr_id, sim of a truth and a track of
    one frame (zeros left out). A detection overlaps a class if its similarity to one of its truths is `threshold` or more; of a class' frames,
    overlapping detections that match nothing are false ones. Where annotation is exhaustive, detections of a class that overlap none of its truths are too.

    Defined cases: classes that only tracks name have counts only where annotation is exhaustive; a null class takes no part; an empty table gives no rows.
    """
    sims = similarities.join(truths.select(seq, "t", "gt_id", "cls"), [seq, "t", "gt_id"])
    over = sims.where(F.col("sim") >= threshold).select(seq, "t", "tr_id", "cls").distinct().withColumn("over", F.lit(True))
    named = tracks.select(seq, "t", "tr_id", F.col("cls").alias("tr_cls"))
    seen = over.select(seq, "t", "tr_id", "cls").unionByName(tracks.select(seq, "t", "tr_id", "cls")).distinct().where("cls IS NOT NULL")
    dets = seen.join(over, [seq, "t", "tr_id", "cls"], "left").join(named, [seq, "t", "tr_id"])
    group = [seq, "cls"]
    g = truths.where("cls IS NOT NULL").select(seq, "cls", "t", "gt_id")
    dets = written(dets.select(seq, "cls", "t", "tr_id", "tr_cls", F.coalesce("over", F.lit(False)).alias("over")), "teta-detections")
    # where no detection overlaps a truth, none is matched
    some = dets.where("over").select(*group).distinct()
    met = matched_tracks(sims.join(dets, [seq, "t", "tr_id", "cls"]).join(some, group, "left_semi").select(*group, "t", "gt_id", "tr_id", "sim", "tr_cls", "over"), g, dets, group)
    met = met.groupBy(*group, "gt_id", "tr_id", "tr_cls", "over", alphas_reached(F.col("sim")).alias("k")).agg(F.count("*").alias("n")).where("k > 0")
    met = written(met.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).groupBy(*group, "gt_id", "tr_id", "tr_cls", "over", "k").agg(F.sum("n").alias("n")), "teta-matches")
    alpha = F.element_at(F.array(*map(F.lit, ALPHAS)), F.col("k") + 1)
    hard, right, n = alpha >= 0.5, F.col("tr_cls").eqNullSafe(F.col("cls")), F.col("n")
    only = lambda c, x=n: F.when(c, x).otherwise(0)
    none = F.lit(0).cast("double")

    def part(rows: DataFrame, **values) -> DataFrame:
        return rows.select("cls", "k", *[values.get(c, none).cast("double").alias(c) for c in COUNTS])

    every = lambda rows: rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(ALPHAS) - 1))))
    pairs = met.groupBy(*group, "gt_id", "tr_id", "k").agg(F.sum("n").alias("n")).join(track_frames(g, group, "gt_id", "gc"), [*group, "gt_id"]).join(track_frames(dets, group, "tr_id", "rc"), [*group, "tr_id"])
    share = lambda whole: n * n / F.greatest(F.lit(1), whole)
    wrong = met.where(hard & F.col("tr_cls").isNotNull() & ~right).select(F.col("tr_cls").alias("cls"), "k", "n")
    sides = dets.groupBy("cls").agg(F.count_if("over").alias("over"), F.count_if(~F.col("over")).alias("beside"))
    parts = [
        part(every(g.groupBy("cls").agg(F.count("*").alias("n"))), loc_fn=n),
        part(every(sides), loc_fp=F.col("over"), cls_fp=F.when(hard, F.col("beside")).otherwise(0) if exhaustive else none),
        part(met, loc_tp=n, loc_fn=-n, loc_fp=only(F.col("over"), -n), cls_tp=only(hard & right), cls_fn=only(hard & ~right)),
        part(wrong, cls_fp=n),
        part(pairs, ass_sum=share(F.col("gc") + F.col("rc") - n), ass_re_sum=share(F.col("gc")), ass_pr_sum=share(F.col("rc"))),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("cls", "k").agg(*[F.sum(c).alias(c) for c in COUNTS]).select("cls", alpha.alias("alpha"), *COUNTS)


def teta_scores(counts: DataFrame) -> DataFrame:
    """(cls, loc_a, ass_a, cls_a, teta): means over thresholds, of 0.5 and more for classification."""
    f = lambda a, b, c: F.col(a) / F.greatest(F.lit(1.0), F.col(a) + F.col(b) + F.col(c))
    loc = F.avg(f("loc_tp", "loc_fn", "loc_fp"))
    ass = F.avg(F.col("ass_sum") / F.greatest(F.lit(1.0), F.col("loc_tp")))
    named = F.avg(F.when(F.col("alpha") >= 0.5, f("cls_tp", "cls_fn", "cls_fp")))
    return counts.groupBy("cls").agg(loc.alias("loc_a"), ass.alias("ass_a"), named.alias("cls_a")).withColumn("teta", (F.col("loc_a") + F.col("ass_a") + F.col("cls_a")) / 3)
