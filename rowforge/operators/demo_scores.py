"""Scores of thresholded predictions against the best of several annotations (V8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .detection import LEVELS, _boxes, _overlap
from .vision import alike, assign_many, padded, spread

_E = 1e-4


def demo_images(images: DataFrame, truths: DataFrame, predictions: DataFrame, image: str, annotators: list[str], threshold: float = 0.5, levels: list[float] | None = None) -> DataFrame:
    """(image, annotator, n_gt, n_pred, j, f1, counts): each annotation's outcome of each image (V8).

    images: image (a picture and phrase); truths: image, annotator, box (corners), and where given crowd and ignore; predictions: image, score,
    box. Predictions of a score of `threshold` and more are matched to truths by the assignment with the greatest overlap. counts holds level, tp,
    fp, fn and f1 for each level; j is the mean overlap of matched pairs, null without any; f1 is the mean over levels, null where both sides are empty.

    Defined cases: images without truths or predictions have rows; truths marked ignore, null scores and boxes without four numbers take no part.
    """
    at = LEVELS if levels is None else levels
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in truths.columns else F.lit(False)
    good = lambda df: df.where((F.size("box") == 4) & ~F.exists("box", lambda x: x.isNull()))
    t = good(truths.where(~flag("ignore"))).groupBy(image, "annotator").agg(F.array_sort(F.collect_list(F.struct(F.col("box").cast("array<double>").alias("box"), flag("crowd").alias("crowd")))).alias("truths"))
    p = good(predictions.where(F.col("score") >= threshold)).groupBy(image).agg(F.array_sort(F.collect_list(F.struct(F.col("box").cast("array<double>").alias("box")))).alias("predictions"))
    base = images.select(image).distinct().withColumn("annotator", F.explode(F.array(*map(F.lit, annotators))))
    rows = base.join(p, image, "left").join(t, [image, "annotator"], "left").select(image, "annotator", "predictions", "truths")
    level = T.StructType([T.StructField("level", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn")], T.StructField("f1", T.DoubleType())])
    schema = T.StructType([images.schema[image], T.StructField("annotator", T.StringType()), T.StructField("n_gt", T.LongType()), T.StructField("n_pred", T.LongType()), T.StructField("j", T.DoubleType()), T.StructField("f1", T.DoubleType()), T.StructField("counts", T.ArrayType(level))])

    def outcome(got: np.ndarray | None, n: int, m: int) -> tuple:
        if not n and not m:
            return None, None, None
        tps = (got[:, None] >= np.array(at)).sum(0).tolist() if len(got) else [0] * len(at)
        out = []
        for lv, tp in zip(at, tps, strict=True):
            fp, fn = n - tp, m - tp
            pr, rc = tp / (tp + fp + _E), tp / (tp + fn + _E)
            out.append({"level": lv, "tp": tp, "fp": fp, "fn": fn, "f1": 2 * pr * rc / (pr + rc + _E)})
        return (float(got.mean()) if len(got) else None), float(np.mean([x["f1"] for x in out])), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(i).value_lengths().fill_null(0).to_numpy() for i in (2, 3))
            ps, ts = b.column(2).flatten(), b.column(3).flatten()
            pb, tb = (_boxes(x.field("box")) if len(x) else np.zeros((0, 4)) for x in (ps, ts))
            crowd = ts.field("crowd").to_numpy(zero_copy_only=False).astype(bool) if len(ts) else np.zeros(0, bool)
            p_off, t_off = np.cumsum(n) - n, np.cumsum(m) - m
            got: list = [np.zeros(0)] * b.num_rows
            for k in alike(n, m):
                if n[k].max() and m[k].max():
                    of = lambda x: padded(x, t_off[k], m[k])  # noqa: B023, E731
                    sim = _overlap(padded(pb, p_off[k], n[k]), of(tb), of(crowd))
                    to = assign_many(-sim, n[k], m[k])
                    best = np.take_along_axis(sim, np.maximum(to, 0)[:, :, None], 2)[:, :, 0]
                    for i, row in enumerate(k):
                        got[row] = best[i, to[i] >= 0]
            found = [outcome(x, int(i), int(j)) for x, i, j in zip(got, n, m, strict=True)]
            kind = pa.list_(pa.struct([("level", pa.float64()), ("tp", pa.int64()), ("fp", pa.int64()), ("fn", pa.int64()), ("f1", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], kind)], names=schema.names)

    return spread(rows, image).mapInArrow(run, schema)


def demo_best(scored: DataFrame, image: str, annotators: list[str]) -> DataFrame:
    """Of each image the annotation that fits best: one that is as empty as the predictions, else that with the greatest mean F1, the first of equals (V8)."""
    place = F.array_position(F.array(*map(F.lit, annotators)), F.col("annotator"))
    row = F.struct(*[F.col(c) for c in scored.columns])
    return scored.groupBy(image).agg(F.min_by(row, F.struct(F.col("f1").isNotNull(), -F.coalesce("f1", F.lit(0.0)), place)).alias("x")).select("x.*")


def demo_totals(best: DataFrame, levels: list[float] | None = None) -> DataFrame:
    """One row a level: counts, precision, recall, F1, their forms over images with truths, image-level scores and the products (V8)."""
    at = LEVELS if levels is None else levels
    none = F.array(*[F.struct(F.lit(v).alias("level"), *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn")], F.lit(None).cast("double").alias("f1")) for v in at])
    rows = best.select("n_gt", "n_pred", "j", F.explode(F.coalesce("counts", none)).alias("x")).select("n_gt", "n_pred", "j", "x.*")
    pos, some = F.col("n_gt") > 0, F.col("n_pred") > 0
    perfect = (F.col("fp") == 0) & (F.col("fn") == 0)
    s = rows.groupBy("level").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.sum(F.when(pos, F.col("fp")).otherwise(0)).alias("pm_fp"),
        F.sum(F.when(pos, F.col("f1"))).alias("f1_sum"), F.count_if(pos & some).alias("n_f1"), F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"),
        F.count_if(pos & some).alias("il_tp"), F.count_if(~pos & some).alias("il_fp"), F.count_if(~pos & ~some).alias("il_tn"), F.count_if(pos & ~some).alias("il_fn"),
        F.count_if(pos & perfect).alias("perfect_pos"), F.count_if(~pos & perfect).alias("perfect_neg"), F.coalesce(F.avg("j"), F.lit(0.0)).alias("j"),
    )
    c = {k: F.col(k).cast("double") for k in s.columns}
    f1 = lambda p, r: 2 * p * r / (p + r + _E)
    precision, positive, recall = c["tp"] / (c["tp"] + c["fp"] + _E), c["tp"] / (c["tp"] + c["pm_fp"] + _E), c["tp"] / (c["tp"] + c["fn"] + _E)
    i_rec, i_pre = c["il_tp"] / (c["il_tp"] + c["il_fn"] + 1e-6), c["il_tp"] / (c["il_tp"] + c["il_fp"] + 1e-6)
    mcc = (c["il_tp"] * c["il_tn"] - c["il_fp"] * c["il_fn"]) / (F.sqrt((c["il_tp"] + c["il_fp"]) * (c["il_tp"] + c["il_fn"]) * (c["il_tn"] + c["il_fp"]) * (c["il_tn"] + c["il_fn"])) + 1e-6)
    out = s.select(
        "level", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"), f1(positive, recall).alias("positive_micro_f1"),
        F.try_divide(c["f1_sum"], c["n_f1"]).alias("positive_macro_f1"), F.try_divide(c["f1_sum"], c["n_pos"]).alias("positive_w0dt_macro_f1"),
        i_rec.alias("il_recall"), i_pre.alias("il_precision"), (2 * i_pre * i_rec / (i_pre + i_rec + 1e-6)).alias("il_f1"), (c["il_fp"] / (c["il_fp"] + c["il_tn"] + 1e-6)).alias("il_fpr"), mcc.alias("il_mcc"),
        (c["perfect_pos"] / (c["n_pos"] + 1e-9)).alias("il_perfect_pos"), (c["perfect_neg"] / (c["n_neg"] + 1e-9)).alias("il_perfect_neg"), "j",
    )
    return out.withColumns({"cgf1": F.col("positive_macro_f1") * F.col("il_mcc"), "cgf1_w0dt": F.col("positive_w0dt_macro_f1") * F.col("il_mcc"), "cgf1_micro": F.col("positive_micro_f1") * F.col("il_mcc")})
