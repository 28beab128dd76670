"""Suppression of tracks and frames, and COCO's average precision and recall.

Overlaps come from joins on frames, so a video is spread over its frames; what Python gets are conflicts (pairs over the limit)
of one video or frame, or the boxes of some images. A frame with t boxes makes t * (t - 1) / 2 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.tables import written

from .vision import alike, padded, spread

# --- tracks and frames (V2) --------------------------------------------------------------------


def box_present(box: Column | str) -> Column:
    """Whether an (x, y, width, height) box is one: four numbers that aren't all zero or less."""
    b = F.col(box) if isinstance(box, str) else box
    return F.coalesce((F.size(b) >= 4) & F.exists(F.slice(b, 1, 4), lambda x: x > 0), F.lit(False))


def frame_pairs(rows: DataFrame, by: list[str], track: str, frame: str, box: str, score: str) -> DataFrame:
    """(by, frame, a, b, score_a, score_b, inter, union) of tracks a < b that both have a box in a frame."""
    x = rows.where(box_present(box) & F.col(track).isNotNull()).select(*by, frame, F.col(track).alias("__t"), F.col(score).alias("__s"), F.col(box).alias("__b"))
    l, r = x.alias("l"), x.alias("r")  # noqa: E741
    same = F.col("l.__t") < F.col("r.__t")
    for c in [*by, frame]:
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    at = lambda side, i: F.col(f"{side}.__b")[i]
    side = lambda i: F.greatest(F.lit(0.0), F.least(at("l", i) + at("l", i + 2), at("r", i) + at("r", i + 2)) - F.greatest(at("l", i), at("r", i)))
    inter = side(0) * side(1)
    union = at("l", 2) * at("l", 3) + at("r", 2) * at("r", 3) - inter
    return l.join(r, same).select(*[F.col(f"l.{c}").alias(c) for c in [*by, frame]], F.col("l.__t").alias("a"), F.col("r.__t").alias("b"), F.col("l.__s").alias("score_a"), F.col("r.__s").alias("score_b"), inter.alias("inter"), union.alias("union"))


def tube_overlaps(rows: DataFrame, by: list[str], track: str, frame: str, box: str, score: str) -> DataFrame:
    """(by, a, b, score_a, score_b, iou): intersections over unions, each summed over the frames where both tracks have a box (V2)."""
    pairs = frame_pairs(rows, by, track, frame, box, score)
    return pairs.groupBy(*by, "a", "b").agg(F.max("score_a").alias("score_a"), F.max("score_b").alias("score_b"), F.try_divide(F.sum("inter"), F.sum("union")).alias("iou")).where("iou IS NOT NULL")


def _greedy(group: np.ndarray, a: np.ndarray, b: np.ndarray, score_a: np.ndarray, score_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, id) that are suppressed by conflicts (a, b) of groups: from the highest score on, ties by id, one that stays suppresses those it conflicts with.

    All groups go on side by side: in a round, those that come before all others left in conflict with them stay. What a few long chains leave is done one by one.
    """
    score = np.nan_to_num(np.concatenate([score_a, score_b]), nan=-np.inf)
    g, ident = np.concatenate([group, group]), np.concatenate([a, b])
    order = np.lexsort((ident, g))
    new = np.concatenate([[True], (g[order][1:] != g[order][:-1]) | (ident[order][1:] != ident[order][:-1])]) if len(g) else np.zeros(0, bool)
    place = np.zeros(len(g), int)
    place[order] = np.cumsum(new) - 1
    first = order[new]
    by = np.lexsort((ident[first], -score[first], g[first]))
    rank = np.zeros(len(first), int)
    rank[by] = np.arange(len(first))
    i, j = rank[place[: len(a)]], rank[place[len(a) :]]
    i, j = np.minimum(i, j), np.maximum(i, j)  # nodes are named by their turn now
    gone, stays = np.zeros(len(first), bool), np.zeros(len(first), bool)
    for _ in range(64):
        if not len(i):
            break
        waits = np.zeros(len(first), bool)
        waits[j] = True
        lead = ~waits[i]
        stays[i[lead]] = True
        gone[j[lead]] = True
        left = ~(gone[i] | gone[j] | stays[i])
        i, j = i[left], j[left]
    if len(i):
        at = np.argsort(i, kind="stable")
        i, j = i[at], j[at]
        node, off = np.unique(i, return_index=True)
        for k, lo, hi in zip(node, off, np.append(off[1:], len(i)), strict=True):
            if not gone[k]:
                gone[j[lo:hi]] = True
    out = first[by[gone]]
    return g[out], ident[out]


def suppressed(conflicts: DataFrame, by: list[str]) -> DataFrame:
    """(by, id) of what a greedy choice in each group drops; groups without conflicts aren't looked at, the others go to Python a batch at once."""
    schema = T.StructType([*[conflicts.schema[c] for c in by], T.StructField("__t", conflicts.schema["a"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(by))
            n, flat = x.value_lengths().to_numpy(), x.flatten()
            a, b = (flat.field(c) for c in ("a", "b"))
            score = [flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("score_a", "score_b")]
            ids = pa.concat_arrays([a, b])
            code = ids.dictionary_encode() if not pa.types.is_integer(ids.type) else None
            if code is None:
                num = ids.to_numpy()
            else:  # by their order, as ties go by id
                sort = pa.compute.sort_indices(code.dictionary).to_numpy()
                turn = np.empty(len(sort), int)
                turn[sort] = np.arange(len(sort))
                num = turn[code.indices.to_numpy()]
            g, t = _greedy(np.repeat(np.arange(len(n)), n), num[: len(a)], num[len(a) :], *score)
            gone = pa.array(t, ids.type) if code is None else code.dictionary.take(pa.array(sort[t]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(g)) for c in range(len(by))], gone], names=schema.names)

    return spread(conflicts.select(*by, "a", "b", "score_a", "score_b"), *by).groupBy(*by).agg(F.collect_list(F.struct("a", "b", "score_a", "score_b"))).mapInArrow(run, schema)


def _without(rows: DataFrame, gone: DataFrame, by: list[str], track: str, box: str) -> DataFrame:
    """rows whose box is null where (by, track) is in gone."""
    marked = rows.join(gone.withColumnRenamed("__t", track).withColumn("__gone", F.lit(True)), [*by, track], "left")
    return marked.withColumn(box, F.when(F.col("__gone").isNull(), F.col(box))).select(*rows.columns)


def suppress_tracks(rows: DataFrame, by: list[str], track: str, frame: str, box: str, score: str, limit: float) -> DataFrame:
    """rows (by, track, frame, box as x, y, width, height, score) with null boxes for tracks whose tube overlaps one that stays by `limit` or more (V2).

    Defined cases: a null box, or one without a positive number, is an absent frame; tracks that share no frame don't meet; null
    scores come last; ties go by id; a null track or key meets nothing; an empty table stays empty. Conflicts of one video (`by`) go to one task.
    """
    conflicts = tube_overlaps(rows, by, track, frame, box, score).where(F.col("iou") >= limit)
    return _without(rows, suppressed(conflicts, by), by, track, box)


def suppress_frames(rows: DataFrame, by: list[str], track: str, frame: str, box: str, score: str, limit: float) -> DataFrame:
    """As suppress_tracks, but each frame by itself: a track may lose some of its boxes and keep others (V2)."""
    conflicts = frame_pairs(rows, by, track, frame, box, score).where((F.col("union") > 0) & (F.col("inter") / F.col("union") >= limit))
    return _without(rows, suppressed(conflicts, [*by, frame]), [*by, frame], track, box)


# --- COCO average precision and recall (V7) ----------------------------------------------------

LEVELS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
#: Areas in pixels, both ends included, and the most predictions of an image that count.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
CAPS = (1, 10, 100)
#: Rows that are ranked in one task.
RANGE_ROWS = 500_000
_RECALLS = np.linspace(0, 1, 101)


def _boxes(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 4)


def _overlap(p: np.ndarray, t: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """IoU of predictions (..., n, 4) and truths (..., m, 4); with a crowd, the share of the prediction that lies in it."""
    w = np.minimum(p[..., :, None, 2], t[..., None, :, 2]) - np.maximum(p[..., :, None, 0], t[..., None, :, 0])
    h = np.minimum(p[..., :, None, 3], t[..., None, :, 3]) - np.maximum(p[..., :, None, 1], t[..., None, :, 1])
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    size = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    own = size(p)[..., :, None] + np.zeros(t.shape[-2])
    whole = np.where(crowd[..., None, :], own, own + size(t)[..., None, :] - inter)
    return np.divide(inter, whole, out=np.zeros_like(inter), where=whole > 0)


def match_images(p: np.ndarray, t: np.ndarray, area: np.ndarray, crowd: np.ndarray, n: np.ndarray, m: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Codes (image, prediction, area range, level) of the n predictions of each image, best first, and its m truths: 1 a hit, 0 a false one, 2 not counted.

    A prediction takes the free truth it overlaps most, the last of equals; truths outside the range and crowds are taken only if no other reaches
    the level, and then it isn't counted. A crowd can be taken any number of times. Unmatched predictions outside the range don't count.
    """
    lo, hi = (np.array([r[i] for r in AREAS.values()]) for i in (0, 1))
    own = (p[..., 2] - p[..., 0]) * (p[..., 3] - p[..., 1])
    codes = np.where((own[..., None] < lo) | (own[..., None] > hi), 2, 0)[..., None] + np.zeros(len(levels), int)
    here = np.arange(t.shape[1])[None, :] < m[:, None]
    if not here.any():
        return codes
    ignored = (crowd[:, None, :] | (area[:, None, :] < lo[:, None]) | (area[:, None, :] > hi[:, None]))[:, :, None, :]
    sim = np.where(here[:, None, :], _overlap(p, t, crowd), -1.0)
    free = np.ones((len(p), len(AREAS), len(levels), t.shape[1]), bool)
    want = np.minimum(levels, 1 - 1e-10)[None, None, :]
    last = t.shape[1] - 1
    reach = (sim.max(2) >= want.min()) & (np.arange(p.shape[1])[None, :] < n[:, None])
    for d in range(p.shape[1]):
        k = np.flatnonzero(reach[:, d])
        if not len(k):
            continue
        hit = np.zeros((len(k), len(AREAS), len(levels)), bool)
        for stage, usable in ((1, free[k] & ~ignored[k]), (2, (free[k] | crowd[k][:, None, None, :]) & ignored[k])):
            s = np.where(usable, sim[k, d][:, None, None, :], -1.0)
            j = last - s[..., ::-1].argmax(3)
            took = (np.take_along_axis(s, j[..., None], 3)[..., 0] >= want) & ~hit
            i, x, y = np.nonzero(took)
            codes[k[i], d, x, y] = stage
            free[k[i], x, y, j[took]] = False
            hit |= took
    return codes


def match_image(p: np.ndarray, t: np.ndarray, area: np.ndarray, crowd: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """match_images for one image: codes (prediction, area range, level)."""
    return match_images(p[None], t[None], area[None], crowd[None], np.array([len(p)]), np.array([len(t)]), levels)[0]


def coco_matches(truths: DataFrame, predictions: DataFrame, image: str, cls: str, levels: list[float] | None = None) -> DataFrame:
    """(image, cls, prediction_id, score, place, codes): predictions matched within their image and class (V7).

    truths: image, cls, truth_id, box (corners), and, where given, area and crowd; predictions: image, cls, prediction_id, score, box.
    codes: a byte for each area range and level, as match_image gives; place: 0 for an image's best prediction, the first max(CAPS) are matched.

    Defined cases: null or NaN scores and boxes without four numbers take no part; equal scores go by prediction_id; images without predictions have no rows.
    """
    at = np.array(LEVELS if levels is None else levels)
    good = lambda df: df.where((F.size("box") == 4) & ~F.exists("box", lambda x: x.isNull() | F.isnan(x.cast("double"))))
    has = lambda c, other: F.col(c) if c in truths.columns else other
    size = (F.col("box")[2] - F.col("box")[0]) * (F.col("box")[3] - F.col("box")[1])
    t = good(truths).select(image, cls, F.struct("truth_id", F.col("box").cast("array<double>").alias("box"), has("area", size).cast("double").alias("area"), F.coalesce(has("crowd", F.lit(False)).cast("boolean"), F.lit(False)).alias("crowd")).alias("x"))
    t = t.groupBy(image, cls).agg(F.array_sort(F.collect_list("x")).alias("truths"))
    p = good(predictions).where(F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))
    p = p.select(image, cls, F.struct((-F.col("score").cast("double")).alias("s"), "prediction_id", F.col("box").cast("array<double>").alias("box")).alias("x")).groupBy(image, cls).agg(F.slice(F.array_sort(F.collect_list("x")), 1, max(CAPS)).alias("predictions"))
    schema = T.StructType([truths.schema[image], truths.schema[cls], predictions.schema["prediction_id"], T.StructField("score", T.DoubleType()), T.StructField("place", T.IntegerType()), T.StructField("codes", T.BinaryType())])
    names, width = schema.names, len(AREAS) * len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side = [b.column(i) for i in (2, 3)]
            n, m = (s.value_lengths().fill_null(0).to_numpy() for s in side)
            ps, ts = (s.flatten() for s in side)
            pb, tb = _boxes(ps.field("box")), _boxes(ts.field("box")) if len(ts) else np.zeros((0, 4))
            area, crowd = (ts.field(c).to_numpy(zero_copy_only=False) if len(ts) else np.zeros(0) for c in ("area", "crowd"))
            crowd = crowd.astype(bool)
            pe, te = np.cumsum(n), np.cumsum(m)
            row = np.repeat(np.arange(b.num_rows), n)
            place = np.arange(len(row)) - np.repeat(pe - n, n)
            codes = np.zeros((len(row), width), np.uint8)
            for k in alike(n, m * width, 1 << 19):
                of = lambda x: padded(x, te[k] - m[k], m[k])  # noqa: B023, E731
                got = match_images(padded(pb, pe[k] - n[k], n[k]), of(tb), of(area), of(crowd), n[k], m[k], at)
                rows = np.repeat(pe[k] - n[k], n[k]) + np.arange(n[k].sum()) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
                codes[rows] = got[np.arange(got.shape[1])[None, :] < n[k][:, None]].reshape(-1, width)
            flat = [c.tobytes() for c in codes]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), ps.field("prediction_id"), pa.array(-ps.field("s").to_numpy(zero_copy_only=False)), pa.array(place.astype(np.int32)), pa.array(flat, pa.binary())], names=names)

    # an image's boxes are few bytes and dear, so images are spread; a batch of them is matched at once
    return spread(p.join(t, [image, cls], "left").select(image, cls, "predictions", "truths"), image, cls).mapInArrow(run, schema)


def _truth_counts(truths: DataFrame, cls: str) -> DataFrame:
    """(cls, area, truths): those that count, of each class and area range."""
    size = (F.col("box")[2] - F.col("box")[0]) * (F.col("box")[3] - F.col("box")[1])
    area = F.col("area") if "area" in truths.columns else size
    counts = ~F.coalesce(F.col("crowd").cast("boolean"), F.lit(False)) if "crowd" in truths.columns else F.lit(True)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("area"), (counts & area.between(lo, hi)).cast("long").alias("n")) for i, (lo, hi) in enumerate(AREAS.values())])).alias("x")
    good = truths.where((F.size("box") == 4) & ~F.exists("box", lambda x: x.isNull() | F.isnan(x.cast("double"))))
    return good.select(cls, each).groupBy(cls, F.col("x.area").alias("area")).agg(F.sum("x.n").alias("truths"))


def coco_scores(truths: DataFrame, predictions: DataFrame, image: str, cls: str, levels: list[float] | None = None) -> DataFrame:
    """(cls, area, level, ap, ar_1, ar_10, ar_100) of each class and area range that has truths (V7).

    Predictions of a class are ranked over ranges of scores: each range counts its hits and false ones, prefix sums tell a
    range what came before it, and each gives the best precision of every hundredth of recall. So no task ranks a class.
    """
    levels = LEVELS if levels is None else levels
    combos = len(AREAS) * len(levels)
    matches = coco_matches(truths, predictions, image, cls, levels).withColumn("__down", -F.col("score"))
    order = [cls, "__down", image, "prediction_id"]
    matches = written(matches, "coco-matches")  # read by the ranges and again by the ranks
    ranges = max(1, -(-matches.count() // RANGE_ROWS))
    ranked = written((matches.repartitionByRange(ranges, *order) if ranges > 1 else matches.coalesce(1)).withColumn("part", F.spark_partition_id()), "coco-ranges")
    long_ = "array<bigint>"
    kind = truths.schema[cls]

    def counts(key: tuple, t: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(-1, combos)
        place = t["place"].to_numpy()
        hit = codes == 1
        caps = [hit[place < c].sum(0) for c in CAPS]
        return pa.table([pa.array([key[0].as_py()], key[0].type), pa.array([key[1].as_py()], pa.int32()), *[pa.array([x.astype(np.int64).tolist()], pa.list_(pa.int64())) for x in (*caps, (codes == 0).sum(0))]], names=[cls, "part", *[f"tp_{c}" for c in CAPS], "fp"])

    sums = ranked.groupBy(cls, "part").applyInArrow(counts, T.StructType([kind, T.StructField("part", T.IntegerType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in (*[f"tp_{c}" for c in CAPS], "fp")]]))
    fields = [f"tp_{c}" for c in CAPS] + ["fp"]
    each = written(sums.select(cls, "part", F.posexplode(F.arrays_zip(*fields)).alias("combo", "x")).select(cls, "part", "combo", "x.*"), "coco-sums")
    n_truths = _truth_counts(truths, cls).where("truths > 0")
    area = F.floor(F.col("combo") / len(levels)).cast("int")
    upto = Window.partitionBy(cls, "combo").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = each.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in (f"tp_{max(CAPS)}", "fp")}).withColumn("area", area).join(n_truths, [cls, "area"])
    before = before.select(cls, "part", "combo", F.col(f"before_tp_{max(CAPS)}").alias("tp"), F.col("before_fp").alias("fp"), "truths")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({cls: pa.array([], left.schema.field(cls).type), "combo": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "precision": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty
        left = left.sort_by([(c, "ascending") for c in order])
        codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(-1, combos)
        combo, tp0, fp0, n = (right[c].to_numpy() for c in ("combo", "tp", "fp", "truths"))
        hit, miss = codes[:, combo] == 1, codes[:, combo] == 0
        tp, fp = np.cumsum(hit, 0) + tp0, np.cumsum(miss, 0) + fp0
        r, c = np.nonzero(hit)
        precision = tp[r, c] / (tp[r, c] + fp[r, c])
        bucket = np.searchsorted(_RECALLS, tp[r, c] / n[c], "right") - 1
        top = np.full((len(combo), len(_RECALLS)), -1.0)
        np.maximum.at(top, (c, bucket), precision)
        k, j = np.nonzero(top >= 0)
        if not len(k):
            return empty
        return pa.table({cls: pa.array([left[cls][0].as_py()] * len(k), left.schema.field(cls).type), "combo": combo[k].astype(np.int32), "bucket": j.astype(np.int32), "precision": top[k, j]})

    slim = ranked.select(*dict.fromkeys([*order, "codes", "part"]))
    tops = slim.groupBy(cls, "part").cogroup(before.groupBy(cls, "part")).applyInArrow(best, T.StructType([kind, T.StructField("combo", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("precision", T.DoubleType())]))
    tops = tops.groupBy(cls, "combo", "bucket").agg(F.max("precision").alias("precision"))
    of = Window.partitionBy(cls, "combo")  # 101 rows at most
    envelope = F.max("precision").over(of.orderBy(F.col("bucket").desc()))
    steps = F.col("bucket") - F.coalesce(F.lag("bucket").over(of.orderBy("bucket")), F.lit(-1))
    ap = tops.select(cls, "combo", (envelope * steps).alias("x")).groupBy(cls, "combo").agg((F.sum("x") / len(_RECALLS)).alias("ap"))
    found = each.groupBy(cls, "combo").agg(*[F.sum(f"tp_{c}").alias(f"tp_{c}") for c in CAPS])
    grid = n_truths.withColumn("combo", F.explode(F.sequence(F.col("area") * len(levels), F.col("area") * len(levels) + len(levels) - 1)))
    out = grid.join(found, [cls, "combo"], "left").join(ap, [cls, "combo"], "left")
    name = F.element_at(F.array(*map(F.lit, AREAS)), F.col("area") + 1)
    level = F.element_at(F.array(*map(F.lit, levels)), F.col("combo") % len(levels) + 1)
    return out.select(cls, name.alias("area"), level.alias("level"), F.coalesce("ap", F.lit(0.0)).alias("ap"), *[(F.coalesce(F.col(f"tp_{c}"), F.lit(0)) / F.col("truths")).alias(f"ar_{c}") for c in CAPS])


def coco_summary(scores: DataFrame) -> DataFrame:
    """The twelve numbers of a COCO report (name, value) from coco_scores; -1 where no class has truths (V7)."""
    rows = {"AP": ("ap", "all", None), "AP50": ("ap", "all", 0.5), "AP75": ("ap", "all", 0.75), **{f"AP_{a}": ("ap", a, None) for a in ("small", "medium", "large")}}
    rows |= {f"AR_{c}": (f"ar_{c}", "all", None) for c in CAPS} | {f"AR_{a}": (f"ar_{max(CAPS)}", a, None) for a in ("small", "medium", "large")}
    value = lambda c, a, lv: F.coalesce(F.avg(F.when((F.col("area") == a) & (F.lit(lv is None) | (F.col("level") == F.lit(lv))), F.col(c))), F.lit(-1.0))
    return scores.agg(*[value(*v).alias(k) for k, v in rows.items()]).unpivot([], list(rows), "name", "value")
