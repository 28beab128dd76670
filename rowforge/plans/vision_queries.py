"""Queries of track suppression and detection scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.operators import detection as D
from rowforge.operators import vision as V

from .metric_queries import _detections
from .registry import query

#: Tracks that move from side to side: one row a video, frame and track; boxes of zeros and null ones are absent frames.
_TRACKS_SQL = """r AS (SELECT l_orderkey % 300 AS video, l_orderkey // 300 AS frame, CAST(l_linenumber AS BIGINT) AS track, max(l_discount) AS d, max(l_tax) AS t FROM lineitem GROUP BY ALL),
    b AS (SELECT video, frame, track, (track * 7 + video) % 5 / 10 AS score, CASE WHEN d = 0 THEN 0 ELSE 20 * (track % 3) + (frame % 2) * (track % 2) * 8 + d * 100 END AS x, CASE WHEN d = 0 THEN 0 ELSE 5 * (track % 2) END AS y, CASE WHEN d = 0 THEN 0 ELSE 20 + t * 100 END AS w, t = 0.05 AS absent FROM r),
    v AS (SELECT * FROM b WHERE NOT absent AND (x > 0 OR y > 0 OR w > 0)),
    i AS (SELECT l.video, l.frame, l.track AS a, r.track AS b, greatest(0.0, least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x)) * greatest(0.0, least(l.y + l.w, r.y + r.w) - greatest(l.y, r.y)) AS inter, l.w * l.w + r.w * r.w AS areas FROM v l JOIN v r ON l.video = r.video AND l.frame = r.frame AND l.track < r.track)"""


def _tracks(t):
    r = t("lineitem").select((F.col("l_orderkey") % 300).alias("video"), F.floor(F.col("l_orderkey") / 300).alias("frame"), F.col("l_linenumber").cast("long").alias("track"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t")).groupBy("video", "frame", "track").agg(F.max("d").alias("d"), F.max("t").alias("t"))
    track, frame, none = F.col("track"), F.col("frame"), F.col("d") == 0
    x = F.when(none, 0.0).otherwise(20 * (track % 3) + (frame % 2) * (track % 2) * 8 + F.col("d") * 100)
    y, w = F.when(none, 0.0).otherwise(5 * (track % 2)), F.when(none, 0.0).otherwise(20 + F.col("t") * 100)
    return r.select("video", "frame", "track", ((track * 7 + F.col("video")) % 5 / 10).alias("score"), F.when(F.col("t") == 0.05, None).otherwise(F.array(x, y, w, w)).alias("box"))


@query("v2_tube_overlaps", f"WITH {_TRACKS_SQL} SELECT video, a, b, round(sum(inter) / sum(areas - inter), 9) AS iou FROM i GROUP BY ALL")
def _(t):
    return D.tube_overlaps(_tracks(t), ["video"], "track", "frame", "box", "score").select("video", "a", "b", F.round("iou", 9).alias("iou"))


def _greedy_sql(by: str, conflicts: str, nodes: str) -> str:
    """Walks down the scores of each group: one stays unless it conflicts with one that stays."""
    keys = by.split(", ")
    on = " AND ".join(f"g.{k} = n.{k}" for k in keys)
    return f"""c AS ({conflicts}), e AS (SELECT {by}, a AS id, list(b) AS near FROM (SELECT {by}, a, b FROM c UNION ALL SELECT {by}, b, a FROM c) GROUP BY ALL),
    n AS (SELECT o.*, coalesce(near, []) AS near, row_number() OVER (PARTITION BY {", ".join("o." + k for k in keys)} ORDER BY score DESC, o.id) AS k FROM ({nodes}) o LEFT JOIN e USING ({by}, id)),
    g AS (SELECT DISTINCT {by}, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM n UNION ALL SELECT {", ".join("g." + k for k in keys)}, n.k, CASE WHEN list_has_any(g.kept, n.near) THEN g.kept ELSE list_append(g.kept, n.id) END FROM g JOIN n ON {on} AND n.k = g.k + 1),
    s AS (SELECT {by}, unnest(kept) AS id FROM g QUALIFY k = max(k) OVER (PARTITION BY {by}))"""


@query(
    "v2_track_nms",
    "WITH RECURSIVE " + _TRACKS_SQL + ", " + _greedy_sql("video", "SELECT video, a, b FROM i GROUP BY ALL HAVING sum(inter) / sum(areas - inter) >= 0.3", "SELECT DISTINCT video, track AS id, score FROM v")
    + " SELECT b.video, frame, track, NOT absent AND s.id IS NOT NULL AS kept FROM b LEFT JOIN s ON s.video = b.video AND s.id = b.track",
)
def _(t):
    rows = _tracks(t)
    got = D.suppress_tracks(rows, ["video"], "track", "frame", "box", "score", 0.3)
    # a track without any present box is nobody's conflict and stays as it is: its boxes are absent
    seen = rows.where(D.box_present("box")).select("video", "track").distinct().withColumn("seen", F.lit(True))
    return got.join(seen, ["video", "track"], "left").select("video", "frame", "track", (F.col("box").isNotNull() & F.coalesce("seen", F.lit(False))).alias("kept"))


@query(
    "v2_frame_nms",
    "WITH RECURSIVE " + _TRACKS_SQL + ", " + _greedy_sql("video, frame", "SELECT video, frame, a, b FROM i WHERE inter / (areas - inter) >= 0.3", "SELECT video, frame, track AS id, score FROM v")
    + " SELECT v.video, v.frame, v.track FROM v JOIN s ON s.video = v.video AND s.frame = v.frame AND s.id = v.track",
)
def _(t):
    got = D.suppress_frames(_tracks(t), ["video"], "track", "frame", "box", "score", 0.3)
    return got.where(D.box_present("box")).select("video", "frame", "track")


def _truths(t):
    """Two thirds of the detections, shifted, some of them crowds."""
    box, key = F.col("box"), F.col("prediction_id")
    by = (key % 7).cast("double")
    return _detections(t).where(key % 3 != 0).select("image", "cls", key.alias("truth_id"), F.array(box[0] + by, box[1], box[2] + by, box[3]).alias("box"), (key % 11 == 0).alias("crowd"))


@query("v7_average_precision")
def _(t):
    p = _detections(t).withColumn("cls", F.lit("any"))
    g = p.where("prediction_id % 3 <> 0").select("image", "cls", F.col("prediction_id").alias("truth_id"), "box")
    return D.coco_scores(g, p, "image", "cls").where("area = 'all'").select("level", "ap", F.col("ar_100").alias("ar"))


@query("v7_coco_scores")
def _(t):
    return D.coco_scores(_truths(t), _detections(t), "image", "cls")


@query("v7_coco_summary")
def _(t):
    return D.coco_summary(D.coco_scores(_truths(t), _detections(t), "image", "cls"))


_OVERLAP_SQL = "greatest(0.0, least(l.x2, r.x2) - greatest(l.x, r.x)) * greatest(0.0, least(l.y2, r.y2) - greatest(l.x, r.x))"
_V1_CONFLICTS = f"SELECT image, cls, a, b FROM (SELECT l.image, l.cls, l.id AS a, r.id AS b, {_OVERLAP_SQL} AS inter, (l.x2 - l.x) * (l.y2 - l.x) + (r.x2 - r.x) * (r.y2 - r.x) AS areas FROM d l JOIN d r ON l.image = r.image AND l.cls = r.cls AND l.id < r.id) WHERE inter / (areas - inter) >= 0.5"


_UNIQUE_SQL = "u AS (SELECT l_partkey AS image, l_returnflag AS cls, l_orderkey * 10 + l_linenumber AS id, max(l_extendedprice) / 100000 AS score, max(l_quantity) AS x, max(l_discount) AS dd, max(l_tax) AS tt FROM lineitem GROUP BY ALL), d AS (SELECT image, cls, id, score, x, x + 10 + dd * 100 AS x2, x + 10 + tt * 100 AS y2 FROM u)"


@query("v1_nms", f"WITH RECURSIVE {_UNIQUE_SQL}, " + _greedy_sql("image, cls", _V1_CONFLICTS, "SELECT image, cls, id, score FROM d") + " SELECT image, cls, d.id AS prediction_id, score, [x, x, x2, y2] AS box FROM d JOIN s USING (image, cls, id)")
def _(t):
    names = ["l_partkey", "l_returnflag", "l_orderkey", "l_linenumber"]
    once = t("lineitem").groupBy(*names).agg(*[F.max(c).alias(c) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")])
    return V.nms(_detections(lambda _: once), ["image", "cls"], "prediction_id", "score", "box", 0.5)


@query(
    "v11_hota",
    """WITH r AS (SELECT l_orderkey % 10 AS seq, l_orderkey AS t, l_linenumber AS id, max(l_tax) AS x FROM lineitem GROUP BY ALL),
       c AS (SELECT seq, id, count(*) AS gc, count(*) FILTER (WHERE x > 0.01) AS rc FROM r GROUP BY ALL),
       a AS (SELECT round(0.05 * unnest(generate_series(1, 19)), 2) AS alpha),
       h AS (SELECT alpha, seq, id, count(*) AS n, sum(x * 10 + 0.15) AS loc FROM r, a WHERE x > 0.01 AND x * 10 + 0.15 >= alpha - 2.220446049250313e-16 GROUP BY ALL),
       s AS (SELECT alpha, coalesce(sum(n), 0) AS tp, sum(gc) - coalesce(sum(n), 0) AS fn, sum(rc) - coalesce(sum(n), 0) AS fp, coalesce(sum(loc), 0) AS loc, coalesce(sum(n * n / greatest(1, gc + rc - n)), 0) AS ass FROM (SELECT * FROM c, a) LEFT JOIN h USING (alpha, seq, id) GROUP BY alpha),
       m AS (SELECT alpha, tp, fn, fp, tp / greatest(1, tp + fn + fp) AS det_a, ass / greatest(1, tp) AS ass_a, CASE WHEN tp > 0 THEN loc / tp ELSE 1 END AS loc_a, tp / greatest(1, tp + fn) AS det_re FROM s)
       SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, round(det_a, 9) AS det_a, round(ass_a, 9) AS ass_a, round(loc_a, 9) AS loc_a, round(det_re, 9) AS det_re, round(sqrt(det_a * ass_a), 9) AS hota, round(sqrt(det_re * ass_a), 9) AS owta FROM m""",
)
def _(t):
    """Each track overlaps one truth of a frame, so the assignment is plain and SQL can count it; tests try all assignments of denser ones."""
    rows = t("lineitem").select((F.col("l_orderkey") % 10).alias("seq"), F.col("l_orderkey").alias("t"), F.col("l_linenumber").cast("long").alias("id"), "l_tax").groupBy("seq", "t", "id").agg(F.max("l_tax").alias("l_tax"))
    g, p = rows.select("seq", "t", F.col("id").alias("gt_id")), rows.where("l_tax > 0.01").select("seq", "t", F.col("id").alias("tr_id"))
    s = rows.where("l_tax > 0.01").select("seq", "t", F.col("id").alias("gt_id"), F.col("id").alias("tr_id"), (F.col("l_tax") * 10 + 0.15).alias("sim"))
    out = V.hota_combine(V.hota_sequences(s, g, p, "seq"))
    return out.select("alpha", *[F.col(c).cast("long").alias(c) for c in ("tp", "fn", "fp")], *[F.round(c, 9).alias(c) for c in ("det_a", "ass_a", "loc_a", "det_re", "hota", "owta")])


def _tracking(t):
    """Truths, tracks and their overlaps: tracks change their class at times, and some overlap two truths of a frame."""
    r = t("lineitem").select((F.col("l_orderkey") % 40).alias("seq"), F.floor(F.col("l_orderkey") / 40).alias("t"), F.col("l_linenumber").cast("long").alias("id"), "l_tax", "l_discount", "l_returnflag", "l_linestatus")
    r = r.groupBy("seq", "t", "id").agg(F.max("l_tax").alias("x"), F.max("l_discount").alias("d"), F.max("l_returnflag").alias("f"))
    g = r.where("x > 0").select("seq", "t", F.col("id").alias("gt_id"), F.element_at(F.array(*map(F.lit, "ANR")), (F.col("id") % 3 + 1).cast("int")).alias("cls"))
    p = r.where("d > 0.01").select("seq", "t", F.col("id").alias("tr_id"), F.when(F.col("t") % 5 == 0, F.col("f")).otherwise(F.element_at(F.array(*map(F.lit, "ANR")), (F.col("id") % 3 + 1).cast("int"))).alias("cls"))
    pairs = g.select("seq", "t", "gt_id").join(p.select("seq", "t", "tr_id"), ["seq", "t"]).where("abs(gt_id - tr_id) <= 1")
    return g, p, pairs.withColumn("sim", F.when(F.col("gt_id") == F.col("tr_id"), 0.95).otherwise(0.35) - (F.col("t") % 7) * 0.04 - F.col("gt_id") * 0.003)


@query("v12_teta_counts")
def _(t):
    from rowforge.operators import tracking as K

    return K.teta_counts(*_tracking(t), "seq")


@query("v12_teta_scores")
def _(t):
    from rowforge.operators import tracking as K

    return K.teta_scores(K.teta_counts(*_tracking(t), "seq"))


@query("v8_demo_scores")
def _(t):
    """Each part with one of four phrases; three annotations of each, which leave out, shift or keep detections. The phrase X has none, and N has no truths in every sixth part."""
    from rowforge.operators import demo_scores as S

    p = _detections(t).withColumn("image", F.concat_ws("/", "image", "cls"))
    box, key = F.col("box"), F.col("prediction_id")
    by = lambda n: (key % n).cast("double")
    moved = lambda n: F.array(box[0] + by(n), box[1], box[2] + by(n), box[3])
    named = p.where(~F.col("image").rlike("^[0-9]*[06]/N$"))
    kinds = {"x": (key % 4 != 0, moved(3)), "y": (key % 3 != 0, moved(7)), "z": (key % 5 != 0, box)}
    truths = [named.where(c).select("image", F.lit(k).alias("annotator"), b.alias("box")) for k, (c, b) in kinds.items()]
    images = t("part").select(F.explode(F.array(*[F.concat_ws("/", "p_partkey", F.lit(c)) for c in "ANRX"])).alias("image"))
    return S.demo_totals(S.demo_best(S.demo_images(images, truths[0].unionByName(truths[1]).unionByName(truths[2]), p, "image", list(kinds)), "image", list(kinds)))


_VIDEO_SQL = """v AS (SELECT s_suppkey AS id, s_suppkey % 4 + 2 AS n FROM supplier), g AS (SELECT id, n, unnest(generate_series(0, n - 1)) AS frame FROM v),
    i AS (SELECT *, row_number() OVER (ORDER BY id, frame) AS image FROM g),
    k AS (SELECT DISTINCT l_suppkey AS video, CAST(l_linenumber AS BIGINT) AS track FROM lineitem)"""


def _videos(t):
    """Suppliers as videos of two to five frames, with an object a line number."""
    n = (F.col("s_suppkey") % 4 + 2).cast("int")
    name = lambda k: F.concat(F.lit("set/v"), F.col("s_suppkey").cast("string"), F.lit("/"), k.cast("string"), F.lit(".jpg"))
    return t("supplier").select(F.col("s_suppkey").alias("at"), F.col("s_suppkey").alias("id"), F.transform(F.sequence(F.lit(0), n - 1), name).alias("file_names"), F.lit(64).alias("width"), F.lit(48).alias("height"), n.alias("length"))


def _objects(t):
    """Objects of videos; one is absent (null) in frames of its own parity and has no area in the first."""
    k = t("lineitem").select(F.col("l_suppkey").alias("video_id"), F.col("l_linenumber").cast("long").alias("track")).distinct()
    n = (F.col("video_id") % 4 + 2).cast("int")
    box = lambda f: F.when((f + F.col("track")) % 3 != 0, F.array(f.cast("double"), F.col("track").cast("double"), F.lit(4.0), F.lit(5.0)))
    over = lambda g: F.transform(F.sequence(F.lit(0), n - 1), g)
    key = F.col("video_id") * 10 + F.col("track")
    return k.select(key.alias("at"), key.alias("id"), "video_id", (F.col("track") % 3).alias("category_id"), F.lit(0).alias("iscrowd"), over(box).alias("bboxes"), over(lambda f: F.when(f > 0, f * 1.5)).alias("areas"), over(lambda f: F.concat(F.lit("rle"), f.cast("string"))).alias("segmentations"))


@query("v15_frame_images", f"WITH {_VIDEO_SQL} SELECT image AS id, id AS video_id, 'set/v' || id || '/' || frame || '.jpg' AS file_name, CAST(frame AS INTEGER) AS frame_index, 'set/v' || id AS folder FROM i")
def _(t):
    from rowforge.operators import video_documents as D2

    v = _videos(t)
    names = D2.video_list(v).select(F.col("id").alias("video_id"), F.col("name").alias("folder"))
    return D2.frame_images(v).join(names, "video_id").select("id", "video_id", "file_name", "frame_index", "folder")


@query("v15_frame_annotations", f"WITH {_VIDEO_SQL} SELECT row_number() OVER (ORDER BY image, track) AS id, video AS video_id, image AS image_id, video * 10 + track AS track_id, track % 3 AS category_id, CAST(frame AS DOUBLE) AS x, CASE WHEN frame > 0 THEN frame * 1.5 END AS area, 'rle' || frame AS segmentation FROM i JOIN k ON video = id WHERE (frame + track) % 3 <> 0")
def _(t):
    from rowforge.operators import video_documents as D2

    got = D2.frame_annotations(D2.frame_images(_videos(t)), _objects(t))
    return got.select("id", "video_id", "image_id", "track_id", "category_id", F.col("bbox")[0].alias("x"), "area", "segmentation")


@query("v15_frame_predictions", f"WITH {_VIDEO_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY video, track) AS track_id FROM k) SELECT image AS image_id, video AS video_id, track_id, CAST(frame AS DOUBLE) AS x, CASE WHEN frame > 0 THEN frame * 1.5 ELSE 20.0 END AS area, track / 10 AS score FROM i JOIN p ON video = id WHERE (frame + track) % 3 <> 0")
def _(t):
    from rowforge.operators import video_documents as D2

    p = _objects(t).withColumn("score", (F.col("id") % 10) / 10).drop("id", "iscrowd")
    return D2.frame_predictions(D2.frame_images(_videos(t)), p).select("image_id", "video_id", "track_id", F.col("bbox")[0].alias("x"), "area", "score")


#: Two rectangles of a 16 x 12 mask for each size and each of five shifts; the second one leaves the mask at times.
_RECT_SQL = "c AS (SELECT p_partkey, p_size % 7 AS ax, p_size % 3 AS ay, p_size % 7 + p_partkey % 5 AS bx, p_size % 3 + p_partkey % 4 AS b_y FROM part)"


def _rectangle(x, y, w: int, h: int, height: int = 12, width: int = 16):
    """Run lengths of a rectangle, cut where the mask ends."""
    wide, high = F.least(F.lit(w), width - x), F.least(F.lit(h), height - y)
    first = F.array(x * height + y, high)
    more = F.flatten(F.transform(F.sequence(F.lit(2), wide), lambda _: F.array(height - high, high)))
    runs = F.concat(first, F.when(wide >= 2, more).otherwise(F.array().cast("array<bigint>"))).cast("array<bigint>")
    return F.concat(runs, F.array((F.lit(width * height) - F.aggregate(runs, F.lit(0).cast("bigint"), lambda s, v: s + v)).cast("bigint")))


def _mask_pairs(t):
    p, s = F.col("p_partkey"), F.col("p_size")
    return t("part").select("p_partkey", _rectangle(s % 7, s % 3, 6, 5).alias("a"), _rectangle(s % 7 + p % 5, s % 3 + p % 4, 6, 5).alias("b"))


@query(
    "b15_mask_overlaps",
    f"""WITH {_RECT_SQL}, r AS (SELECT *, least(16, ax + 6) - ax AS aw, least(12, ay + 5) - ay AS ah, least(16, bx + 6) - bx AS bw, least(12, b_y + 5) - b_y AS bh FROM c),
       i AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, b_y + bh) - greatest(ay, b_y)) AS inter FROM r)
       SELECT p_partkey, aw * ah AS area_a, bw * bh AS area_b, inter, round(inter / (aw * ah + bw * bh - inter), 9) AS iou, round(inter / least(aw * ah, bw * bh), 9) AS iom FROM i""",
)
def _(t):
    from rowforge.operators import masks as K

    m = F.col("m")
    got = _mask_pairs(t).select("p_partkey", K.mask_measures("a", "b", F.lit(12), F.lit(16), 1).alias("m"))
    return got.select("p_partkey", "m.area_a", "m.area_b", "m.inter", F.round(K.mask_iou(m), 9).alias("iou"), F.round(K.mask_iom(m), 9).alias("iom"))


def _edge_sql(x0: str, y0: str) -> str:
    """Whether (x, y) is a boundary pixel of the rectangle at (x0, y0)."""
    at = lambda dx, dy: f"(x + {dx} >= {x0} AND x + {dx} < {x0} + 6 AND y + {dy} >= {y0} AND y + {dy} < {y0} + 5)"
    return f"CASE WHEN x = 15 AND y = 11 THEN false WHEN y = 11 THEN {at(0, 0)} <> {at(1, 0)} WHEN x = 15 THEN {at(0, 0)} <> {at(0, 1)} ELSE {at(0, 0)} <> {at(1, 0)} OR {at(0, 0)} <> {at(0, 1)} OR {at(0, 0)} <> {at(1, 1)} END"


@query(
    "b15_boundary_f",
    f"""WITH {_RECT_SQL}, k AS (SELECT DISTINCT ax, ay, bx, b_y FROM c), p AS (SELECT *, unnest(generate_series(0, 11)) AS y FROM (SELECT *, unnest(generate_series(0, 15)) AS x FROM k)),
       a AS (SELECT * FROM p WHERE {_edge_sql('ax', 'ay')}), b AS (SELECT * FROM p WHERE {_edge_sql('bx', 'b_y')}),
       n AS (SELECT DISTINCT ax, ay, bx, b_y, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM a JOIN b USING (ax, ay, bx, b_y) WHERE abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
       m AS (SELECT ax, ay, bx, b_y, (SELECT count(*) FROM a WHERE a.ax = k.ax AND a.ay = k.ay AND a.bx = k.bx AND a.b_y = k.b_y) AS na, (SELECT count(*) FROM b WHERE b.ax = k.ax AND b.ay = k.ay AND b.bx = k.bx AND b.b_y = k.b_y) AS nb,
         (SELECT count(DISTINCT x1 * 100 + y1) FROM n WHERE n.ax = k.ax AND n.ay = k.ay AND n.bx = k.bx AND n.b_y = k.b_y) AS ma, (SELECT count(DISTINCT x2 * 100 + y2) FROM n WHERE n.ax = k.ax AND n.ay = k.ay AND n.bx = k.bx AND n.b_y = k.b_y) AS mb FROM k)
       SELECT p_partkey, na AS boundary_a, nb AS boundary_b, ma AS near_a, mb AS near_b, round(CASE WHEN ma + mb = 0 THEN 0 ELSE 2 * (ma / na) * (mb / nb) / (ma / na + mb / nb) END, 9) AS f FROM c JOIN m USING (ax, ay, bx, b_y)""",
)
def _(t):
    from rowforge.operators import masks as K

    got = _mask_pairs(t).select("p_partkey", K.mask_measures("a", "b", F.lit(12), F.lit(16), 1).alias("m"))
    return got.select("p_partkey", *[f"m.{c}" for c in ("boundary_a", "boundary_b", "near_a", "near_b")], F.round(K.boundary_f(F.col("m")), 9).alias("f"))


@query("b15_polygon", f"WITH {_RECT_SQL} SELECT p_partkey, (least(16, ax + 6) - ax) * 5 AS area, (least(16, ax + 6) - ax) * 5 AS inter FROM c")
def _(t):
    from rowforge.operators import masks as K

    s = F.col("p_size")
    x, y = (s % 7).cast("double"), (s % 3).cast("double")
    rows = t("part").select("p_partkey", _rectangle(s % 7, s % 3, 6, 5).alias("a"), F.array(x, y, x + 6, y, x + 6, y + 5, x, y + 5).alias("points"))
    got = rows.withColumn("b", K.polygon_runs("points", F.lit(12), F.lit(16))).select("p_partkey", K.mask_measures("a", "b", F.lit(12), F.lit(16)).alias("m"))
    return got.select("p_partkey", F.col("m.area_b").alias("area"), "m.inter")


#: Parts as images with one truth and a prediction that is moved to the right, so that the overlap is known.
_MOVED_SQL = "m AS (SELECT p_partkey, 10.0 + p_size AS w, p_partkey % 9 AS a, p_partkey % 4 AS b FROM part), l AS (SELECT round(0.5 + 0.05 * unnest(generate_series(0, 9)), 2) AS level)"


def _moved(t, by: int):
    w, x = F.col("p_size") + 10.0, (F.col("p_partkey") % by).cast("double")
    return t("part").select(F.col("p_partkey").alias("image"), F.array(F.lit(0.0), F.lit(0.0), w, F.lit(10.0)).alias("truth"), F.array(x, F.lit(0.0), x + w, F.lit(10.0)).alias("box"), F.lit(0.9).alias("score"))


@query("v4_moved_boxes", f"WITH {_MOVED_SQL} SELECT p_partkey AS image, CAST(level AS DOUBLE) AS level, CAST((w - a) / (w + a) >= level AS BIGINT) AS tp, CAST((w - a) / (w + a) < level AS BIGINT) AS fp, CAST((w - a) / (w + a) < level AS BIGINT) AS fn FROM m, l")
def _(t):
    rows = _moved(t, 9)
    return V.cgf1_images(rows.select("image", F.col("truth").alias("box")), rows.select("image", "box", "score"), "image").select("image", "level", "tp", "fp", "fn")


@query("v6_moved_boxes", f"WITH {_MOVED_SQL}, f AS (SELECT p_partkey, avg(CAST((w - a) / (w + a) >= level AS INTEGER)) AS fa, avg(CAST((w - b) / (w + b) >= level AS INTEGER)) AS fb FROM m, l GROUP BY 1) SELECT p_partkey AS image, CASE WHEN fa >= fb THEN 'a' ELSE 'b' END AS annotator FROM f")
def _(t):
    per = [V.cgf1_images(r.select("image", F.col("truth").alias("box")), r.select("image", "box", "score"), "image").withColumn("annotator", F.lit(n)) for n, r in (("a", _moved(t, 9)), ("b", _moved(t, 4)))]
    return V.oracle_best(per[0].unionByName(per[1]), "image", "annotator").select("image", "annotator").distinct()


@query(
    "v3_rectangles",
    """WITH RECURSIVE r AS (SELECT p_partkey % 200 AS g, CAST(p_partkey AS BIGINT) AS id, p_retailprice AS score, p_size % 7 AS x, p_partkey // 200 % 4 AS y, least(16, p_size % 7 + 6) - p_size % 7 AS w FROM part),
       c AS (SELECT l.g, l.id AS a, r.id AS b FROM r l JOIN r ON l.g = r.g AND l.id < r.id WHERE greatest(0, least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x)) * greatest(0, least(l.y, r.y) + 5 - greatest(l.y, r.y)) / (5 * least(l.w, r.w)) > 0.6), """
    + _greedy_sql("g", "SELECT * FROM c", "SELECT g, id, score FROM r").replace("c AS (SELECT * FROM c), ", "", 1) + " SELECT g, id FROM s",
)
def _(t):
    p, s = F.col("p_partkey"), F.col("p_size")
    rows = t("part").select((p % 200).alias("g"), p.alias("id"), F.col("p_retailprice").alias("score"), _rectangle(s % 7, F.floor(p / 200) % 4, 6, 5).alias("counts"), F.lit(12).alias("h"), F.lit(16).alias("w"))
    return V.remove_overlaps(rows, ["g"], "id", "score", "counts", "h", "w", 0.6).select("g", "id")
