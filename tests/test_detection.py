"""Track suppression and COCO scores against plain loops."""

import collections
import random

import numpy as np
import pytest

from rowforge.operators import detection as D


def iou_sums(a, b):
    inter = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return inter, a[2] * a[3] + b[2] * b[3] - inter


def present(b):
    return b is not None and len(b) >= 4 and not all(x <= 0 for x in b[:4])


def plain_tracks(rows, limit):
    """{(video, track, frame): box} after track-level suppression."""
    videos = collections.defaultdict(lambda: collections.defaultdict(dict))
    score = {}
    for v, k, f, b, s in rows:
        videos[v][k][f] = b
        score[v, k] = s
    out = {}
    for v, tracks in videos.items():
        order = sorted((k for k in tracks if any(present(b) for b in tracks[k].values())), key=lambda k: (-(score[v, k] if score[v, k] is not None else -1e9), k))
        kept = []
        for k in order:
            def tube(o, k=k):
                sums = [iou_sums(tracks[k][f], tracks[o][f]) for f in tracks[k] if f in tracks[o] and present(tracks[k][f]) and present(tracks[o][f])]
                union = sum(u for _, u in sums)
                return sum(i for i, _ in sums) / union if union > 0 else 0
            if all(tube(o) < limit for o in kept):
                kept.append(k)
        for k, frames in tracks.items():
            for f, b in frames.items():
                out[v, k, f] = b if k in kept or k not in order else None
    return out


def plain_frames(rows, limit):
    out = {(v, k, f): b for v, k, f, b, _ in rows}
    frames = collections.defaultdict(list)
    for v, k, f, b, s in rows:
        if present(b):
            frames[v, f].append((-(s if s is not None else -1e9), k, b))
    for (v, f), found in frames.items():
        kept = []
        for _, k, b in sorted(found, key=lambda x: x[:2]):
            over = [iou_sums(b, o) for o in kept]
            if any(u > 0 and i / u >= limit for i, u in over):
                out[v, k, f] = None
            else:
                kept.append(b)
    return out


@pytest.mark.parametrize("limit", [0.2, 0.5, 1.0])
def test_suppression_of_tracks_and_frames(spark, limit):
    r = random.Random(2)
    rows = []
    for v in range(6):
        for k in range(9):
            s = r.choice([0.5, 0.9, 0.1, None]) if k % 2 else r.random()
            for f in range(8):
                if r.random() < 0.85:
                    sway = 6.0 * (f % 2) * (k % 2)
                    box = r.choice([None, [0.0] * 4, [-1.0, 0.0, 0.0, 0.0]]) if r.random() < 0.15 else [10.0 * (k % 3) + sway + r.randrange(3), float(r.randrange(3)), 12.0, 10.0 + r.randrange(4)]
                    rows.append((v, k, f, box, s))
    rows += [(9, 0, 0, [1.0, 1.0, 2.0, 2.0], 0.5), (9, 1, 1, [1.0, 1.0, 2.0, 2.0], 0.6), (9, 2, 0, [1.0, 1.0, 2.0, 2.0], 0.5)]
    df = spark.createDataFrame(rows, "video long, track long, frame long, box array<double>, score double")
    for f, plain in ((D.suppress_tracks, plain_tracks), (D.suppress_frames, plain_frames)):
        got = {(x["video"], x["track"], x["frame"]): x["box"] for x in f(df, ["video"], "track", "frame", "box", "score", limit).collect()}
        assert got == plain(rows, limit)
        assert f(df.limit(0), ["video"], "track", "frame", "box", "score", limit).count() == 0


def plain_coco(truths, predictions):
    """The published evaluation, detection by detection: {(cls, area, level): (ap, ar_1, ar_10, ar_100)}."""
    out = {}
    for cls in {t["cls"] for t in truths}:
        images = sorted({x["image"] for x in [*truths, *predictions] if x["cls"] == cls})
        for name, (lo, hi) in D.AREAS.items():
            for level in D.LEVELS:
                dets, npig = [], 0
                for im in images:
                    g = sorted((t for t in truths if t["cls"] == cls and t["image"] == im), key=lambda t: t["truth_id"])
                    for t in g:
                        t["ig"] = t["crowd"] or not lo <= t["area"] <= hi
                    g = sorted(g, key=lambda t: t["ig"])
                    npig += sum(not t["ig"] for t in g)
                    taken = [False] * len(g)
                    d = sorted((p for p in predictions if p["cls"] == cls and p["image"] == im), key=lambda p: (-p["score"], p["prediction_id"]))[:100]
                    for place, p in enumerate(d):
                        best, m = min(level, 1 - 1e-10), -1
                        for j, t in enumerate(g):
                            if taken[j] and not t["crowd"]:
                                continue
                            if m > -1 and not g[m]["ig"] and t["ig"]:
                                break
                            a, b = p["box"], t["box"]
                            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                            inter = max(w, 0) * max(h, 0)
                            own, other = (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
                            v = inter / (own if t["crowd"] else own + other - inter)
                            if v < best:
                                continue
                            best, m = v, j
                        size = (p["box"][2] - p["box"][0]) * (p["box"][3] - p["box"][1])
                        if m > -1:
                            taken[m] = True
                            code = 2 if g[m]["ig"] else 1
                        else:
                            code = 0 if lo <= size <= hi else 2
                        dets.append((-p["score"], im, p["prediction_id"], place, code))
                if not npig:
                    continue
                dets.sort()
                tp = np.cumsum([d[4] == 1 for d in dets])
                fp = np.cumsum([d[4] == 0 for d in dets])
                rc, pr = tp / npig, tp / np.maximum(tp + fp, 1e-12)
                pr = np.maximum.accumulate(pr[::-1])[::-1]
                at = np.searchsorted(rc, np.linspace(0, 1, 101), "left")
                ap = np.mean([pr[i] if i < len(pr) else 0 for i in at])
                out[cls, name, level] = (ap, *[sum(d[4] == 1 for d in dets if d[3] < c) / npig for c in (1, 10, 100)])
    return out


@pytest.mark.parametrize("rows", [10**6, 60])
def test_coco_scores_are_those_of_a_plain_loop(spark, monkeypatch, rows):
    monkeypatch.setattr(D, "RANGE_ROWS", rows)
    r = random.Random(4)
    truths, predictions = [], []
    for im in range(14):
        for cls in ("a", "b"):
            for _ in range(r.randrange(7)):
                x, y, s = r.randrange(200), r.randrange(200), r.choice([8, 20, 31, 32, 60, 96, 130])
                truths.append({"image": im, "cls": cls, "truth_id": len(truths), "box": [float(x), float(y), float(x + s), float(y + s)], "area": float(s * s) * r.choice([1, 1, 0.7]), "crowd": r.random() < 0.15})
            for t in [t for t in truths if t["image"] == im and t["cls"] == cls] * 2 + [None] * 4:
                box = [float(v + r.choice([0, 0, 1, 3, 6])) for v in t["box"]] if t else [float(r.randrange(100)), 5.0, float(r.randrange(101, 260)), 44.0]
                predictions.append({"image": im, "cls": cls, "prediction_id": len(predictions), "score": r.choice([0.1, 0.5, 0.9, r.random()]), "box": box})
    predictions += [{"image": 99, "cls": "a", "prediction_id": 10_000 + i, "score": i / 200, "box": [0.0, 0.0, 5.0, 5.0]} for i in range(130)]
    truths.append({"image": 99, "cls": "a", "truth_id": 10**6, "box": [0.0, 0.0, 5.0, 5.0], "area": 25.0, "crowd": False})
    want = plain_coco(truths, predictions)
    t = spark.createDataFrame([(x["image"], x["cls"], x["truth_id"], x["box"], x["area"], x["crowd"]) for x in truths] + [(3, "a", -1, None, 5.0, False)], "image long, cls string, truth_id long, box array<double>, area double, crowd boolean")
    p = spark.createDataFrame([(x["image"], x["cls"], x["prediction_id"], x["score"], x["box"]) for x in predictions] + [(3, "a", -1, None, [1.0] * 4), (3, "a", -2, float("nan"), [1.0] * 4), (3, "c", -3, 0.5, [1.0] * 4)], "image long, cls string, prediction_id long, score double, box array<double>")
    scores = D.coco_scores(t, p, "image", "cls")
    got = {(x["cls"], x["area"], x["level"]): (x["ap"], x["ar_1"], x["ar_10"], x["ar_100"]) for x in scores.collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k
    summary = {x["name"]: x["value"] for x in D.coco_summary(scores).collect()}
    mean = lambda i, area, level=None: np.mean([v[i] for (c, a, lv), v in want.items() if a == area and level in (None, lv)])
    assert len(summary) == 12 and summary["AP"] == pytest.approx(mean(0, "all")) and summary["AP75"] == pytest.approx(mean(0, "all", 0.75))
    assert summary["AR_1"] == pytest.approx(mean(1, "all")) and summary["AR_large"] == pytest.approx(mean(3, "large")) and summary["AP_small"] == pytest.approx(mean(0, "small"))
    assert {x["value"] for x in D.coco_summary(scores.limit(0)).collect()} == {-1.0}


def test_coco_without_rows(spark):
    t = spark.createDataFrame([(1, "a", 1, [0.0, 0.0, 4.0, 4.0])], "image long, cls string, truth_id long, box array<double>")
    p = spark.createDataFrame([], "image long, cls string, prediction_id long, score double, box array<double>")
    assert {(x["area"], x["ap"], x["ar_100"]) for x in D.coco_scores(t, p, "image", "cls").collect()} == {("all", 0.0, 0.0), ("small", 0.0, 0.0)}
    assert D.coco_scores(t.limit(0), p, "image", "cls").count() == 0
