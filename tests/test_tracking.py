"""HOTA, TETA and demo scores against plain loops that try every assignment."""

import collections
import itertools
import random

import numpy as np
import pytest

from rowforge.operators import demo_scores as S
from rowforge.operators import tracking as K
from rowforge.operators import vision as V

EPS = np.finfo(float).eps


def best_assignment(score):
    """Rows and columns of the pairing with the greatest sum, by trying all."""
    n, m = len(score), len(score[0]) if len(score) else 0
    if not n or not m:
        return []
    if n > m:
        return [(i, j) for j, i in best_assignment([list(c) for c in zip(*score)])]
    best = max(itertools.permutations(range(m), n), key=lambda p: sum(score[i][j] for i, j in enumerate(p)))
    return list(enumerate(best))


def align(frames):
    both, gc, rc = collections.Counter(), collections.Counter(), collections.Counter()
    for g, r, sim in frames:
        for i in g:
            gc[i] += 1
        for j in r:
            rc[j] += 1
        for i in g:
            for j in r:
                den = sum(sim.get((i, x), 0) for x in r) + sum(sim.get((x, j), 0) for x in g) - sim.get((i, j), 0)
                if den > EPS:
                    both[i, j] += sim.get((i, j), 0) / den
    return {k: v / (gc[k[0]] + rc[k[1]] - v) for k, v in both.items()}, gc, rc


def matched(frames, alpha):
    a, gc, rc = align(frames)
    out = []
    for g, r, sim in frames:
        pairs = best_assignment([[a.get((i, j), 0) * sim.get((i, j), 0) for j in r] for i in g])
        out.append([(g[i], r[j]) for i, j in pairs if sim.get((g[i], r[j]), 0) >= alpha - EPS])
    return out, gc, rc


def sequences(seed, n):
    r = random.Random(seed)
    for s in range(n):
        for t in range(5):
            g, d = ([i for i in range(4) if r.random() < 0.7] for _ in range(2))
            if s == 0 and t == 2:
                g = []
            if s == 1:
                d = []
            yield s, t, g, d, {(i, j): round(r.random(), 6) for i in g for j in d if r.random() < 0.8}


def test_hota_is_that_of_all_assignments(spark):
    rows = list(sequences(1, 7))
    truths = spark.createDataFrame([(s, t, i) for s, t, g, _, _ in rows for i in g], "seq long, t long, gt_id long")
    tracks = spark.createDataFrame([(s, t, j) for s, t, _, d, _ in rows for j in d], "seq long, t long, tr_id long")
    sims = spark.createDataFrame([(s, t, i, j, v) for s, t, _, _, x in rows for (i, j), v in x.items()], "seq long, t long, gt_id long, tr_id long, sim double")
    got = {(x["seq"], x["alpha"]): tuple(x)[2:] for x in V.hota_sequences(sims, truths, tracks, "seq").collect()}
    for s in range(7):
        frames = [(g, d, x) for q, _, g, d, x in rows if q == s and (g or d)]
        for alpha in V.ALPHAS:
            pairs, gc, rc = matched(frames, alpha)
            hits = collections.Counter(p for f in pairs for p in f)
            tp = sum(hits.values())
            ass = sum(n * n / max(1, gc[i] + rc[j] - n) for (i, j), n in hits.items())
            loc = sum(x[p] for f, (_, _, x) in zip(pairs, frames) for p in f)
            assert got[s, alpha] == pytest.approx((tp, sum(gc.values()) - tp, sum(rc.values()) - tp, loc, ass))


def plain_teta(rows, gt_cls, tr_cls, thr):
    """{(cls, alpha): counts} by the definitions, sequence by sequence."""
    out = collections.defaultdict(lambda: dict.fromkeys(K.COUNTS, 0))
    classes = set(gt_cls.values()) | set(tr_cls.values())
    for s in sorted({q for q, *_ in rows}):
        for cls in classes:
            frames, over, extra = [], [], []
            for q, _, g, d, x in rows:
                if q != s:
                    continue
                mine = [i for i in g if gt_cls[s, i] == cls]
                near = [j for j in d if any(x.get((i, j), 0) >= thr for i in mine)]
                seen = [j for j in d if j in near or tr_cls[s, j] == cls]
                frames.append((mine, seen, {(i, j): v for (i, j), v in x.items() if i in mine and j in seen}))
                over.append(near)
                extra.append(len(seen) - len(near) if mine else len(seen))
            n_gt, n_over = sum(len(f[0]) for f in frames), sum(map(len, over))
            for alpha in V.ALPHAS:
                c = out[cls, alpha]
                hard = alpha >= 0.5
                if not n_over or not n_gt:
                    c["loc_fn"] += n_gt
                    c["cls_fp"] += sum(len(f[1]) for f in frames) if hard else 0
                    continue
                pairs, gc, rc = matched(frames, alpha)
                hits = collections.Counter(p for f in pairs for p in f)
                for name, of in (("ass_sum", lambda i, j, n: gc[i] + rc[j] - n), ("ass_re_sum", lambda i, j, n: gc[i]), ("ass_pr_sum", lambda i, j, n: rc[j])):
                    c[name] += sum(n * n / max(1, of(i, j, n)) for (i, j), n in hits.items())
                for (mine, _, _), found, near, more in zip(frames, pairs, over, extra):
                    c["cls_fp"] += more if hard else 0
                    if not mine:
                        continue
                    c["loc_tp"] += len(found)
                    c["loc_fn"] += len(mine) - len(found)
                    c["loc_fp"] += len(set(near) - {j for _, j in found})
                    if hard:
                        c["cls_tp"] += sum(tr_cls[s, j] == cls for _, j in found)
                        c["cls_fn"] += sum(tr_cls[s, j] != cls for _, j in found)
                        for _, j in found:
                            if tr_cls[s, j] != cls:
                                out[tr_cls[s, j], alpha]["cls_fp"] += 1
    return out


@pytest.mark.parametrize("thr", [0.5, 0.2])
def test_teta_is_that_of_its_definitions(spark, thr):
    rows = list(sequences(3, 6))
    r = random.Random(9)
    gt_cls = {(s, i): r.choice("abc") for s in range(6) for i in range(4)}
    tr_cls = {(s, i): r.choice("abcd") for s in range(6) for i in range(4)}
    truths = spark.createDataFrame([(s, t, i, gt_cls[s, i]) for s, t, g, _, _ in rows for i in g], "seq long, t long, gt_id long, cls string")
    tracks = spark.createDataFrame([(s, t, j, tr_cls[s, j]) for s, t, _, d, _ in rows for j in d], "seq long, t long, tr_id long, cls string")
    sims = spark.createDataFrame([(s, t, i, j, v) for s, t, _, _, x in rows for (i, j), v in x.items()], "seq long, t long, gt_id long, tr_id long, sim double")
    counts = K.teta_counts(truths, tracks, sims, "seq", thr)
    want = plain_teta(rows, gt_cls, tr_cls, thr)
    got = {(x["cls"], x["alpha"]): tuple(x)[2:] for x in counts.collect()}
    for k, c in want.items():
        if any(c.values()):
            assert got[k] == pytest.approx(tuple(c[n] for n in K.COUNTS)), k
    assert all(not any(v) or k in want for k, v in got.items())
    for x in K.teta_scores(counts).collect():
        mine = [c for (cls, _), c in sorted(want.items()) if cls == x["cls"]]
        loc = np.mean([c["loc_tp"] / max(1, c["loc_tp"] + c["loc_fn"] + c["loc_fp"]) for c in mine])
        ass = np.mean([c["ass_sum"] / max(1, c["loc_tp"]) for c in mine])
        assert (x["loc_a"], x["ass_a"]) == pytest.approx((loc, ass)) and x["teta"] == pytest.approx((loc + ass + x["cls_a"]) / 3)
    assert K.teta_counts(truths.limit(0), tracks.limit(0), sims.limit(0), "seq").count() == 0


def overlap(a, b, crowd):
    inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    own, other = (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
    return inter / (own if crowd else own + other - inter)


def test_demo_scores_are_those_of_a_plain_loop(spark):
    r = random.Random(8)
    box = lambda x: [float(x), 0.0, float(x + 10), float(r.choice([8, 9, 10]))]
    images, truths, preds = range(40), [], []
    for im in images:
        for who in ("x", "y", "z"):
            for k in range(r.choice([0, 0, 1, 2, 3])):
                truths.append((im, who, box(12 * k + r.randrange(4)), r.random() < 0.1, r.random() < 0.1))
        for k in range(r.choice([0, 1, 2, 3])):
            preds.append((im, r.choice([0.3, 0.5, 0.9]), box(12 * k + r.randrange(4))))
    t = spark.createDataFrame(truths, "image long, annotator string, box array<double>, crowd boolean, ignore boolean")
    p = spark.createDataFrame([*preds, (0, None, [1.0] * 4)], "image long, score double, box array<double>")
    scored = S.demo_images(spark.range(40).withColumnRenamed("id", "image"), t, p, "image", ["x", "y", "z"])
    best = S.demo_best(scored, "image", ["x", "y", "z"])
    chosen = {x["image"]: x for x in best.collect()}
    per = collections.defaultdict(list)
    for im in images:
        d = [b for i, s, b in preds if i == im and s >= 0.5]
        options = []
        for who in ("x", "y", "z"):
            g = [(b, c) for i, w, b, c, ig in truths if i == im and w == who and not ig]
            sim = [[overlap(a, b, c) for b, c in g] for a in d]
            pairs = [sim[i][j] for i, j in best_assignment(sim)]
            res = []
            for lv in S.LEVELS:
                tp = sum(v >= lv for v in pairs)
                pr, rc = tp / (len(d) + 1e-4), tp / (len(g) + 1e-4)
                res.append((tp, len(d) - tp, len(g) - tp, 2 * pr * rc / (pr + rc + 1e-4)))
            options.append((who, len(g), len(d), np.mean([x[3] for x in res]), res, np.mean(pairs) if pairs else None))
        empty = [o for o in options if not o[1] and not o[2]]
        pick = empty[0] if empty else max(options, key=lambda o: o[3])
        x = chosen[im]
        assert (x["annotator"], x["n_gt"], x["n_pred"]) == pick[:3]
        for k, lv in enumerate(S.LEVELS):
            per[lv].append((pick[1], pick[2], *pick[4][k], pick[5]))
    for x in S.demo_totals(best).collect():
        rows = per[x["level"]]
        tp, fp, fn = (sum(q[i] for q in rows) for i in (2, 3, 4))
        assert (x["tp"], x["fp"], x["fn"]) == (tp, fp, fn)
        pos = [q for q in rows if q[0]]
        il = [sum(bool(q[0]) == a and bool(q[1]) == b for q in rows) for a, b in ((True, True), (False, True), (False, False), (True, False))]
        mcc = (il[0] * il[2] - il[1] * il[3]) / (((il[0] + il[1]) * (il[0] + il[3]) * (il[2] + il[1]) * (il[2] + il[3])) ** 0.5 + 1e-6)
        macro = sum(q[5] for q in pos) / sum(bool(q[1]) for q in pos)
        assert x["positive_macro_f1"] == pytest.approx(macro) and x["il_mcc"] == pytest.approx(mcc) and x["cgf1"] == pytest.approx(macro * mcc)
        assert x["il_perfect_pos"] == pytest.approx(sum(not q[3] and not q[4] for q in pos) / len(pos)) and x["j"] == pytest.approx(np.mean([q[6] for q in rows if q[6] is not None]))
        pr, rc = tp / (tp + sum(q[3] for q in pos) + 1e-4), tp / (tp + fn + 1e-4)
        assert x["positive_micro_f1"] == pytest.approx(2 * pr * rc / (pr + rc + 1e-4))
