"""Detection, tracking and vector selection.

What is greedy or an assignment by nature runs as grouped Arrow UDFs, one image, sequence
or token group each; what aggregates them is plain DataFrame code.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.operators.select import ordered_rank

# --- numpy kernels -----------------------------------------------------------------------------


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of boxes (..., n, 4) with boxes (..., m, 4)."""
    w = np.clip(np.minimum(a[..., :, None, 2], b[..., None, :, 2]) - np.maximum(a[..., :, None, 0], b[..., None, :, 0]), 0, None)
    h = np.clip(np.minimum(a[..., :, None, 3], b[..., None, :, 3]) - np.maximum(a[..., :, None, 1], b[..., None, :, 1]), 0, None)
    i = w * h
    area = lambda x: np.clip(x[..., 2] - x[..., 0], 0, None) * np.clip(x[..., 3] - x[..., 1], 0, None)
    u = area(a)[..., :, None] + area(b)[..., None, :] - i
    return np.divide(i, u, out=np.zeros_like(i, dtype=float), where=u > 0)


def greedy_suppress(sim: np.ndarray, order: np.ndarray, limit: float, at_limit: bool = True) -> np.ndarray:
    """Places kept, in order: one goes if it is as similar as the limit to one kept before."""
    kept: list[int] = []
    for i in order:
        s = sim[i, kept]
        if not ((s >= limit) if at_limit else (s > limit)).any():
            kept.append(int(i))
    return np.array(kept, int)


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a least-cost assignment, by shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    if not n:
        return np.zeros(0, int), np.zeros(0, int)
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, base = i, -1, 0.0
        while True:
            through = base + c[row] - u[row] - v
            better = ~done & (through < dist)
            dist[better], via[better] = through[better], col
            nxt = int(np.where(done, np.inf, dist).argmin())
            base = dist[nxt]
            done[nxt] = True
            if owner[nxt] < 0:
                break
            row, col = owner[nxt], nxt
        u[i] += base
        seen = np.flatnonzero(done)
        for j in seen:
            if owner[j] >= 0:
                u[owner[j]] += base - dist[j]
            v[j] -= base - dist[j]
        j = nxt
        while True:
            k = via[j]
            owner[j] = i if k < 0 else owner[k]
            if k < 0:
                break
            j = k
    cols = np.flatnonzero(owner >= 0)
    rows = owner[cols]
    order = np.argsort(rows)
    return (cols[order], rows[order]) if flip else (rows[order], cols[order])


def _owners(c: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Each column's row (-1 for none) in the problems of costs (problem, row, column): `assign` for all at once, with n <= m rows and columns in use."""
    size, _, width = c.shape
    c = np.where(np.arange(width)[None, None, :] < m[:, None, None], c, np.inf)
    u, v, owner = np.zeros(c.shape[:2]), np.zeros((size, width)), np.full((size, width), -1)
    for i in range(int(n.max())):
        act = np.flatnonzero(n > i)
        each = np.arange(len(act))
        dist, via, done = np.full((len(act), width), np.inf), np.full((len(act), width), -1), np.zeros((len(act), width), bool)
        row, col, base, end, live = np.full(len(act), i), np.full(len(act), -1), np.zeros(len(act)), np.full(len(act), -1), each
        while len(live):
            at, r = act[live], row[live]
            through = base[live, None] + c[at, r] - u[at, r][:, None] - v[at]
            d, used = dist[live], done[live]
            better = ~used & (through < d)
            d = np.where(better, through, d)
            dist[live], via[live] = d, np.where(better, col[live, None], via[live])
            nxt = np.where(used, np.inf, d).argmin(1)
            base[live], done[live, nxt] = d[np.arange(len(live)), nxt], True
            own = owner[at, nxt]
            row[live], col[live] = own, nxt
            end[live[own < 0]] = nxt[own < 0]
            live = live[own >= 0]
        u[act, i] += base
        k, j = np.nonzero(done)
        delta, o = base[k] - dist[k, j], owner[act[k], j]
        u[act[k[o >= 0]], o[o >= 0]] += delta[o >= 0]
        v[act[k], j] -= delta
        j, live = end, each
        while len(live):
            k = via[live, j[live]]
            owner[act[live], j[live]] = np.where(k < 0, i, owner[act[live], k])
            j[live] = k
            live = live[k >= 0]
    return owner


def assign_many(cost: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Each row's column (-1 for none) in the problems of costs (problem, row, column), of which n rows and m columns are in use: what `assign` gives for each."""
    out = np.full(cost.shape[:2], -1)
    for flip in (False, True):
        at = np.flatnonzero((n > 0) & (m > 0) & ((n > m) == flip))
        if len(at):
            owner = _owners(cost[at].swapaxes(1, 2), m[at], n[at]) if flip else _owners(cost[at], n[at], m[at])
            k, j = np.nonzero(owner >= 0)
            out[(at[k], j) if flip else (at[k], owner[k, j])] = owner[k, j] if flip else j
    return out


def alike(n: np.ndarray, m: np.ndarray, most: int = 1 << 17) -> list[np.ndarray]:
    """Places of problems of n rows and m columns, those of like sizes together, so that all of a part padded to its largest have `most` cells (a single one may have more)."""
    order = np.lexsort((m, n))
    out, lo = [], 0
    while lo < len(order):
        k = order[lo : lo + most]
        cells = np.arange(1, len(k) + 1) * np.maximum.accumulate(np.maximum(n[k], 1)) * np.maximum.accumulate(np.maximum(m[k], 1))
        out.append(k[: max(1, int(np.searchsorted(cells, most, "right")))])
        lo += len(out[-1])
    return out


def padded(values: np.ndarray, off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of values from off on, n of them, as one array (part, row, ...) with zeros behind the last row."""
    out = np.zeros((len(n), int(n.max(initial=0)), *values.shape[1:]), values.dtype)
    k = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    out[k, j] = values[np.repeat(off, n) + j]
    return out


def cosine(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    y = x / np.where(n > 0, n, 1)
    return y @ y.T


#: Cells of a matrix of cosines that are held at a time.
_COSINES = 1 << 22


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _blocks(n: int) -> list[slice]:
    step = max(1, _COSINES // max(n, 1))
    return [slice(i, min(i + step, n)) for i in range(0, n, step)]


def max_min_select(x: np.ndarray, k: int) -> np.ndarray:
    """DivPrune: first the row that is farthest from its nearest one, then the one farthest from those chosen."""
    if k >= len(x):
        return np.arange(len(x))
    y = unit(x)
    nearest = np.empty(len(x))
    for rows in _blocks(len(x)):
        d = 1 - y[rows] @ y.T
        d[np.arange(len(d)), np.arange(rows.start, rows.stop)] = np.inf
        nearest[rows] = d.min(1)
    chosen = [int(nearest.argmax())]
    near = 1 - y @ y[chosen[0]]
    while len(chosen) < k:
        near[chosen] = -np.inf
        chosen.append(int(near.argmax()))
        near = np.minimum(near, 1 - y @ y[chosen[-1]])
    return np.sort(chosen)


def coverage_select(x: np.ndarray, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Greedy gain in coverage: the sum over rows of their greatest similarity to a chosen one, times a weight."""
    if k >= len(x):
        return np.arange(len(x))
    y, w = unit(x), np.ones(len(x)) if weight is None else weight
    covered, chosen = np.zeros(len(x)), []
    for _ in range(k):
        gain = np.concatenate([np.maximum(y[rows] @ y.T - covered[None, :], 0).sum(1) for rows in _blocks(len(x))]) * w  # covered is never below 0
        gain[chosen] = -np.inf
        chosen.append(int(gain.argmax()))
        covered = np.maximum(covered, y @ y[chosen[-1]])
    return np.sort(chosen)


def signed_coverage_select(x: np.ndarray, k: int) -> np.ndarray:
    """MMTok: first the row with the greatest sum of cosines, then the greatest gain in coverage; negative cosines count."""
    if k >= len(x):
        return np.arange(len(x))
    y = unit(x)
    chosen = [int(np.concatenate([(y[rows] @ y.T).sum(1) for rows in _blocks(len(x))]).argmax())]
    covered = y @ y[chosen[0]]
    while len(chosen) < k:
        gain = np.concatenate([np.maximum(covered[None, :], y[rows] @ y.T).sum(1) for rows in _blocks(len(x))]) - covered.sum()
        gain[chosen] = -np.inf
        chosen.append(int(gain.argmax()))
        covered = np.maximum(covered, y @ y[chosen[-1]])
    return np.sort(chosen)


def dct_matrix(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def low_pass(grid: np.ndarray, h: int, w: int) -> np.ndarray:
    """(H, W, C) -> (h, w, C): lowest DCT coefficients, transformed back on the smaller grid."""
    a, b = dct_matrix(grid.shape[0])[:h], dct_matrix(grid.shape[1])[:w]
    f = np.einsum("ih,hwc,jw->ijc", a, grid, b)
    return np.einsum("ih,ijc,jw->hwc", dct_matrix(h), f, dct_matrix(w)) * np.sqrt(h * w / (grid.shape[0] * grid.shape[1]))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows by key over all shuffle partitions: groups that Python works on are dear however few bytes they have, so they aren't coalesced by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


# --- vector selection (V17-V23) ----------------------------------------------------------------


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def norm_top_k(df: DataFrame, group: str, token: str, vector: str, k: int) -> DataFrame:
    """The k longest vectors of each group, in token order."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.col("norm").desc(), token))
    return df.withColumn("norm", norm(vector)).withColumn("__r", r).where(F.col("__r") <= k).drop("__r")


PRUNERS = {}


def pruner(name: str):
    """Register a selector f(vectors, k) -> places."""

    def put(f):
        PRUNERS[name] = f
        return f

    return put


PRUNERS["divprune"] = max_min_select
PRUNERS["mmtok"] = signed_coverage_select


@pruner("scope_l2")
def scope_l2(x: np.ndarray, k: int, alpha: float = 1.0) -> np.ndarray:
    """Coverage gain times the norm, scaled to its greatest, to the power alpha."""
    n = np.linalg.norm(x, axis=1)
    return coverage_select(x, k, (n / max(n.max(), 1e-12)) ** alpha)


def select_tokens(df: DataFrame, group: str, token: str, vector: str, method: str, k: int) -> DataFrame:
    """(group, token) that a registered selector keeps of each group."""
    f = PRUNERS[method]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(token)
        return rows.iloc[f(np.stack(rows[vector].to_list()).astype(float), k)][[group, token]]

    return spread(df.select(group, token, vector), group).groupBy(group).applyInPandas(one, df.select(group, token).schema)


def uniform_places(n: int, k: int) -> list[int]:
    """k places at even steps, rounded half to even."""
    return [round(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(min(n, k))]


def uniform_tokens(df: DataFrame, group: str, token: str, k: int) -> DataFrame:
    """Tokens at even steps of each group."""
    w = Window.partitionBy(group)
    place, n = F.row_number().over(w.orderBy(token)) - 1, F.count("*").over(w)
    steps = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(k)) - 1), lambda i: F.bround(i * (n - 1) / F.greatest(F.lit(1), F.least(n, F.lit(k)) - 1)).cast("long"))
    return df.withColumn("__p", place.cast("long")).withColumn("__s", steps).where(F.array_contains(F.col("__s"), F.col("__p"))).drop("__p", "__s")


def random_tokens(df: DataFrame, group: str, token: str, k: int, seed: int) -> DataFrame:
    """k tokens of each group in hash order."""
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), F.col(token).cast("string")), 256)
    r = F.row_number().over(Window.partitionBy(group).orderBy(key, token))
    return df.withColumn("__r", r).where(F.col("__r") <= k).drop("__r")


# --- divergences (V24, V25) --------------------------------------------------------------------


def kl(p: Column | str, q: Column | str) -> Column:
    """Sum of p ln(p / q) over probability arrays, 0 where p is 0."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def jsd(p: Column | str, q: Column | str, beta: float = 0.5) -> Column:
    m = F.zip_with(p, q, lambda a, b: beta * a + (1 - beta) * b)
    return beta * kl(p, m) + (1 - beta) * kl(q, m)


def kl_estimate(lp: Column, lq: Column, kind: str) -> Column:
    """Of log-probabilities: k1, abs, k2 or k3 (low variance)."""
    d = lp - lq
    return {"k1": d, "abs": F.abs(d), "k2": 0.5 * d * d, "k3": F.exp(-d) - 1 + d}[kind]


def sparse_logprobs(text: Column | str, k: int) -> Column:
    """The k most likely (token, logprob) of a JSON row of an API."""
    rows = F.from_json(text, "array<struct<token:string,logprob:double>>")
    best = F.array_sort(rows, lambda a, b: F.when(a["logprob"] > b["logprob"], -1).when(a["logprob"] < b["logprob"], 1).otherwise(0))
    return F.slice(best, 1, k)


# --- suppression (V1-V3) -----------------------------------------------------------------------


def nms(df: DataFrame, by: list[str], identity: str, score: str, box: str, limit: float, at_limit: bool = True) -> DataFrame:
    """Rows kept of each group by greedy suppression, highest score first, ties by id (V1).

    Pairs over the limit come from a join by group, which may share a group between tasks; only those pairs go to Python, a group at a time.
    Ids are distinct within a group; a null box or key meets nothing and stays.
    """
    from .detection import suppressed

    x = df.where(F.size(box) >= 4).select(*by, F.col(identity).alias("__t"), F.col(score).cast("double").alias("__s"), F.col(box).alias("__b"))
    l, r = x.alias("l"), x.alias("r")  # noqa: E741
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in by], F.col("l.__t") < F.col("r.__t"))
    at = lambda side, k: F.col(f"{side}.__b")[k]
    side = lambda k: F.greatest(F.lit(0.0), F.least(at("l", k + 2), at("r", k + 2)) - F.greatest(at("l", k), at("r", k)))
    area = lambda s: (at(s, 2) - at(s, 0)) * (at(s, 3) - at(s, 1))
    inter = side(0) * side(1)
    iou = F.coalesce(F.try_divide(inter, area("l") + area("r") - inter), F.lit(0.0))
    pairs = l.join(r, same).where(iou >= limit if at_limit else iou > limit).select(*[F.col(f"l.{c}").alias(c) for c in by], F.col("l.__t").alias("a"), F.col("r.__t").alias("b"), F.col("l.__s").alias("score_a"), F.col("r.__s").alias("score_b"))
    return df.join(suppressed(pairs, by).withColumnRenamed("__t", identity), [*by, identity], "left_anti").select(*df.columns)


def tube_iou(df: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Sum of intersections over sum of unions of tracks over frames; a frame on one side adds to the union only (V2, V9).

    df: by, frame, left box, right box, null where a side has none.
    """
    side = lambda b: F.coalesce((F.col(b)[2] - F.col(b)[0]) * (F.col(b)[3] - F.col(b)[1]), F.lit(0.0))
    w = F.greatest(F.lit(0.0), F.least(F.col(left)[2], F.col(right)[2]) - F.greatest(F.col(left)[0], F.col(right)[0]))
    h = F.greatest(F.lit(0.0), F.least(F.col(left)[3], F.col(right)[3]) - F.greatest(F.col(left)[1], F.col(right)[1]))
    i = F.when(F.col(left).isNull() | F.col(right).isNull(), 0.0).otherwise(w * h)
    return df.groupBy(*by).agg(F.try_divide(F.sum(i), F.sum(side(left) + side(right) - i)).alias("tube_iou"))


# --- masks (B15, V3) ---------------------------------------------------------------------------


def rle_encode(mask: np.ndarray) -> list[int]:
    """Run lengths of a mask, column by column, the first run of zeros."""
    flat = np.asarray(mask, np.uint8).ravel(order="F")
    cut = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate([[0], cut, [len(flat)]])).tolist()
    return [0, *runs] if len(flat) and flat[0] else runs


def rle_decode(counts: list[int], height: int, width: int) -> np.ndarray:
    flat = np.repeat(np.arange(len(counts)) % 2, counts).astype(np.uint8)
    return flat.reshape((height, width), order="F")


def polygon_mask(points: list[float], height: int, width: int) -> np.ndarray:
    """Pixels whose centre lies in a polygon (even-odd)."""
    p = np.asarray(points, float).reshape(-1, 2)
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    inside = np.zeros((height, width), bool)
    for (x1, y1), (x2, y2) in zip(p, np.roll(p, -1, 0), strict=True):
        if y1 != y2:
            crosses = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            inside ^= crosses
    return inside.astype(np.uint8)


def mask_iom(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over the smaller mask."""
    least = min(int(a.sum()), int(b.sum()))
    return float(np.logical_and(a, b).sum() / least) if least else 0.0


#: Masks that are held against those kept at a time.
_MASK_ROWS = 512


def kept_masks(flat: np.ndarray, limit: float) -> np.ndarray:
    """Places kept of masks (mask, pixel), best first: one goes if its IoM with one kept before is over the limit. Work grows with masks times those kept."""
    kept: list[int] = []
    real = np.float32 if flat.shape[1] < 1 << 24 else np.float64  # counts are whole numbers that must stay exact
    for lo in range(0, len(flat), _MASK_ROWS):
        m = flat[lo : lo + _MASK_ROWS].astype(real)
        size = m.sum(1)
        free = np.ones(len(m), bool)
        for k in range(0, len(kept), _MASK_ROWS):
            other = flat[kept[k : k + _MASK_ROWS]].astype(real)
            least = np.minimum(size[:, None], other.sum(1)[None, :]).astype(float)
            free &= ~(np.divide(m @ other.T, least, out=np.zeros_like(least), where=least > 0) > limit).any(1)
        at = np.flatnonzero(free)
        least = np.minimum(size[at][:, None], size[at][None, :]).astype(float)
        sim = np.divide(m[at] @ m[at].T, least, out=np.zeros_like(least), where=least > 0)
        kept += (lo + at[greedy_suppress(sim, np.arange(len(at)), limit, at_limit=False)]).tolist()
    return np.array(kept, int)


def remove_overlaps(df: DataFrame, by: list[str], identity: str, score: str, counts: str, height: str, width: str, limit: float) -> DataFrame:
    """Masks kept by greedy score order; one whose IoM with one kept is over the limit goes (V3).

    Of equal masks only the best can stay, so Spark picks it first, and a task gets the different masks of a group.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, identity], ascending=[False, True])
        sizes = set(zip(rows[height], rows[width], strict=True))
        if len(sizes) > 1:
            raise ValueError("masks of a group have one size")
        h, w = (int(x) for x in sizes.pop())
        flat = np.stack([rle_decode(list(c), h, w).ravel(order="F") for c in rows[counts]])
        return rows.iloc[kept_masks(flat, limit)]

    if limit < 1:
        # an empty mask overlaps none, so it keeps a name of its own
        pixels = F.aggregate(counts, F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct((a["i"] + 1).alias("i"), (a["n"] + a["i"] % 2 * x).cast("long").alias("n")))["n"]
        order = F.struct(F.col(score).isNull() | F.coalesce(F.isnan(F.col(score).cast("double")), F.lit(False)), -F.col(score), F.col(identity))
        best = df.groupBy(*by, counts, height, width, F.when(pixels == 0, F.col(identity)).alias("__own")).agg(F.min_by(F.struct(*[c for c in df.columns if c not in (*by, counts, height, width)]), order).alias("__x"))
        df = best.select(*by, counts, height, width, "__x.*").select(*df.columns)
    return spread(df, *by).groupBy(*by).applyInPandas(one, df.schema)


# --- detection metrics (V4-V8) -----------------------------------------------------------------

IOU_LEVELS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def _sides(truths: DataFrame, predictions: DataFrame, image: str, *columns: str) -> DataFrame:
    """Both tables as one, with nulls where the truths have no such column; `pred` tells them apart."""
    p = predictions.select(image, "box", *columns, F.lit(True).alias("pred"))
    kinds = {f.name: f.dataType for f in p.schema.fields}
    return truths.select(image, "box", *[F.lit(None).cast(kinds[c]).alias(c) for c in columns], F.lit(False).alias("pred")).unionByName(p)


def cgf1_images(truths: DataFrame, predictions: DataFrame, image: str, threshold: float = 0.5, levels: list[float] | None = None) -> DataFrame:
    """Per image and IoU level: TP, FP, FN by assignment, and the image's own outcome (V4).

    truths: image, box; predictions: image, box, score. Images with neither side don't appear.
    """
    levels = IOU_LEVELS if levels is None else levels
    names = ["tp", "fp", "fn", "n_gt", "n_pred"]
    schema = T.StructType([truths.schema[image], T.StructField("level", T.DoubleType()), *[T.StructField(n, T.LongType()) for n in names]])

    def boxes(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat = c.flatten().field("box")
        if flat.null_count or (flat.value_lengths().to_numpy() != 4).any():
            raise ValueError("a box isn't four numbers")
        return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 4), c.value_lengths().to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (b, m), (a, n) = boxes(batch.column(1)), boxes(batch.column(2))
            a_off, b_off = np.cumsum(n) - n, np.cumsum(m) - m
            tp = np.zeros((len(n), len(levels)), np.int64)
            for k in alike(n, m):
                if n[k].max() and m[k].max():
                    sim = iou_matrix(padded(a, a_off[k], n[k]), padded(b, b_off[k], m[k]))
                    to = assign_many(-sim, n[k], m[k])
                    got = np.where(to >= 0, np.take_along_axis(sim, np.maximum(to, 0)[:, :, None], 2)[:, :, 0], -1.0)
                    for i, lv in enumerate(levels):
                        tp[k, i] = ((to >= 0) & (got >= lv)).sum(1)
            row = np.repeat(np.arange(len(n)), len(levels))
            tp, n, m = tp.ravel(), n[row].astype(np.int64), m[row].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.tile(np.array(levels, float), batch.num_rows)), *map(pa.array, (tp, n - tp, m - tp, m, n))], names=schema.names)

    # an image's boxes are few bytes and dear, so images are spread; a batch of them is matched at once
    sides = _sides(truths, predictions, image, "score").withColumn("box", F.col("box").cast("array<double>"))
    score = F.col("score").cast("double")
    side = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("box"))))
    return spread(sides, image).groupBy(image).agg(side(~F.col("pred")).alias("truths"), side(F.col("pred") & (score >= threshold) & ~F.isnan(score)).alias("predictions")).mapInArrow(run, schema)


def cgf1_totals(images: DataFrame) -> DataFrame:
    """Micro F1 of images with truths, image-level Matthews correlation, and their product (V5)."""
    pos = F.col("n_gt") > 0
    s = images.groupBy("level").agg(
        *[F.sum(F.when(pos, F.col(n)).otherwise(0)).alias(n) for n in ("tp", "fp", "fn")],
        F.avg(F.when(pos, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + 1e-4))).alias("macro_f1"),
        F.count_if(pos & (F.col("n_pred") > 0)).alias("il_tp"), F.count_if(~pos & (F.col("n_pred") > 0)).alias("il_fp"), F.count_if(pos & (F.col("n_pred") == 0)).alias("il_fn"), F.count_if(~pos & (F.col("n_pred") == 0)).alias("il_tn"),
    )
    e = 1e-6
    tp, fp, fn, tn = (F.col(f"il_{x}").cast("double") for x in ("tp", "fp", "fn", "tn"))
    mcc = (tp * tn - fp * fn) / (F.sqrt(tp + fp + e) * F.sqrt(tp + fn + e) * F.sqrt(tn + fp + e) * F.sqrt(tn + fn + e))
    micro = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + 1e-4)
    return s.withColumns({"micro_f1": micro, "il_precision": tp / (tp + fp + e), "il_recall": tp / (tp + fn + e), "il_fpr": fp / (fp + tn + e), "il_mcc": mcc}).withColumn("cgf1", F.col("micro_f1") * F.col("il_mcc"))


def oracle_best(per_truth: DataFrame, image: str, annotator: str) -> DataFrame:
    """Of several ground truths, per image the one with the best mean local F1, the first of equals (V6)."""
    f1 = F.avg(F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))))
    rest = [c for c in per_truth.columns if c not in (image, annotator)]
    by = per_truth.groupBy(image, annotator).agg(f1.alias("f1"), F.collect_list(F.struct(*rest)).alias("rows"))  # a row a level
    best = by.groupBy(image).agg(F.min_by(F.struct(annotator, "rows"), F.struct((-F.col("f1")).alias("f"), F.col(annotator).alias(annotator))).alias("m"))
    return best.where(F.col(image).isNotNull() & F.col(f"m.{annotator}").isNotNull()).select(image, F.col(f"m.{annotator}").alias(annotator), F.inline("m.rows"))


def match_detections(truths: DataFrame, predictions: DataFrame, image: str, levels: list[float] | None = None, max_dets: int = 100) -> DataFrame:
    """(image, prediction_id, score, level, hit): each prediction, best score first, takes the free truth it overlaps most (V7)."""
    levels = IOU_LEVELS if levels is None else levels
    schema = T.StructType([predictions.schema[image], predictions.schema["prediction_id"], T.StructField("score", T.DoubleType()), T.StructField("hits", T.ArrayType(T.BooleanType()))])

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        g, p = rows[~rows["pred"]], rows[rows["pred"]]
        p = p.sort_values(["score", "prediction_id"], ascending=[False, True]).head(max_dets)
        if not len(p):
            return pd.DataFrame({c: [] for c in schema.names})
        sim = iou_matrix(np.stack(p["box"].to_list()).astype(float), np.stack(g["box"].to_list()).astype(float) if len(g) else np.zeros((0, 4)))
        want, free = np.array(levels), np.ones((len(levels), sim.shape[1]), bool)
        hits = np.zeros((len(p), len(levels)), bool)
        for i in np.flatnonzero(sim.max(1, initial=0.0) >= want.min()):  # all levels at once
            s = np.where(free, sim[i], -1.0)
            j = s.argmax(1)
            hits[i] = s[np.arange(len(levels)), j] >= want
            free[np.flatnonzero(hits[i]), j[hits[i]]] = False
        return pd.DataFrame({image: [key[0]] * len(p), "prediction_id": p["prediction_id"].to_numpy(), "score": p["score"].to_numpy(float), "hits": list(hits)})

    found = spread(_sides(truths, predictions, image, "prediction_id", "score"), image).groupBy(image).applyInPandas(one, schema)
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("hits").alias("hit"))).alias("x")
    return found.select(image, "prediction_id", "score", each).select(image, "prediction_id", "score", F.col("x.level").alias("level"), F.col("x.hit").alias("hit"))


def average_precision_101(matches: DataFrame, n_truths: int, image: str, bins: int = 64) -> DataFrame:
    """(level, ap, ar): precision made monotone, read at 101 recalls (V7).

    Ranks come from counts of score bins, so a level is as many tasks as it has bins; equal scores share a bin.
    Matches are persisted: clear the cache (`spark.catalog.clearCache`) once the result is written.
    """
    from pyspark.ml.feature import Bucketizer

    if not matches.is_cached:  # read by the bounds, the counts and the ranks; lost blocks are matched again
        matches = matches.persist(StorageLevel.MEMORY_AND_DISK)
    top = matches.agg(F.min("level")).first()[0]
    edges = matches.where((F.col("level") == top) & F.col("score").isNotNull()).approxQuantile("score", [i / bins for i in range(1, bins)], 0.5 / bins)
    cut = Bucketizer(splits=[-float("inf"), *sorted(set(edges)), float("inf")], inputCol="score", outputCol="__b")
    rows = cut.transform(matches).withColumn("bin", -F.col("__b")).withColumn("hit", F.col("hit").cast("int"))
    down = Window.partitionBy("level").orderBy("bin")  # a row a bin
    counts = rows.groupBy("level", "bin").agg(F.count("*").alias("__n"), F.sum("hit").alias("__h"))
    before = counts.select("level", "bin", (F.sum("__n").over(down) - F.col("__n")).alias("n0"), (F.sum("__h").over(down) - F.col("__h")).alias("h0"))
    order = [F.col("score").desc(), F.col(image), F.col("prediction_id")]
    w = Window.partitionBy("level", "bin").orderBy(*order)
    ranked = rows.join(F.broadcast(before), ["level", "bin"]).withColumn("tp", F.col("h0") + F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("precision", F.col("tp") / (F.col("n0") + F.row_number().over(w))).where("hit = 1")
    best = ranked.groupBy("level", "bin").agg(F.max("precision").alias("__p"))
    after = best.select("level", "bin", F.max("__p").over(Window.partitionBy("level").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    back = Window.partitionBy("level", "bin").orderBy(F.col("tp").desc()).rowsBetween(Window.unboundedPreceding, 0)
    level = ranked.withColumn("inside", F.max("precision").over(back)).join(F.broadcast(after), ["level", "bin"]).withColumn("envelope", F.greatest("inside", "later"))
    # recall r is reached at hit number ceil(r x truths); the k-th hit covers the steps in (k-1, k] / truths
    steps = F.floor(F.col("tp") * 100 / F.lit(n_truths) + 1e-9) - F.floor((F.col("tp") - 1) * 100 / F.lit(n_truths) + 1e-9)
    zero = F.when(F.col("tp") == 1, 1).otherwise(0)
    return level.groupBy("level").agg((F.sum(F.col("envelope") * (steps + zero)) / 101).alias("ap"), (F.max("tp") / F.lit(n_truths)).alias("ar"))


# --- tracking (V10-V14) ------------------------------------------------------------------------

ALPHAS = [round(0.05 * i, 2) for i in range(1, 20)]


_EPS = float(np.finfo(float).eps)


def frame_places(frame: np.ndarray, ident: np.ndarray, frames: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place among the sorted distinct ids of its frame, and how many ids a frame has."""
    order = np.lexsort((ident, frame))
    f, i = frame[order], ident[order]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (i[1:] != i[:-1])]) if len(f) else np.zeros(0, bool)
    n = np.bincount(f[new], minlength=frames)
    place = np.zeros(len(f), int)
    place[order] = np.cumsum(new) - 1 - (np.cumsum(n) - n)[f]
    return place, n


def same_keys(left: DataFrame, right: DataFrame, by: list[str], ids: list[str], how: str = "inner") -> DataFrame:
    """A join on by (null keys meet) and ids."""
    r = right.select(*[F.col(c).alias(f"__{c}") if c in [*by, *ids] else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [*[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], *[F.col(c) == F.col(f"__{c}") for c in ids]])
    return left.join(r, on, how).drop(*[f"__{c}" for c in [*by, *ids]])


def track_frames(rows: DataFrame, by: list[str], ident: str, name: str) -> DataFrame:
    """(by, id, name): in how many frames each id is."""
    return rows.groupBy(*by, ident).agg(F.count("*").alias(name))


def matched_tracks(similarities: DataFrame, truths: DataFrame, tracks: DataFrame, by: list[str]) -> DataFrame:
    """Rows of similarities that the best assignment of their frame takes: that with the greatest sum of alignment times similarity.

    similarities: by, t, gt_id, tr_id, sim (zeros left out) and other columns, which go along; truths: by, t, gt_id; tracks: by, t, tr_id. How well a truth and a track
    go together is summed over all frames by Spark; what Python gets are frames, a batch at once, so no task holds a sequence.
    """
    frame = [*by, "t"]
    x = spread(similarities.withColumn("sim", F.col("sim").cast("double")), *frame)
    den = F.sum("sim").over(Window.partitionBy(*frame, "gt_id")) + F.sum("sim").over(Window.partitionBy(*frame, "tr_id")) - F.col("sim")
    both = x.select(*by, "gt_id", "tr_id", F.when(den > _EPS, F.col("sim") / den).otherwise(0.0).alias("__b")).groupBy(*by, "gt_id", "tr_id").agg(F.sum("__b").alias("__b"))
    both = same_keys(same_keys(both, track_frames(truths, by, "gt_id", "__g"), by, ["gt_id"]), track_frames(tracks, by, "tr_id", "__r"), by, ["tr_id"])
    align = both.select(*by, "gt_id", "tr_id", (F.col("__b") / F.greatest(F.col("__g") + F.col("__r") - F.col("__b"), F.lit(1e-12))).alias("__a"))
    rest = [c for c in similarities.columns if c not in frame]
    schema = T.StructType([x.schema[c] for c in [*frame, *rest]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(len(frame)).value_lengths().to_numpy()
            s = b.column(len(frame)).flatten()
            f = np.repeat(np.arange(len(size)), size)
            (i, n), (j, m) = (frame_places(f, s.field(c).to_numpy(zero_copy_only=False), len(size)) for c in ("gt_id", "tr_id"))
            w, off = s.field("__w").to_numpy(zero_copy_only=False), np.cumsum(size) - size
            took = np.zeros(len(f), bool)
            for k in alike(n, m):
                row = np.repeat(off[k], size[k]) + np.arange(size[k].sum()) - np.repeat(np.cumsum(size[k]) - size[k], size[k])
                at = np.repeat(np.arange(len(k)), size[k])
                cost = np.zeros((len(k), n[k].max(), m[k].max()))
                cost[at, i[row], j[row]] = -w[row]
                took[row] = assign_many(cost, n[k], m[k])[at, i[row]] == j[row]
            got = np.flatnonzero(took)
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(f[got])) for c in range(len(frame))], *[s.field(c).take(pa.array(got)) for c in rest]], names=schema.names)

    cells = same_keys(x, align, by, ["gt_id", "tr_id"]).withColumn("__w", F.col("__a") * F.col("sim"))
    return spread(cells, *frame).groupBy(*frame).agg(F.collect_list(F.struct(*rest, "__w")).alias("__s")).mapInArrow(run, schema)


def alphas_reached(sim: Column) -> Column:
    """How many of ALPHAS, from the least on, a similarity reaches."""
    return reduce(lambda a, b: a + b, [(sim >= al - _EPS).cast("int") for al in ALPHAS])


def hota_sequences(similarities: DataFrame, truths: DataFrame, tracks: DataFrame, seq: str) -> DataFrame:
    """Per sequence and alpha: TP, FN, FP, AssA, LocA sums.

    similarities: seq, t, gt_id, tr_id, sim (zeros left out); truths: seq, t, gt_id; tracks: seq, t, tr_id. Rows without a frame take no part.
    """
    g, r, s = (x.where(F.col("t").isNotNull()) for x in (truths.select(seq, "t", "gt_id"), tracks.select(seq, "t", "tr_id"), similarities.select(seq, "t", "gt_id", "tr_id", "sim")))
    met = matched_tracks(s, g, r, [seq]).groupBy(seq, "gt_id", "tr_id", alphas_reached(F.col("sim")).alias("k")).agg(F.count("*").alias("n"), F.sum("sim").alias("loc"))
    met = met.where("k > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).groupBy(seq, "gt_id", "tr_id", "k").agg(F.sum("n").alias("n"), F.sum("loc").alias("loc"))
    met = same_keys(same_keys(met, track_frames(g, [seq], "gt_id", "gc"), [seq], ["gt_id"]), track_frames(r, [seq], "tr_id", "rc"), [seq], ["tr_id"])
    ass = F.col("n") * F.col("n") / F.greatest(F.lit(1), F.col("gc") + F.col("rc") - F.col("n"))
    sums = met.groupBy(seq, "k").agg(F.sum("n").alias("tp"), F.sum("loc").alias("loc_sum"), F.sum(ass).alias("ass_sum"))
    whole = g.select(seq, F.lit(1).alias("g"), F.lit(0).alias("r")).unionByName(r.select(seq, F.lit(0).alias("g"), F.lit(1).alias("r"))).groupBy(seq).agg(F.sum("g").alias("g"), F.sum("r").alias("r"))
    grid = same_keys(whole.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(ALPHAS) - 1)))), sums, [seq], ["k"], "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    alpha = F.element_at(F.array(*map(F.lit, ALPHAS)), F.col("k") + 1)
    return grid.select(seq, alpha.alias("alpha"), of("tp").alias("tp"), (F.col("g") - of("tp")).alias("fn"), (F.col("r") - of("tp")).alias("fp"), of("loc_sum").alias("loc_sum"), of("ass_sum").alias("ass_sum"))


def hota_combine(per_seq: DataFrame, by: list[str] | None = None) -> DataFrame:
    """DetA, AssA, LocA, HOTA by alpha from sums; association and location weighted by TP."""
    s = per_seq.groupBy(*(by or []), "alpha").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "loc_sum", "ass_sum")])
    one = F.lit(1.0)
    det = F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn") + F.col("fp"))
    ass = F.col("ass_sum") / F.greatest(one, F.col("tp"))
    loc = F.when(F.col("tp") > 0, F.col("loc_sum") / F.col("tp")).otherwise(1.0)
    out = s.withColumns({"det_a": det, "ass_a": ass, "loc_a": loc, "det_re": F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))})
    return out.withColumn("hota", F.sqrt(F.col("det_a") * F.col("ass_a"))).withColumn("owta", F.sqrt(F.col("det_re") * F.col("ass_a")))


def teta(per_class: DataFrame) -> DataFrame:
    """Localisation, association and classification scores and their mean, per class.

    per_class: cls, loc_tp, loc_fp, loc_fn, ass_sum, cls_tp, cls_fp, cls_fn, summed over sequences.
    """
    f = lambda a, b, c: F.col(a) / F.greatest(F.lit(1.0), F.col(a) + F.col(b) + F.col(c))
    s = per_class.groupBy("cls").agg(*[F.sum(c).alias(c) for c in per_class.columns if c != "cls"])
    out = s.withColumns({"loc_a": f("loc_tp", "loc_fp", "loc_fn"), "ass_a": F.col("ass_sum") / F.greatest(F.lit(1.0), F.col("loc_tp")), "cls_a": f("cls_tp", "cls_fp", "cls_fn")})
    return out.withColumn("teta", (F.col("loc_a") + F.col("ass_a") + F.col("cls_a")) / 3)


def count_tracks(rows: DataFrame, by: list[str], track: str, frame: str) -> DataFrame:
    """Detections, tracks and frames."""
    return rows.groupBy(*by).agg(F.count("*").alias("dets"), F.count_distinct(track).alias("ids"), F.count_distinct(frame).alias("frames"))


def pair_ids(pairs: DataFrame, negatives: DataFrame, keys: list[str]) -> DataFrame:
    """Dense ids from 1 over the sorted pairs, those of negative pairs after them."""
    p = pairs.select(*keys).distinct().withColumn("__n", F.lit(0))
    n = negatives.select(*keys).distinct().join(pairs.select(*keys), keys, "left_anti").withColumn("__n", F.lit(1))
    return ordered_rank(p.unionByName(n), ["__n", *keys], "pair_id").withColumn("pair_id", F.col("pair_id").cast("int")).drop("__n")


def reindex(annotations: DataFrame, *ids: str) -> DataFrame:
    """0-based ids as 1-based."""
    return annotations.withColumns({c: F.col(c) + 1 for c in ids})
