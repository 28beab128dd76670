"""Measures of run-length masks: areas, overlaps and how well boundaries agree.

A mask is its run lengths, column by column, the first run of zeros. Masks are unpacked a row at a time in Arrow tasks and leave as counts;
ratios are columns over these.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vision import polygon_mask, rle_encode

MEASURES = "area_a long, area_b long, inter long, boundary_a long, boundary_b long, near_a long, near_b long"


def boundary(mask: np.ndarray) -> np.ndarray:
    """Pixels of masks (..., row, column) that differ from the one to their right, below or between; in the last row only to the right, in the last column only below, never the last corner."""
    m = np.asarray(mask, bool)
    out = np.zeros_like(m)
    right, below = m[..., :-1] ^ m[..., 1:], m[..., :-1, :] ^ m[..., 1:, :]
    out[..., :-1, :-1] = right[..., :-1, :] | below[..., :-1] | (m[..., :-1, :-1] ^ m[..., 1:, 1:])
    out[..., -1, :-1], out[..., :-1, -1] = right[..., -1, :], below[..., -1]
    return out


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    """Pixels of masks (..., row, column) with one of the mask in the square around them: counts over rows, then over columns, by running sums."""
    out = np.asarray(mask, bool)
    for axis in (-2, -1):
        n = out.shape[axis]
        upto = np.concatenate([np.zeros_like(np.take(out, [0], axis), int), np.cumsum(out, axis)], axis)
        hi, lo = np.minimum(np.arange(n) + radius + 1, n), np.maximum(np.arange(n) - radius, 0)
        out = np.take(upto, hi, axis) > np.take(upto, lo, axis)
    return out


#: Pixels of masks that are unpacked at a time; a single mask may have more.
_PIXELS = 1 << 20


def _unpacked(runs: list, height: int, width: int) -> np.ndarray:
    """Masks (mask, row, column) of one size from their run lengths."""
    size = np.array([len(r) for r in runs])
    counts = np.concatenate([np.asarray(r, int) for r in runs]) if len(runs) else np.zeros(0, int)
    mask = np.repeat(np.arange(len(runs)), size)
    if (np.bincount(mask, counts, len(runs)) != height * width).any():
        raise ValueError(f"runs don't fill a mask of {height} x {width}")
    turn = np.arange(len(counts)) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(turn % 2 == 1, counts).reshape(len(runs), width, height).swapaxes(1, 2)


def _measure(a: list, b: list, height: int, width: int, radius: int) -> np.ndarray:
    """MEASURES (mask, measure) of pairs of masks of one size."""
    out = []
    step = max(1, _PIXELS // max(1, height * width))
    for lo in range(0, len(a), step):
        x, y = (_unpacked(m[lo : lo + step], height, width) for m in (a, b))
        edge_x, edge_y = boundary(x), boundary(y)
        out.append(np.stack([m.sum((1, 2)) for m in (x, y, x & y, edge_x, edge_y, edge_x & dilated(edge_y, radius), edge_y & dilated(edge_x, radius))], 1))
    return np.concatenate(out)


def mask_measures(a: Column | str, b: Column | str, height: Column | str, width: Column | str, radius: Column | int | None = None) -> Column:
    """MEASURES of two masks of one size: pixels of each and of both, boundary pixels of each, and how many of those are within `radius` (a square) of the other's.

    radius: a 50th of the diagonal, rounded up, if none is given. Defined cases: a null mask or size gives nulls; runs that don't fill the mask are an error.
    """

    @F.pandas_udf(MEASURES)
    def measures(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series, r: pd.Series) -> pd.DataFrame:
        names = [f.split(" ")[0] for f in MEASURES.split(", ")]
        out = pd.DataFrame(pd.NA, index=np.arange(len(a)), columns=names, dtype="Int64")
        some = np.flatnonzero(a.notna() & b.notna() & h.notna() & w.notna())
        size = pd.DataFrame({"h": h.to_numpy()[some], "w": w.to_numpy()[some], "r": r.to_numpy(float, na_value=np.nan)[some]})
        size["r"] = size["r"].fillna(np.ceil(0.02 * np.hypot(size["h"].astype(float), size["w"].astype(float))))
        for (p, q, k), at in size.groupby(["h", "w", "r"]).indices.items():  # masks of one size at once
            at = some[at]
            out.iloc[at] = _measure([a.iloc[i] for i in at], [b.iloc[i] for i in at], int(p), int(q), int(k))
        return out.set_axis(a.index)

    c = lambda x: F.col(x) if isinstance(x, str) else x
    return measures(c(a), c(b), c(height).cast("long"), c(width).cast("long"), (radius if isinstance(radius, Column) else F.lit(radius)).cast("long"))


def mask_iou(m: Column) -> Column:
    """Of mask_measures: the share of both in either; null for two empty masks."""
    return F.try_divide(m["inter"], m["area_a"] + m["area_b"] - m["inter"])


def mask_iom(m: Column) -> Column:
    """Of mask_measures: the share of both in the smaller one, 0 if that is empty."""
    return F.coalesce(F.try_divide(m["inter"], F.least(m["area_a"], m["area_b"])), F.when(m["inter"].isNotNull(), 0.0))


def boundary_f(m: Column) -> Column:
    """Of mask_measures, a the truth: F1 of boundary pixels near the other's boundary; two masks without boundary agree, one doesn't."""
    precision = F.when(m["boundary_b"] == 0, 1.0).otherwise(F.when(m["boundary_a"] == 0, 0.0).otherwise(F.try_divide(m["near_b"], m["boundary_b"])))
    recall = F.when(m["boundary_a"] == 0, 1.0).otherwise(F.when(m["boundary_b"] == 0, 0.0).otherwise(F.try_divide(m["near_a"], m["boundary_a"])))
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.when(m["boundary_a"].isNotNull(), 0.0))


def polygon_runs(points: Column | str, height: Column | str, width: Column | str) -> Column:
    """The mask of a polygon (x and y in turn): pixels whose centre lies in it, as run lengths. A null or a polygon of fewer than three points is an empty mask."""

    @F.pandas_udf("array<long>")
    def runs(p: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([[int(y) * int(z)] if x is None or len(x) < 6 else [int(v) for v in rle_encode(polygon_mask(x, int(y), int(z)))] for x, y, z in zip(p, h, w, strict=True)])

    c = lambda x: F.col(x) if isinstance(x, str) else x
    return runs(c(points).cast("array<double>"), c(height), c(width))
