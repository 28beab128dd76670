"""Bounding-box columns. Conventions differ by caller, so each is a function of its own."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _c, all_matches

NUMBER = r"[-+]?\d+(?:\.\d+)?"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: an expression used many times in another multiplies the plan."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _box(*xs: Column) -> Column:
    return F.array(*[x.cast("double") for x in xs])


def _ordered(b: Column) -> Column:
    return _box(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3]))


def parse_percent(text: Column | str) -> Column:
    """The first four numbers as a 0-100 box: up to 1 counts as a fraction, over 100 as thousandths; null if it can't be one."""
    bare = F.regexp_replace(_c(text), r"(?i)\b[xy][12]\b", "")
    found = F.slice(all_matches(bare, NUMBER), 1, 4)

    def box(n: Column) -> Column:
        def scale(ends: Column) -> Column:
            by = F.when(ends["high"] <= 1, 100.0).when(ends["high"] > 100, 0.1).otherwise(1.0)
            return F.when((F.size(n) == 4) & (ends["low"] >= 0) & (ends["high"] <= 1000), F.transform(n, lambda x: F.when(ends["high"] > 100, x / 10).otherwise(x * by)))

        ends = F.struct(F.array_max(n).alias("high"), F.array_min(n).alias("low"))
        return let(let(ends, scale), lambda b: let(_ordered(b), lambda o: F.when((o[0] < o[2]) & (o[1] < o[3]), o)))

    return let(F.transform(found, lambda x: x.cast("double")), box)


def parse_native(text: Column | str) -> Column:
    """{<a><b><c><d>}, {a,b,c,d} or [a,b,c,d], not negative, not scaled."""
    n = r"\s*(\d+(?:\.\d+)?)\s*"
    angle = r"\{\s*<(\d+(?:\.\d+)?)>\s*<(\d+(?:\.\d+)?)>\s*<(\d+(?:\.\d+)?)>\s*<(\d+(?:\.\d+)?)>\s*\}"
    forms = [angle, r"\{" + ",".join([n] * 4) + r"\}", r"\[" + ",".join([n] * 4) + r"\]"]
    one = lambda p: F.when(_c(text).rlike(p), _box(*[F.regexp_extract(_c(text), p, i) for i in range(1, 5)]))
    return F.coalesce(*[one(p) for p in forms])


def parse_full_native(text: Column | str) -> Column:
    """The whole text is {<a><b><c><d>}: hundredths; anything else is an error."""
    p = r"^\s*\{<(\d+)><(\d+)><(\d+)><(\d+)>\}\s*$"
    box = _box(*[F.regexp_extract(_c(text), p, i).try_cast("double") / 100 for i in range(1, 5)])
    return F.when(_c(text).rlike(p), box).otherwise(F.raise_error(F.concat(F.lit("not a native box: "), _c(text))).cast("array<double>"))


def parse_signed_angle(text: Column | str) -> Column:
    """The first {<a><b><c><d>}: signs and blanks inside the brackets are fine."""
    n = r"<\s*(-?\d+(?:\.\d+)?)\s*>"
    p = r"\{" + n * 4 + r"\}"
    return F.when(_c(text).rlike(p), _box(*[F.regexp_extract(_c(text), p, i) for i in range(1, 5)]))


def to_unit(box: Column) -> Column:
    """To 0-1 by magnitude: up to 1.5 as it is, up to 100.5 percent, up to 1000.5 thousandths, else null."""
    most = F.array_max(F.transform(box, F.abs))
    by = F.when(most <= 1.5, 1.0).when(most <= 100.5, 100.0).when(most <= 1000.5, 1000.0)
    return F.when(by.isNotNull(), F.transform(box, lambda x: x / by))


def pixels_to_percent(box: Column, width: Column | str, height: Column | str) -> Column:
    """Pixels as whole percents, rounded half to even and kept within 0-100."""
    side = [_c(width), _c(height)]
    return F.array(*[F.least(F.lit(100), F.greatest(F.lit(0), F.bround(box[i] / side[i % 2] * 100).cast("int"))) for i in range(4)])


def area(b: Column, plus: float = 0.0) -> Column:
    return (b[2] - b[0] + plus) * (b[3] - b[1] + plus)


def intersection(a: Column, b: Column, plus: float = 0.0) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + plus
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + plus
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column, inclusive: bool = False) -> Column:
    """Of xyxy boxes; inclusive counts both end pixels. 0 where the union is not positive."""
    plus = 1.0 if inclusive else 0.0
    i = intersection(a, b, plus)
    union = area(a, plus) + area(b, plus) - i
    return F.when(union > 0, i / union).otherwise(0.0)


def iou_any_corners(a: Column, b: Column) -> Column:
    return iou(_ordered(a), _ordered(b))


def iou_clamped(a: Column, b: Column) -> Column:
    """Negative sides count as 0."""
    side = lambda x, y: F.greatest(F.lit(0.0), y - x)
    i = intersection(a, b)
    union = side(a[0], a[2]) * side(a[1], a[3]) + side(b[0], b[2]) * side(b[1], b[3]) - i
    return F.when(union > 0, i / union).otherwise(0.0)


def iou_xywh(a: Column, b: Column) -> Column:
    return iou_clamped(xywh_to_xyxy(a), xywh_to_xyxy(b))


def xyxy_to_xywh(b: Column) -> Column:
    return _box(b[0], b[1], b[2] - b[0], b[3] - b[1])


def xywh_to_xyxy(b: Column) -> Column:
    return _box(b[0], b[1], b[0] + b[2], b[1] + b[3])


def xyxy_to_cxcywh(b: Column) -> Column:
    return _box((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1])


def cxcywh_to_xyxy(b: Column) -> Column:
    return _box(b[0] - b[2] / 2, b[1] - b[3] / 2, b[0] + b[2] / 2, b[1] + b[3] / 2)


def clip(b: Column, width: Column | float, height: Column | float) -> Column:
    most = [width, height]
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return _box(*[F.greatest(F.lit(0.0), F.least(b[i], lit(most[i % 2]))) for i in range(4)])


def clip_rounded(b: Column, width: Column, height: Column) -> Column:
    """Corners rounded half to even and kept inside the image; null if nothing is left of the box."""
    side = [width, height]
    c = _box(*[F.greatest(F.lit(0.0), F.least(side[i % 2].cast("double"), F.bround(b[i]))) for i in range(4)])
    return let(c, lambda x: F.when((x[2] > x[0]) & (x[3] > x[1]), x))


def union_box(a: Column, b: Column) -> Column:
    return _box(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def ioa(a: Column, b: Column) -> Column:
    """Intersection over the area of b."""
    return F.when(area(b) > 0, intersection(a, b) / area(b)).otherwise(0.0)


def point_distance(x: Column, y: Column, b: Column) -> Column:
    dx = F.greatest(b[0] - x, F.lit(0.0), x - b[2])
    dy = F.greatest(b[1] - y, F.lit(0.0), y - b[3])
    return F.sqrt(dx * dx + dy * dy)


def jitter(b: Column, width: Column, height: Column, ratio: float) -> Column:
    """Each side moved outwards by ratio x its length, rounded and clipped."""
    dx, dy = (b[2] - b[0]) * ratio, (b[3] - b[1]) * ratio
    return clip_rounded(_box(b[0] - dx, b[1] - dy, b[2] + dx, b[3] + dy), width, height)


def valid(b: Column, width: Column | float, height: Column | float) -> Column:
    """Finite, ordered and inside the image."""
    finite = reduce(lambda x, y: x & y, [~F.isnan(b[i]) & (F.abs(b[i]) < float("inf")) for i in range(4)])
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.coalesce((F.size(b) == 4) & finite & (b[0] < b[2]) & (b[1] < b[3]) & (b[0] >= 0) & (b[1] >= 0) & (b[2] <= lit(width)) & (b[3] <= lit(height)), F.lit(False))


def score(prediction: Column | str, reference: Column | str) -> Column:
    """(official_iou, clean_iou, official_correct, clean_correct, format_valid) of box texts."""

    def scored(x: Column) -> Column:
        p, r = x["p"], x["r"]
        both = p.isNotNull() & r.isNotNull()
        o, c = F.when(both, iou(p, r, True)).otherwise(0.0), F.when(both, iou(p, r)).otherwise(0.0)
        return F.struct(o.alias("official_iou"), c.alias("clean_iou"), (o >= 0.5).alias("official_correct"), (c >= 0.5).alias("clean_correct"), p.isNotNull().alias("format_valid"))

    return let(F.struct(parse_percent(prediction).alias("p"), parse_percent(reference).alias("r")), scored)


def _with_corners(df: DataFrame, text: Column | str, out: str) -> tuple[DataFrame, list[Column]]:
    """df with the four corners of parse_percent as columns __{out}_0 to 3, in steps that are columns of their own, so each value is computed once in generated code."""
    t = lambda k: f"__{out}_{k}"
    found = F.slice(all_matches(F.regexp_replace(_c(text), r"(?i)\b[xy][12]\b", ""), NUMBER), 1, 4)
    # the lambda ends a span of generated code here: with two texts in one span its method is too long for the JIT
    df = df.withColumn(t("n"), F.transform(found, lambda n: n.cast("double")))
    df = df.withColumns({t(i): F.try_element_at(t("n"), F.lit(i + 1)) for i in range(4)})
    x = [F.col(t(i)) for i in range(4)]
    df = df.withColumns({t("hi"): F.greatest(*x), t("lo"): F.least(*x)})
    hi = F.col(t("hi"))
    df = df.withColumns({t(i): F.when(hi <= 1, x[i] * 100).when(hi > 100, x[i] / 10).otherwise(x[i]) for i in range(4)})
    df = df.withColumn(t("fits"), x[3].isNotNull() & (F.col(t("lo")) >= 0) & (hi <= 1000) & (x[0] != x[2]) & (x[1] != x[3]))
    ends = [F.least(x[0], x[2]), F.least(x[1], x[3]), F.greatest(x[0], x[2]), F.greatest(x[1], x[3])]
    return df.withColumns({t(i): F.when(F.col(t("fits")), e) for i, e in enumerate(ends)}).drop(t("n"), t("hi"), t("lo"), t("fits")), x


def with_percent_box(df: DataFrame, text: Column | str, out: str) -> DataFrame:
    """df with parse_percent of a text, in steps."""
    df, x = _with_corners(df, text, out)
    return df.withColumn(out, F.when(x[0].isNotNull(), F.array(*x))).drop(*[f"__{out}_{i}" for i in range(4)])


def with_score(df: DataFrame, prediction: Column | str, reference: Column | str) -> DataFrame:
    """df with the columns of score and both boxes, in steps over corners: elements of arrays, read many times, make code too long to be compiled."""
    df, p = _with_corners(df, prediction, "predicted_box")
    df, r = _with_corners(df, reference, "reference_box")
    df = df.withColumns({"__w": F.least(p[2], r[2]) - F.greatest(p[0], r[0]), "__h": F.least(p[3], r[3]) - F.greatest(p[1], r[1])})
    zero, parts = F.lit(0.0), {}
    for name, plus in (("official", 1.0), ("clean", 0.0)):
        parts[f"__{name}_i"] = F.greatest(zero, F.col("__w") + plus) * F.greatest(zero, F.col("__h") + plus)
        parts[f"__{name}_a"] = (p[2] - p[0] + plus) * (p[3] - p[1] + plus) + (r[2] - r[0] + plus) * (r[3] - r[1] + plus)
    df = df.withColumns(parts).withColumns({f"__{n}_a": F.col(f"__{n}_a") - F.col(f"__{n}_i") for n in ("official", "clean")})  # null without both boxes
    df = df.withColumns({f"{n}_iou": F.when(F.col(f"__{n}_a") > 0, F.col(f"__{n}_i") / F.col(f"__{n}_a")).otherwise(0.0) for n in ("official", "clean")})
    df = df.withColumns({"official_correct": F.col("official_iou") >= 0.5, "clean_correct": F.col("clean_iou") >= 0.5, "format_valid": p[0].isNotNull()})
    df = df.withColumns({"predicted_box": F.when(p[0].isNotNull(), F.array(*p)), "reference_box": F.when(r[0].isNotNull(), F.array(*r))})
    return df.drop("__w", "__h", *parts, *[f"__{o}_{i}" for o in ("predicted_box", "reference_box") for i in range(4)])


def crops_beside(b: Column, width: Column, height: Column, most: int = 4) -> Column:
    """Strips left, right, above and below an xywh box that don't touch it, of whole pixels.

    A margin of a fiftieth of the shorter side, 4 at least, stays free; strips with a side under 128 or less than a
    tenth of the image go; the largest come first, equals in the order named.
    """
    i = lambda x: x.cast("int")
    w, h = i(width), i(height)
    gap = F.greatest(F.lit(4), i(F.least(w, h) * 0.02))
    zero = F.lit(0)
    strips = [
        (zero, zero, F.greatest(zero, i(b[0]) - gap), h), (F.least(w, i(b[0] + b[2]) + gap), zero, w, h),
        (zero, zero, w, F.greatest(zero, i(b[1]) - gap)), (zero, F.least(h, i(b[1] + b[3]) + gap), w, h),
    ]
    rows = [F.struct((-(r - x) * (d - t)).alias("rank"), F.lit(k).alias("k"), F.array(x, t, r, d).alias("box")) for k, (x, t, r, d) in enumerate(strips)]
    big = lambda s: (s["box"][2] - s["box"][0] >= 128) & (s["box"][3] - s["box"][1] >= 128) & (-s["rank"] >= 0.1 * w * h)
    return F.transform(F.slice(F.array_sort(F.filter(F.array(*rows), big)), 1, most), lambda s: s["box"])


def iou_reward(prediction: Column | str, reference: Column | str) -> Column:
    """IoU of the first angle forms of both texts, 0 if one has none."""
    return let(F.struct(parse_signed_angle(prediction).alias("p"), parse_signed_angle(reference).alias("r")), lambda x: F.when(x["p"].isNotNull() & x["r"].isNotNull(), iou_any_corners(x["p"], x["r"])).otherwise(0.0))


def box_format_reward(prediction: Column | str) -> Column:
    """1 where the text holds an angle form."""
    return parse_signed_angle(prediction).isNotNull().cast("double")


def native_text(box: Column) -> Column:
    """A box as fixed-point text."""
    return F.concat(F.lit("["), F.array_join(F.transform(box, lambda x: F.format_string("%.6f", x)), ", "), F.lit("]"))


