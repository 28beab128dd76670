r"""Answers written in LaTeX: the content of the last \boxed and whether two answers are written alike.

Only the writing is compared; what needs symbolic maths isn't decided here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import let
from .text import _c

#: What is replaced before answers are compared, in this order.
BEFORE_UNITS = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
UNIT = "\\text{ "
AFTER_UNITS = [("\\\\%", ""), ("\\%", ""), (" .", " 0."), ("{.", "{0.")]


def _replaced(s: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _count(s: Column, mark: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))


def braced(tail: Column) -> Column:
    """What stands between the brace that a text begins with and the one that closes it; null if it doesn't begin so or none closes it."""
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("taken"), F.lit(False).alias("done"))

    def step(s: Column, piece: Column) -> Column:
        depth = s["open"] + _count(piece, "{") - 1
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("open"), (s["taken"] + F.length(piece) + 1).alias("taken"), (depth == 0).alias("done")))

    def inside(t: Column) -> Column:
        closed = let(F.split(t, r"\}", -1), lambda p: F.slice(p, F.lit(1), F.size(p) - 1))  # each is followed by a closing brace
        return let(F.aggregate(closed, start, step), lambda s: F.when(F.startswith(t, F.lit("{")) & s["done"], F.substr(t, F.lit(2), s["taken"] - 2)))

    return let(tail, inside)


def last_boxed(text: Column | str) -> Column:
    r"""The content of the last \boxed{...}; where `\boxed ` stands anywhere, what follows its last one up to a dollar sign. Null without one or if its braces don't close."""
    t = _c(text)
    spaced = F.substring_index(F.substring_index(t, "\\boxed ", -1), "$", 1)
    return F.when(F.contains(t, F.lit("\\boxed ")), spaced).when(F.contains(t, F.lit("\\boxed")), braced(F.substring_index(t, "\\boxed", -1)))


def _each_part(s: Column, mark: str, fix, short: int = 0) -> Column:
    """s with fix applied to what follows each mark; null if nothing follows one; s itself if something shorter than `short` that no brace begins does."""

    def joined(parts: Column) -> Column:
        rest = F.slice(parts, F.lit(2), F.size(parts) - 1)
        loose = lambda x: ~F.startswith(x, F.lit("{"))
        fixed = F.concat(parts[0], F.array_join(F.transform(rest, lambda x: F.concat(F.lit(mark), F.when(loose(x), fix(x)).otherwise(x))), ""))
        return F.when(F.exists(rest, lambda x: x == ""), None).when(F.exists(rest, lambda x: loose(x) & (F.length(x) < short)), s).otherwise(fixed)

    pattern = mark.replace("\\", "\\\\")
    return F.when(F.contains(s, F.lit(mark)), let(F.split(s, pattern, -1), joined)).otherwise(s)


def normal_latex(answer: Column | str) -> Column:
    r"""An answer as it is compared: fractions and roots with braces, a/b as a fraction, no units, signs, blanks or sizes. Null where it can't be read (\frac or \sqrt at its end, two units)."""

    def units(s: Column) -> Column:
        n = F.size(F.split(s, r"\\text\{ ", -1))
        return F.when(n <= 2, F.substring_index(s, UNIT, 1))

    def lead(s: Column) -> Column:
        s = F.when(F.startswith(s, F.lit(".")), F.concat(F.lit("0"), s)).otherwise(s)
        return let(s, lambda x: F.when((_count(x, "=") == 1) & (F.length(F.substring_index(x, "=", 1)) <= 2), F.substring_index(x, "=", -1)).otherwise(x))

    def frac(x: Column) -> Column:
        a, b, rest = F.substr(x, F.lit(1), F.lit(1)), F.substr(x, F.lit(2), F.lit(1)), F.substr(x, F.lit(3))
        return F.concat(F.lit("{"), a, F.when(b == "{", F.lit("}{")).otherwise(F.concat(F.lit("}{"), b, F.lit("}"))), rest)

    def fractions(s: Column) -> Column:
        whole = r"-?[1-9][0-9]*|0"
        slash = F.regexp_replace(s, rf"^({whole})/({whole})$", r"\\frac{$1}{$2}")
        return F.when(s == "0.5", F.lit("\\frac{1}{2}")).otherwise(slash)

    root = lambda x: F.concat(F.lit("{"), F.substr(x, F.lit(1), F.lit(1)), F.lit("}"), F.substr(x, F.lit(2)))
    steps = [
        lambda s: units(s), lambda s: _replaced(s, AFTER_UNITS), lead, lambda s: _each_part(s, "\\sqrt", root), lambda s: F.replace(s, F.lit(" "), F.lit("")),
        lambda s: _each_part(s, "\\frac", frac, 2), fractions,
    ]
    out = _replaced(_c(answer), BEFORE_UNITS)
    for f in steps:
        out = let(out, f)
    return out


def latex_equal(left: Column | str, right: Column | str) -> Column:
    """Whether two answers are written alike; as they stand where one can't be read; two nulls are equal, one isn't."""
    a, b = _c(left), _c(right)
    both = let(F.struct(normal_latex(a).alias("a"), normal_latex(b).alias("b")), lambda n: F.when(n["a"].isNotNull() & n["b"].isNotNull(), n["a"] == n["b"]).otherwise(a == b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(both)


def boxed_reward(text: Column | str, reference: Column | str) -> Column:
    """1 if the last boxed answer is written like the reference, else 0."""
    return let(last_boxed(text), lambda x: F.when(x.isNotNull() & latex_equal(x, reference), 1.0).otherwise(0.0))
