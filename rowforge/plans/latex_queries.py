"""Queries of LaTeX answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.functions import latex as L

from .cases import cases
from .registry import query

#: (said, reference, reward), worked out by hand.
BOXED = [
    (r"so \boxed{42}", "42", 1.0), (r"\boxed{1} then \boxed{2}", "2", 1.0), (r"\boxed{1} then \boxed{2}", "1", 0.0), ("no box 42", "42", 0.0), (r"\fbox{42}", "42", 0.0), (r"\boxed{42", "42", 0.0),
    (r"\boxed{\frac{1}{2}}", "1/2", 1.0), (r"\boxed{\dfrac12}", r"\tfrac{1}{2}", 1.0), (r"\boxed{0.5}", r"\frac12", 1.0), (r"\boxed{.5}", "0.5", 1.0), (r"\boxed{\frac1{72}}", r"\frac{1}{72}", 1.0), (r"\boxed{\frac{72}1}", r"\frac{72}{1}", 0.0),
    (r"\boxed{\frac{\sqrt3}{2}}", r"\frac{\sqrt{3}}{2}", 1.0), (r"\boxed{\sqrt 2}", r"\sqrt{2}", 0.0), (r"\boxed{2\sqrt5+\sqrt{7}}", r"2\sqrt{5}+\sqrt7", 1.0), (r"\boxed{x=3}", "3", 1.0), (r"\boxed{xyz=3}", "3", 0.0), (r"\boxed{a=b=3}", "3", 0.0),
    (r"\boxed{5 \text{ cm}}", "5", 1.0), (r"\boxed{5\text{cm}}", "5", 0.0), (r"\boxed{5\text{ cm}\text{ or so}}", "5", 0.0), (r"\boxed{30^\circ}", "30", 1.0), (r"\boxed{30^{\circ}}", "30", 1.0), (r"\boxed{\$7}", "7", 1.0),
    (r"\boxed{50\%}", "50", 1.0), (r"\boxed{\left(1,2\right)}", "(1, 2)", 1.0), (r"\boxed{1\!000}", "1000", 1.0), (r"\boxed{a \\ b}", r"a\b", 1.0), (r"\boxed{-3/4}", r"-\frac{3}{4}", 0.0), (r"\boxed{-3/4}", r"\frac{-3}{4}", 1.0),
    (r"\boxed{03/4}", r"\frac{3}{4}", 0.0), (r"\boxed{a/b}", "a/b", 1.0), (r"\boxed{1/2/3}", "1/2/3", 1.0), (r"\boxed{{1}}", "{1}", 1.0), (r"\boxed{f(x)=\{{p}\}}", r"f(x)=\{{p}\}", 1.0), (r"\boxed {p}$ and more", "{p}", 1.0),
    (r"it is \boxed 9$.", "9", 1.0), (r"\boxed{}", "", 1.0), (r"\boxed{x\frac}", r"x\frac", 1.0), (r"\boxed{x\frac}", "x", 0.0), (r"\boxed{\frac1}", r"\frac1", 1.0), (r"\boxed5{3}", "3", 0.0),
    (r"\boxed{{.5}}", "{0.5}", 1.0), (r"\boxed{a .5}", "a0.5", 1.0),
]


@cases("t23_boxed_reward", BOXED, {"reward": "DOUBLE"})
def _(said, reference):
    return L.boxed_reward(said, reference)


@cases(
    "t23_last_boxed",
    [(r"a \boxed{b {c} d} e}", "b {c} d"), (r"\boxed{x} \boxed{y", None), (r"\boxed{{p}}", "{p}"), (r"\boxed q$r \boxed{z}", "q"), ("{p}", None), (r"\boxed{}", ""), (r"\fbox{1}", None), (r"\boxed{\{}} \}", r"\{}")],
    {"content": "VARCHAR"},
)
def _(said):
    return L.last_boxed(said)


@query(
    "t23_conversations",
    r"""WITH c AS (SELECT conv_id, turn, length(text) AS n, text FROM conversations)
       SELECT conv_id, turn, '\frac{' || turn || '}{' || n || '}' AS normal, CASE WHEN contains(text, '\boxed') THEN NULL ELSE 1.0 END AS reward FROM c""",
)
def _(t):
    """Each turn ends in an answer written in one way and is held against another way to write it."""
    n = F.char_length("text")
    share = F.concat(F.col("turn").cast("string"), F.lit("/"), n.cast("string"))
    said = F.concat("text", F.lit(" \\boxed{x = \\left. "), share, F.lit(" \\right. \\text{ of it}}"))
    wide = F.concat(F.lit("\\dfrac{"), F.col("turn").cast("string"), F.lit("}{"), n.cast("string"), F.lit("}"))
    spoken = F.replace(F.replace(said, F.lit("\\left. "), F.lit("")), F.lit(" \\right."), F.lit(""))
    return t("conversations").select("conv_id", "turn", L.normal_latex(wide).alias("normal"), F.when(~F.contains("text", F.lit("\\boxed")), L.boxed_reward(spoken, wide)).alias("reward"))
