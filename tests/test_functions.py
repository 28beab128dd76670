"""Text, box and hash columns against literals and plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from rowforge.functions import boxes as B
from rowforge.functions import hashing as H
from rowforge.functions import text as X


def values(spark, rows, *cols):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[1:] if len(cols) > 1 else r[1] for r in df.select("i", *cols).orderBy("i").collect()]


def test_answers(spark):
    assert values(spark, ["A  Grey-ish, car!", "x"], X.normalize_answer("s", aliases=True)) == ["a gray-ish car", "x"]
    assert values(spark, ["The cat, an owl"], X.normalize_qa("s")) == ["cat owl"]
    allowed = F.array(*map(F.lit, "ABCD"))
    assert values(spark, ["a red car", "B and C", "(b)", "[A, C]", "acd", "none"], X.choice_labels("s", allowed, True)) == [["A"], ["B", "C"], ["B"], ["A", "C"], ["A", "C", "D"], []]
    assert values(spark, ["B and C", "B. B"], X.choice_labels("s", allowed, False)) == [[], ["B"]]
    assert values(spark, ["C) is right, not A", "B"], X.mcq_letter("s")) == ["C", "B"]
    assert values(spark, ["<answer>x</answer> <answer> y\n</answer>", "no"], X.last_answer_tag("s")) == ["y", None]
    assert values(spark, ["#### 1,234", "the total is 12."], X.gsm8k_number("s"), X.gsm8k_number("s", strict=False)) == [("1234", "1234"), (None, "12.")]


def test_tokens_are_unicode(spark):
    assert values(spark, ["Ünïcode 变化, don't"], X.unicode_tokens("s")) == [["ünïcode", "变化", "don", "t"]]
    assert values(spark, ["don't 3 x-y"], X.ascii_tokens("s")) == [["don't", "3", "x", "y"]]
    assert values(spark, ["What color is it?", "Ships here"], X.question_family("s")) == ["what color", "ships"]


def test_first_match_only(spark):
    assert values(spark, ["top of top", "none"], X.spatial_flip("s")) == ["bottom of top", "none"]


def test_boxes(spark):
    said = ["x1: 10, y1=20; x2 30 y2 40", "0.1 0.2 0.3 0.4", "300 200 100 400", "1 2 3", "-1 2 3 4", "5 5 5 9", "1 2 3 2000"]
    got = values(spark, said, B.parse_percent("s"))
    assert [None if b is None else [round(x, 6) for x in b] for b in got] == [[10, 20, 30, 40], [10, 20, 30, 40], [10, 20, 30, 40], None, None, None, None]
    assert values(spark, ["at {<1><2><90><99>}", "{1, 2, 3, 4}", "[1.5,2,3,4]", "<1>"], B.parse_native("s")) == [[1, 2, 90, 99], [1, 2, 3, 4], [1.5, 2, 3, 4], None]
    a, b = F.array(*map(F.lit, (0.0, 0.0, 9.0, 9.0))), F.array(*map(F.lit, (5.0, 0.0, 14.0, 9.0)))
    assert [round(x, 6) for x in values(spark, ["x"], B.iou(a, b), B.iou(a, b, True))[0]] == [round(36 / 126, 6), round(50 / 150, 6)]
    assert values(spark, ["x"], B.xywh_to_xyxy(B.xyxy_to_xywh(b)))[0] == [5, 0, 14, 9]


def test_hashes(spark):
    assert values(spark, ["é"], H.rank_key(42, "s"))[0] == hashlib.sha256("42:é".encode()).hexdigest()
    assert values(spark, [None], H.stable_id("s", F.lit("b")))[0] == hashlib.sha256("None\x1fb".encode()).hexdigest()[:20]


def test_properties_of_the_normaliser(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    seen = []

    @settings(max_examples=60, deadline=None, database=None)
    @given(st.text(alphabet="aAbZ .+-\té变!'", max_size=20))
    def collect(s):
        seen.append(s)

    collect()
    want = [re.sub(r"\s+", " ", re.sub(r"[^a-z0-9.+-]+", " ", s.lower())).strip() for s in seen]
    assert values(spark, seen, X.normalize_answer("s")) == want


def test_boxed_answers(spark):
    from rowforge.functions import latex as L
    from rowforge.plans.latex_queries import BOXED

    df = spark.createDataFrame([(i, *c) for i, c in enumerate(BOXED)] + [(-1, None, "1", 0.0), (-2, r"\boxed{1}", None, 0.0), (-3, "", "", 0.0)], "i int, said string, reference string, want double")
    got = df.select("i", "said", "want", L.boxed_reward("said", "reference").alias("got")).collect()
    assert [(x["i"], x["said"]) for x in got if x["got"] != x["want"]] == []
    assert df.select(L.latex_equal(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("x")).first()[0]
