"""Folders of the file index, and options drawn from a whole pool."""

import collections

from pyspark.sql import functions as F

from rowforge.operators import normalise as N
from rowforge.sources import readers


def test_only_folders_below_the_root_are_pruned(spark, tmp_path):
    root = tmp_path / ".cache" / "my test data" / "root"
    for name in ("a.png", "deep/er/b.PNG", "deep/c.txt", "tests/d.png", "deep/latest/e.png", ".hidden/f.png", "deep/.x/g.png", "test.png"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    for folder in (root, f"file:{root}", f"{root}/"):
        assert {r["name"] for r in readers.file_index(spark, str(folder)).collect()} == {"a.png", "b.PNG", "test.png"}
    assert {r["name"] for r in readers.file_index(spark, f"{tmp_path}/.cache/*/root").collect()} == {"a.png", "b.PNG", "test.png"}


def choices(spark, answers):
    df = spark.createDataFrame([(i, f"q{i}", a) for i, a in enumerate(answers)], "id long, question string, answer string")
    return N.synthetic_mcq(df, "id", "question", "answer", 42).orderBy("id").collect()


def test_no_row_loses_its_options(spark):
    answers = [f"answer {i}" for i in range(3000)] + ["red", "Red", " RED ", "r e d", "r  E d", None, "", "answer 7", "answer 7"]
    got = choices(spark, answers)
    assert len(got) == len(answers)
    fold = lambda s: " ".join(s.lower().split())
    letters = collections.Counter()
    for x, a in zip(got, answers, strict=True):
        if a is None:
            assert x["options"] is None and x["label"] is None
            continue
        assert len(set(x["options"])) == 4 and x["options"]["ABCD".index(x["label"])] == a
        assert all(fold(o) != fold(a) for o in x["options"] if o != a) and set(x["options"]) <= set(answers)
        letters[x["label"]] += 1
    assert min(letters.values()) > 0.2 * len(answers)
    drawn = collections.Counter(o for x in got if x["options"] for o in x["options"])
    assert len(drawn) > 2900


def test_pools_under_four(spark):
    assert [tuple(x)[2:] for x in choices(spark, ["a", "b", "c"])] == [(None, None)] * 3
    assert all(x["label"] for x in choices(spark, ["a", "b", "c", "d"])) and choices(spark, []) == []
    assert [x["label"] is None for x in choices(spark, ["a", "A", "b", "c", "d"])] == [False] * 5


def test_large_pools(spark):
    df = spark.range(200_000).select("id", F.lit("q").alias("question"), F.concat(F.lit("answer "), F.col("id").cast("string")).alias("answer"))
    got = N.synthetic_mcq(df, "id", "question", "answer", 1)
    row = got.agg(F.count("*"), F.min(F.size("options")), F.count("label")).first()
    assert tuple(row) == (200_000, 4, 200_000)


def test_rewards_of_a_file(tmp_path):
    import pytest

    from rowforge.functions import registry

    path = tmp_path / "mine.py"
    path.write_text("def scaled(prediction, reference, by=1):\n    return (prediction, reference, by)\n")
    assert registry.load_reward(str(path), "scaled")(1, 2) == (1, 2, 1) and registry.load_reward(str(path), "scaled", by=5)(1, 2) == (1, 2, 5)
    with pytest.raises(FileNotFoundError, match="no such file"):
        registry.load_reward(str(tmp_path / "none.py"), "scaled")
    with pytest.raises(AttributeError, match="has no function"):
        registry.load_reward(str(path), "other")
