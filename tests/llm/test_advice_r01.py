"""Cases that a review found: each runs a job to its end where an earlier version cut it short."""

import random

import numpy as np
import pytest

pytest.importorskip("rowforge.llm.queries")

import corpus_pipeline  # noqa: E402
from rowforge.llm import common, license_scan, pii, suffix_dedup, toxicity  # noqa: E402


def test_op6_full_licence_texts_speak_for_their_directory(spark):
    named = dict(license_scan.full_texts())
    rows = []
    for name, text in named.items():
        rows += [(f"{name}/en/1", "Copyright (c) 2020 Jane Doe\n\n" + text.decode()), (f"{name}/en/2", "print(1)")]
    prose = "\n\n".join("The mill by the river was sold in spring and nobody knew who had bought it." for _ in range(40))
    rows += [("prose/en/1", prose + "\n\nReleased under the MIT License."), ("prose/en/2", "print(1)")]
    rows += [("parts/en/1", "Licensed under the MIT License.\n\nSPDX-License-Identifier: MIT\n\nReleased under the MIT License.\n\nTwo words"), ("parts/en/2", "print(1)")]
    found = license_scan.inherit(license_scan.declare(spark.createDataFrame(rows, "path string, text string"), keep=["path"])).collect()
    by = {r["path"]: r for r in found}
    for name in named:
        assert by[f"{name}/en/1"]["declared"] == name
        assert (by[f"{name}/en/2"]["licence"], by[f"{name}/en/2"]["from_dir"]) == (name, f"{name}/en")
    assert by["prose/en/1"]["declared"] == "MIT" and by["prose/en/2"]["licence"] is None
    assert by["parts/en/1"]["declared"] == "MIT" and by["parts/en/2"]["licence"] == "MIT"


def test_op6_passages_have_no_longest_reach():
    line = b"word " * 3000 + b"licensed here " + b"word " * 3000
    assert license_scan.passages(b"first\n\n" + line + b"\n\nlast") == [(7, 7 + len(line))]


@pytest.fixture
def moving_splits(spark, monkeypatch):
    """Files are split otherwise after each write, as when executors come and go."""
    key, cut, turn = "spark.sql.files.maxPartitionBytes", common.cut, []

    def moved(*a, **k):
        out = cut(*a, **k)
        turn.append(0)
        spark.conf.set(key, ["128m", "9k", "3k", "40k"][len(turn) % 4])
        return out

    monkeypatch.setattr(common, "cut", moved)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset(key)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def documents(spark, folder):
    """Documents of a few files: each third one bears a passage of 300 letters that the next such one repeats."""
    r = random.Random(3)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows, passage = [], ""
    for i in range(120):
        passage = letters(300) if i % 6 == 0 else passage
        rows.append((i, letters(r.randrange(250, 600)) + (passage if i % 3 == 0 else ""), "en", "s"))
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5).sortWithinPartitions("doc_id").write.option("parquet.block.size", 2000).parquet(path)
    return path


def test_op1_numbers_rows_alike_at_each_reading(spark, tmp_path, moving_splits):
    documents(spark, tmp_path)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.op1(spark, str(tmp_path)).collect()}
    assert len(got) == 120 and all(300 <= n < 320 if i % 3 == 0 else n == 0 for i, n in got.items())


def test_pipeline_numbers_rows_alike_at_each_reading(spark, tmp_path, moving_splits):
    path = documents(spark, tmp_path)
    docs = spark.read.parquet(path)
    docs = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 1000))
    docs.repartition(5).write.option("parquet.block.size", 2000).parquet(f"{tmp_path}/twice.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/twice.parquet"), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(120))


def test_op3_reads_words_to_their_end():
    r = random.Random(2)
    filler = lambda: "".join(r.choice("\u4e00\u4e8c\u4e09\u56db\u4e94\u516d") for _ in range(40))
    texts = [filler() + ("\u6bd2\u836f\u6bd2\u5bb3" if i % 2 else "") + filler()[:5] for i in range(300)]
    labels = np.arange(300) % 2
    model = toxicity.fit([t.encode() for t in texts[:240]], labels[:240])
    score = lambda t: toxicity._score(model, next(common.texts(toxicity.pa.array([t]))))["score"][0].as_py()
    assert sum((score(t) >= 0.5) == bool(y) for t, y in zip(texts[240:], labels[240:], strict=True)) >= 54


def test_op3_pieces_cover_each_trigram():
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    w = toxicity._pieces(next(common.texts(toxicity.pa.array(["short " + text, None, "ab"]))))
    parts = [("short " + text + "ab")[a:b] for a, b in zip(w.start, w.end, strict=True)]
    assert parts[0] == "short" and parts[-1] == "ab" and max(map(len, parts)) == 48 and w.off.tolist() == [0, len(parts) - 1, len(parts) - 1, len(parts)]
    assert {text[i : i + 3] for i in range(498)} == {p[i : i + 3] for p in parts[1:-1] for i in range(len(p) - 2)}


def test_op7_secrets_are_matched_to_their_end(spark):
    text = "token=" + "a1B2" * 100 + " and on"
    got = spark.createDataFrame([(text,)], "t string").select(pii.F.regexp_extract("t", pii.WIDE["secret"], 0)).first()[0]
    assert got == "token=" + "a1B2" * 100
