"""Operators against small literals and plain Python."""

import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowforge import schema
from rowforge.operators import aggregate as A
from rowforge.operators import batch as W
from rowforge.operators import joins as J
from rowforge.operators import ngrams as M
from rowforge.operators import normalise as N
from rowforge.operators import select as S
from rowforge.operators import validate as V
from rowforge.operators import vision as D


def test_attempts(spark):
    rows = spark.createDataFrame([("1", 1, "", "bad"), ("1", 2, "red", None), ("1", 3, "", "bad"), ("2", 1, "", "bad")], "id string, attempt int, prediction string, error string")
    got = {r["id"]: r["attempt"] for r in S.latest_success(rows, "id", "attempt", V.blank("error")).collect()}
    assert got == {"1": 2, "2": 1}
    assert S.explicit_attempt(rows.where("id = '1'"), "id", "attempt", 3).count() == 1
    with pytest.raises(Exception, match="attempts of 2"):
        S.explicit_attempt(rows, "id", "attempt", 3).collect()


def test_samples_dont_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("g"))
    a = {r["k"] for r in S.coverage_sample(df, "k", "g", 0.1, 42).collect()}
    b = {r["k"] for r in S.coverage_sample(df.repartition(9).orderBy(F.rand(1)), "k", "g", 0.1, 42).collect()}
    assert a == b and len(a) == 7 * 8
    parts = S.stratified_split(df, "k", "g", {"x": 100, "y": 50}, 1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"x": 100, "y": 50, None: 350}


def test_frozen_split(spark):
    df = spark.range(3).select(F.col("id").alias("k"))
    lists = spark.createDataFrame([(0, "a"), (1, "b")], "k long, split string")
    with pytest.raises(ValueError, match="uncovered 1"):
        S.frozen_split(df, "k", lists)


def test_balanced_fold(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3), (2, "b", 4), (3, "a", 5)], "img int, kind string, id int")
    kinds = [r["kind"] for r in S.balanced_fold(df, "img", "kind").orderBy("img").collect()]
    assert kinds == ["a", "b", "a"]


def test_mcnemar_and_delta(spark):
    df = spark.createDataFrame([(False, True), (True, True)], "b boolean, a boolean")
    r = A.mcnemar(df, [], "b", "a").first()
    assert r["delta"] == 0.5 and r["gained"] == 1 and r["p"] == 1.0
    many = spark.createDataFrame([(False, True)] * 20 + [(True, False)] * 5, "b boolean, a boolean")
    assert A.mcnemar(many, [], "b", "a").first()["p"] == pytest.approx(0.00511, abs=2e-5)


def test_bootstrap_holds_the_mean(spark):
    df = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("double").alias("v"))
    r = A.bootstrap_ci(df, [], "v", "id", repeats=200).first()
    assert r["mean"] == 0.25 and 0.19 < r["low"] < 0.25 < r["high"] < 0.31


def test_scans_along_arrays(spark):
    r = spark.range(1).select(A.reward_to_go(F.array(*map(F.lit, (1.0, 2.0, 3.0))), 0.5).alias("g"), A.gae(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(0.5), F.lit(0.25)), 1.0, 0.5).alias("a")).first()
    assert r["g"] == [2.75, 3.5, 3.0] and r["a"] == [0.75 + 0.5 * 0.75, 0.75]


def test_promotion_gate(spark):
    ddl = "name string, accuracy double, mean_pop double, tree_search_samples int, negative_fpr double"
    c = spark.createDataFrame([("up", 0.7, 1.0, 10, 0.1), ("down", 0.5, 1.0, 10, 0.1), ("fpr", 0.7, 1.0, 10, 0.3)], ddl)
    b = spark.createDataFrame([("b", 0.6, 2.0, 10, 0.2)], ddl).drop("name")
    assert {r["name"]: r["promoted"] for r in A.promotion_gate(c, b).collect()} == {"up": True, "down": False, "fpr": False}


def test_joins(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k int, f string")
    f = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (3, "c"), (9, "z")], "k int, f string")
    assert {r["k"]: r["status"] for r in J.merge_shards(e, f, "k", "f").collect()} == {1: "ok", 2: "drift", 3: "duplicate", 4: "missing", 9: "unexpected"}
    with pytest.raises(Exception, match="unpaired"):
        J.paired(e, f, "k", ["f"]).collect()
    with pytest.raises(Exception, match="conflict in row"):
        J.union_columns(e, f.dropDuplicates(["k"]), "k").collect()


def test_samples_validate(spark):
    row = {"id": "1", "dataset": "d", "subtask": "s", "task_type": "single_choice", "prompt": "p", "images": [{"path": "a", "role": "r", "width": 3, "height": 0, "transform": None}], "references": [], "choices": {"A": "x"}, "answer_labels": ["B"], "accepted_labels": [], "clean_status": "keep", "issues": ["exclude:x"], "metadata": "{}", "split": "t", "source": "{}", "schema_version": "1.0"}
    df = spark.createDataFrame([row], schema.SAMPLE)
    assert sorted(df.select(V.sample_reasons()).first()[0]) == ["dimensions", "kept_exclusion", "labels"]
    good, bad = V.quarantine(df, V.sample_reasons())
    assert good.count() == 0 and bad.count() == 1
    with pytest.raises(Exception, match="sample: dimensions"):
        V.require(df, V.sample_reasons(), "sample").collect()


def test_records_validate(spark):
    rows = [("1", ["a.png"], [{"from": "human", "value": "<image>\nq"}, {"from": "gpt", "value": "B"}], 1.0), ("2", ["/a.png"], [{"from": "human", "value": "q"}], -1.0)]
    df = spark.createDataFrame(rows, schema.CONVERSATIONS)
    got = {r["id"]: sorted(r["w"]) for r in df.select("id", V.record_reasons().alias("w")).collect()}
    assert got == {"1": [], "2": ["absolute", "images", "roles", "weight"]}
    assert df.select(V.answer_fits(F.lit("{<1><2><90><99>}"), "vrs_grounding"), V.answer_fits(F.lit("F"), "mcq")).first()[:] == (True, False)


def test_conversions(spark):
    rows = [([{"role": "user", "content": [{"type": "image", "image": "a.png", "text": None}, {"type": "text", "image": None, "text": "[MCQ] which?\n(A) red\n(B) blue"}]}, {"role": "assistant", "content": [{"type": "text", "image": None, "text": "(B) blue"}]}], None)]
    df = spark.createDataFrame(rows, schema.MESSAGES)
    s = N.to_samples(df, "d", "t").first()
    assert s["task_type"] == "single_choice" and s["answer_labels"] == ["B"] and s["image_list"] == ["a.png"] and s["choices"] == {"A": "red", "B": "blue"}
    c = N.to_conversations(df).first()
    assert c["conversations"][0]["value"].startswith("<image>\n[MCQ]") and c["conversations"][1]["value"] == "(B) blue"
    refs = spark.createDataFrame([('{"text": "a b"}',), ('["x", {"value": "y"}]',), ("plain",)], "r string").select(N.reference_text("r")).collect()
    assert [r[0] for r in refs] == ["a b", "x y", "plain"]
    m = N.mcq_source(spark.createDataFrame([("a.png", "What?", ["A. r", "B) s", "t", "u"], "b")], schema.MCQ)).first()
    assert m["options"] == ["r", "s", "t", "u"] and m["answer"] == "B"


def test_coverage_of_similarity(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", ["the cat sat on the mat"]), (2, "a dog", ["one two three", "a dog barks"])], "id int, prediction string, references array<string>")
    b = M.corpus_bleu(df).first()
    assert b["bleu_1"] == pytest.approx(np.exp(1 - 9 / 8)) and b["bleu_4"] > 0
    assert [round(r["score"], 6) for r in M.rouge_l(df).orderBy("id").collect()] == [1.0, 0.8]
    assert M.meteor(df).where("id = 1").first()["score"] == pytest.approx(1 - 0.5 / 6**3)
    d = M.cider_d(df).orderBy("id").collect()
    assert d[0]["score"] == pytest.approx(10.0) and 0 < d[1]["score"] < 10


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (4, 6), (6, 4), (5, 5), (0, 3)]:
        for _ in range(20):
            c = rng.random((n, m))
            r, k = D.assign(c)
            small = min(n, m)
            assert len(r) == small and len(set(r)) == small and len(set(k)) == small
            want = min((sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)), default=0) if n <= m else min(sum(c[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
            assert c[r, k].sum() == pytest.approx(want)


def test_selectors():
    x = np.array([[1, 0], [0.98, 0.02], [0, 1], [-1, 0]], float)
    assert D.max_min_select(x, 2).tolist() == [0, 3]
    assert D.max_min_select(x, 4).tolist() == [0, 1, 2, 3]
    assert len(D.coverage_select(x, 2)) == 2 and D.uniform_places(5, 3) == [0, 2, 4]
    assert D.low_pass(np.ones((8, 8, 2)), 4, 4) == pytest.approx(np.ones((4, 4, 2)))


def test_masks():
    m = D.polygon_mask([1, 1, 5, 1, 5, 4, 1, 4], 6, 7)
    assert m.sum() == 12 and (D.rle_decode(D.rle_encode(m), 6, 7) == m).all()
    assert D.mask_iom(m, m) == 1.0


def test_suppression_and_ap(spark):
    ddl = "image string, prediction_id int, score double, box array<double>"
    p = spark.createDataFrame([("i", 1, 0.9, [10.0, 10.0, 30.0, 30.0]), ("i", 2, 0.8, [11.0, 11.0, 31.0, 31.0]), ("i", 3, 0.7, [50.0, 50.0, 60.0, 60.0])], ddl)
    assert sorted(r["prediction_id"] for r in D.nms(p, ["image"], "prediction_id", "score", "box", 0.5).collect()) == [1, 3]
    g = spark.createDataFrame([("i", [10.0, 10.0, 30.0, 30.0]), ("i", [50.0, 50.0, 60.0, 60.0])], "image string, box array<double>")
    ap = {r["level"]: r["ap"] for r in D.average_precision_101(D.match_detections(g, p, "image"), 2, "image").collect()}
    want = (51 * 1.0 + 50 * 2 / 3) / 101
    assert ap[0.5] == pytest.approx(want)
    t = D.cgf1_totals(D.cgf1_images(g, p, "image", 0.5)).where("level = 0.5").first()
    assert (t["tp"], t["fp"], t["fn"]) == (2, 1, 0)


def test_hota_of_a_perfect_track(spark):
    rows = spark.createDataFrame([("s", t, k) for t in range(4) for k in (1, 2)], "seq string, t long, k long")
    g, p = rows.withColumnRenamed("k", "gt_id"), rows.withColumnRenamed("k", "tr_id")
    s = rows.select("seq", "t", F.col("k").alias("gt_id"), F.col("k").alias("tr_id"), F.lit(1.0).alias("sim"))
    assert all(r["hota"] == pytest.approx(1.0) for r in D.hota_combine(D.hota_sequences(s, g, p, "seq")).collect())


def test_partitions():
    w = [8, 7, 6, 5, 4]
    parts = W.karmarkar_karp(w, 2)
    assert sorted(i for p in parts for i in p) == list(range(5)) and abs(sum(w[i] for i in parts[0]) - sum(w[i] for i in parts[1])) <= 2
    assert all(len(p) == 2 for p in W.karmarkar_karp([1, 2, 3, 4], 2, equal=True))
    bins, back = W.micro_batches([W_ * W_ for W_ in w], w, 10)
    flat = [i for b in bins for i in b]
    assert [flat[b] for b in back] == list(range(5))


def test_readers_and_writers(spark, tmp_path):
    from rowforge.sources import readers, writers

    good, bad = tmp_path / "g.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\n')
    bad.write_text('{"a": 1}\nnot json\n')
    assert sorted(r["a"] for r in readers.jsonl(spark, str(good), "a int").collect()) == [1, 2]
    assert [(r["line"], r["a"]) for r in readers.jsonl_numbered(spark, str(good), "a int").orderBy("line").collect()] == [(1, 1), (3, 2)]
    with pytest.raises(Exception, match="not a JSON object|MALFORMED|Malformed"):
        readers.jsonl_numbered(spark, str(bad), "a int").collect()
    with pytest.raises(Exception):
        readers.jsonl(spark, str(bad), "a int").collect()
    rows, broken = readers.jsonl_lenient(spark, str(bad), "a int")
    assert rows.count() == 1 and broken.count() == 1
    arr = tmp_path / "x.json"
    arr.write_text(json.dumps([{"a": 5}, {"a": 6}]))
    assert readers.json_any(spark, str(arr), "a int").count() == 2
    out = str(tmp_path / "t")
    assert writers.replace(spark.range(3), out) == 3 and writers.replace(spark.range(2), out) == 2
    with pytest.raises(ValueError, match="nothing to write"):
        writers.replace(spark.range(0), out)
    assert spark.read.parquet(out).count() == 2
    writers.jsonl(spark.range(10).withColumn("n", F.lit(None).cast("string")), str(tmp_path / "j"), "id")
    assert [r["id"] for r in readers.jsonl_shards(spark, str(tmp_path / "j"), "id int").orderBy("line_number").collect()] == list(range(10))


def test_arrow_shards(spark, tmp_path):
    import pyarrow as pa

    from rowforge.sources import readers

    t = pa.table({"k": [1, 2, 3], "s": ["a", "b", None]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t)
    got = readers.arrow_ipc(spark, str(tmp_path), ["k"]).orderBy("row").collect()
    assert [(r["row"], r["k"]) for r in got] == [(0, 1), (1, 2), (2, 3)]


def test_bounded_queue_stream(spark, tmp_path):
    from rowforge.streaming import streams as R

    src = str(tmp_path / "in")
    spark.range(5).select(F.lit("q").alias("k"), F.col("id").cast("string").alias("v"), F.col("id").alias("o")).coalesce(1).write.parquet(src)
    stream = R.bounded_source(spark, src, "k string, v string, o long")
    q = R.bounded_queue(stream, "k", "v", "o", 3).writeStream.format("memory").queryName("queue").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    r = spark.sql("select * from queue order by produced desc").first()
    assert (r["produced"], r["dropped"], r["held"]) == (5, 2, ["2", "3", "4"])


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    from rowforge.streaming import streams as R

    ev = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:01", "2024-01-01 00:59", "2024-01-01 01:01"]), "k": ["a", "a", "b"]}))
    ev.write.parquet(str(tmp_path / "e"))
    stream = R.bounded_source(spark, str(tmp_path / "e"), "ts timestamp, k string", 10)
    q = R.tumbling(stream, "ts", "1 hour", ["k"]).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.sql("select start, k, n from hours").collect())) == sorted(map(tuple, R.tumbling(ev, "ts", "1 hour", ["k"]).select("start", "k", "n").collect()))


def test_efficiency_is_exact_in_groups_of_any_make(spark):
    rows = [("a", float((i * 7919) % 1000)) for i in range(2001)] + [("b", 5.0)] * 300 + [("b", 1.0), ("c", 2.5), ("d", None), (None, 3.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    for by in (["g"], []):
        got = sorted(map(str, A.efficiency(df, by, "x").collect()))
        want = df.groupBy(*by).agg(
            F.avg("x").alias("mean"), F.percentile("x", 0.5).alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY x)").alias("p95"), F.sum("x").alias("total"), F.max("x").alias("most")
        )
        assert got == sorted(map(str, want.collect()))
    assert A.efficiency(df.where("false"), ["g"], "x").count() == 0


def test_ordered_rank_is_a_row_number(spark):
    rows = [(None if i % 13 == 0 else (i * 37) % 101, f"k{i % 7}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, i int")
    got = {r["i"]: r["rank"] for r in S.ordered_rank(df, ["a", "b", "i"], bins=9).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert got == {r[2]: n for n, r in enumerate(order, 1)}
    assert S.ordered_rank(df.where("false"), ["a"]).count() == 0
