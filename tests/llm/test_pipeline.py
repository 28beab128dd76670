"""The pipeline's stages on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark):
    import corpus_pipeline as P
    from rowforge.llm import common, decontamination, jaccard_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    seen = {}
    for name, stage in P.STAGES:
        before, docs = docs, common.cut(stage(spark, docs, SF), name)
        seen[name] = docs.count()
        if name != "sharding":
            assert docs.columns == before.columns
        if name not in ("mixing", "sharding"):
            assert docs.exceptAll(before).count() == 0
        if name == "near_duplicates":
            left = jaccard_join.jaccard_join(docs, size=P.SHINGLE, threshold=P.SIMILARITY)
            assert left.where("n_links > 0").count() == 0
        if name == "decontamination":
            assert decontamination.decontaminate(docs, bench).where("n_hit > 0").count() == 0
            assert decontamination.decontaminate(before, bench).where("n_hit = 0").count() == seen[name]
        if name == "mixing":
            assert docs.distinct().exceptAll(before).count() == 0 and docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert 0 < seen["toxicity"] <= 200 and seen["sharding"] == seen["mixing"]
    assert {r["shard"] for r in docs.select("shard").distinct().collect()} == set(range(8))


#: Names that stages work with.
CLASHES = ["target", "rest", "epochs", "at", "before", "here", "source_size", "taken", "size", "id", "rid", "n_hit", "n_words", "component_id", "n_links", "n_windows", "worst_span", "x_size", "x_source", "rank", "row", "__rid", "__row", "__k", "__size", "__text", "__node", "__h"]


def test_clashing_and_null_columns(spark):
    import corpus_pipeline as P
    from rowforge.llm import common

    rows = [(i if i % 5 else None, None if i % 7 == 0 else f"some text number {i} of words", None, None, 1, "x") for i in range(30)]
    docs = common.cut(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, shard string").withColumns({n: F.lit("x") for n in CLASHES}), "clash")
    for name, stage in P.STAGES:
        docs = common.cut(stage(spark, docs, SF), name)
        assert {"score", *CLASHES} <= set(docs.columns)
    empty = common.cut(spark.createDataFrame([], docs.drop("shard").schema), "none")
    for name, stage in P.STAGES:
        empty = common.cut(stage(spark, empty, SF), name)
    assert empty.count() == 0
