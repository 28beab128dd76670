"""Vector queries that a review found to read a prefix."""

from rowforge.plans import registry


def test_whole_vectors_are_ranked(spark, tmp_path):
    rows = [(i, [0.0] * 60 + [float(i)] + [0.0] * 3, 1) for i in range(9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["v17_norm_top_k_whole"](spark, str(tmp_path)).collect()
    assert sorted(r["token_id"] for r in got) == [4, 5, 6, 7, 8]
