"""COCO shards as rows of objects (round 3)."""

import json

from rowforge.sources import writers


def test_no_row_holds_a_document(spark):
    images = spark.createDataFrame([(i, f"f{i}") for i in range(50)], "id long, file_name string")
    notes = spark.createDataFrame([(i % 60, i) for i in range(3000)], "image_id long, category_id long")
    kinds = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    rows = writers.coco_shard_lines(images, notes, kinds, 4).collect()
    docs = {x["shard"]: json.loads(x["value"]) for x in writers.coco_shards(images, notes, kinds, 4).collect()}
    assert max(len(x["value"]) for x in rows) < 60 and set(docs) == {0, 1, 2, 3}
    key = lambda x: json.dumps(x, sort_keys=True)
    for shard, doc in docs.items():
        for section in ("images", "annotations", "categories"):
            assert sorted(key(json.loads(x["value"])) for x in rows if (x["shard"], x["section"]) == (shard, section)) == sorted(map(key, doc[section]))
