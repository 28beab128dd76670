"""Track documents as frame documents, by hand."""

import json

import pytest

from rowforge.operators import video_documents as D


def test_documents(spark, tmp_path):
    doc = {
        "videos": [{"id": 7, "file_names": ["b/0.jpg", "b/1.jpg"], "width": 4, "height": 3, "length": 2}, {"id": 3, "file_names": ["0.jpg"], "width": 1, "height": 1, "length": 1}, {"id": 9, "file_names": [], "width": 1, "height": 1, "length": 0}],
        "annotations": [
            {"id": 20, "video_id": 3, "category_id": 1, "iscrowd": 1, "bboxes": [[0, 0, 1, 1]], "areas": [1.0], "segmentations": ["r"]},
            {"id": 5, "video_id": 7, "category_id": 2, "iscrowd": 0, "bboxes": [None, [1, 1, 2, 2]], "areas": [None, 4.0], "segmentations": [None, "s"]},
            {"id": 6, "video_id": 7, "category_id": 1, "iscrowd": 0, "bboxes": [[0, 0, 9, 9], [0, 0, 8, 8], [5, 5, 5, 5]], "areas": [81.0], "segmentations": None},
        ],
        "categories": [{"id": 1, "name": "x"}, {"id": 2, "name": "y"}],
    }
    (tmp_path / "d.json").write_text(json.dumps(doc))
    videos, tracks, categories = D.track_documents(spark, str(tmp_path / "d.json"))
    assert {(r["id"], r["name"]) for r in D.video_list(videos).collect()} == {(7, "b"), (3, ""), (9, "")} and categories.count() == 2
    images = D.frame_images(videos)
    assert [tuple(r)[:6] for r in images.orderBy("id").collect()] == [(1, 7, "b/0.jpg", 4, 3, 0), (2, 7, "b/1.jpg", 4, 3, 1), (3, 3, "0.jpg", 1, 1, 0)]
    assert [tuple(r) for r in D.frame_annotations(images, tracks).orderBy("id").collect()] == [
        (1, 7, 1, 6, 1, [0.0, 0.0, 9.0, 9.0], 81.0, None, 0), (2, 7, 2, 5, 2, [1.0, 1.0, 2.0, 2.0], 4.0, "s", 0), (3, 7, 2, 6, 1, [0.0, 0.0, 8.0, 8.0], None, None, 0), (4, 3, 3, 20, 1, [0.0, 0.0, 1.0, 1.0], 1.0, "r", 1),
    ]
    said = [(0, 7, 1, 0.5, [[0.0] * 4, [1.0, 0.0, 2.0, 3.0]], None, None), (4, 3, 2, 0.25, [[0.0, 0.0, 2.0, 2.0]], [9.0], ["q"]), (5, 7, 2, 0.1, [[1.0, 1.0, 1.0, 1.0], None], [0.0, 1.0], None)]
    p = spark.createDataFrame(said, f"at long, {D.PREDICTIONS}")
    assert sorted(tuple(r) for r in D.frame_predictions(images, p).collect()) == [(1, 7, 3, 2, [1.0] * 4, 1.0, None, 0, 0.1), (2, 7, 1, 1, [1.0, 0.0, 2.0, 3.0], 6.0, None, 0, 0.5), (3, 3, 2, 2, [0.0, 0.0, 2.0, 2.0], 9.0, "q", 0, 0.25)]
    with pytest.raises(Exception, match="no image of video 3, frame 1"):
        D.frame_predictions(images, spark.createDataFrame([(0, 3, 1, 0.5, [None, [1.0] * 4], None, None)], f"at long, {D.PREDICTIONS}")).collect()
    assert D.frame_annotations(images, tracks.limit(0)).count() == 0 and D.frame_images(videos.limit(0)).count() == 0
