"""Video annotations by track as annotations by frame, and predictions alike.

A track document holds, for each object of a video, arrays over the frames; a frame document holds an image a frame and an annotation a
frame and object, with ids from 1 in the order of videos, frames and objects. Ids are ranks over ranges of that order, so no task numbers a whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .select import ordered_rank

VIDEOS = "id bigint, file_names array<string>, width int, height int, length int"
TRACKS = "id bigint, video_id bigint, category_id bigint, iscrowd int, bboxes array<array<double>>, areas array<double>, segmentations array<string>"
PREDICTIONS = "video_id bigint, category_id bigint, score double, bboxes array<array<double>>, areas array<double>, segmentations array<string>"
CATEGORIES = "id bigint, name string"


def track_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Videos and tracks with `at`, their place in their document, and categories, of JSON documents (S19). A file is one row while it is read."""
    doc = spark.read.schema(f"videos array<struct<{VIDEOS}>>, annotations array<struct<{TRACKS}>>, categories array<struct<{CATEGORIES}>>").option("multiLine", True).json(path)
    table = lambda c: doc.select(F.posexplode(c).alias("at", "x")).select(F.col("at").cast("long").alias("at"), "x.*")
    return table("videos"), table("annotations"), table("categories").drop("at")


def video_list(videos: DataFrame) -> DataFrame:
    """(id, name, width, height, length): the name is the folder of the first frame."""
    first = F.coalesce(F.try_element_at("file_names", F.lit(1)), F.lit(""))
    return videos.select("id", F.when(F.contains(first, F.lit("/")), F.regexp_replace(first, "/[^/]*$", "")).otherwise("").alias("name"), "width", "height", "length")


def frame_images(videos: DataFrame) -> DataFrame:
    """(id, video_id, file_name, width, height, frame_index, at): an image a frame, numbered from 1 by video and frame.

    videos: at, VIDEOS. Defined cases: a video without frames has no image; `at` is distinct.
    """
    rows = videos.select("at", F.col("id").alias("video_id"), "width", "height", F.posexplode("file_names").alias("frame_index", "file_name"))
    return ordered_rank(rows, ["at", "frame_index"], "id").select(F.col("id").cast("long").alias("id"), "video_id", "file_name", "width", "height", "frame_index", "at")


def _frames(tracks: DataFrame, keep: list[str]) -> DataFrame:
    """tracks with a row a frame: frame_index, bbox, area and segmentation; arrays may be shorter or null."""
    value = lambda c: F.try_element_at(c, F.col("frame_index") + 1)
    rows = tracks.select(*keep, "bboxes", "areas", "segmentations", F.posexplode("bboxes").alias("frame_index", "bbox")).where(F.col("bbox").isNotNull())
    return rows.select(*keep, "frame_index", "bbox", value("areas").alias("area"), value("segmentations").alias("segmentation"))


def frame_annotations(images: DataFrame, tracks: DataFrame) -> DataFrame:
    """(id, video_id, image_id, track_id, category_id, bbox, area, segmentation, iscrowd), numbered from 1 by video, frame and track.

    tracks: at, TRACKS. Defined cases: frames with a null box, and boxes of frames that the video doesn't have, give none; a null area or segmentation stays null.
    """
    frames = _frames(tracks.withColumnRenamed("at", "track_at").withColumnRenamed("id", "track_id"), ["track_at", "track_id", "video_id", "category_id", "iscrowd"])
    rows = frames.join(images.select("video_id", "frame_index", F.col("id").alias("image_id")), ["video_id", "frame_index"])
    return ordered_rank(rows, ["image_id", "track_at"], "id").select(F.col("id").cast("long").alias("id"), "video_id", "image_id", "track_id", "category_id", "bbox", "area", "segmentation", "iscrowd")


def frame_predictions(images: DataFrame, predictions: DataFrame) -> DataFrame:
    """(image_id, video_id, track_id, category_id, bbox, area, segmentation, iscrowd, score): a prediction is a track, numbered from 1 in its order.

    predictions: at, PREDICTIONS. Defined cases: null boxes and boxes of zeros are absent; an area that is null or not over 0 is that of the box; a
    box of a frame that no image has is an error.
    """
    numbered = ordered_rank(predictions, ["at"], "track_id").withColumn("track_id", F.col("track_id").cast("long"))
    frames = _frames(numbered, ["track_id", "video_id", "category_id", "score"]).where(F.exists("bbox", lambda x: x != 0))
    rows = frames.join(images.select("video_id", "frame_index", F.col("id").alias("image_id")), ["video_id", "frame_index"], "left")
    missing = F.raise_error(F.concat(F.lit("no image of video "), F.col("video_id").cast("string"), F.lit(", frame "), F.col("frame_index").cast("string"))).cast("long")
    area = F.when(F.col("area") > 0, F.col("area")).otherwise(F.col("bbox")[2] * F.col("bbox")[3])
    return rows.select(F.coalesce("image_id", missing).alias("image_id"), "video_id", "track_id", "category_id", "bbox", area.alias("area"), "segmentation", F.lit(0).alias("iscrowd"), "score")
