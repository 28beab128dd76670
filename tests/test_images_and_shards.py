"""Image heads as they are written, Arrow shards as they are read, and the report of two protocols over small groups."""

import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowforge import schema
from rowforge.functions import images as I  # noqa: E741
from rowforge.operators import reports as R
from rowforge.sources import arrow as A


def png(w, h):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (3 * w + 1) * h)) + chunk(b"IEND", b"")


def tiff(w, h, end):
    entry = lambda tag, kind, v: struct.pack(end + "HHI", tag, kind, 1) + (struct.pack(end + "HH", v, 0) if kind == 3 else struct.pack(end + "I", v))
    return (b"II*\x00" if end == "<" else b"MM\x00*") + struct.pack(end + "I", 8) + struct.pack(end + "H", 2) + entry(256, 3, w) + entry(257, 4, h) + b"\0" * 4


def jpeg(w, h, frame=0xC2):
    exif = b"\xff\xe1" + struct.pack(">H", 2 + 70) + b"\xff\xc0\x00\x11\x08\x00\x01\x00\x01" + b"x" * 61
    tables = b"\xff\xc4" + struct.pack(">H", 5) + b"abc"
    return b"\xff\xd8" + exif + tables + b"\xff\xff" + bytes([frame]) + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 20 + b"\xff\xd9"


IMAGES = {
    "png": (png(32, 24), ("png", 32, 24, True)), "cut png": (png(32, 24)[:-5], ("png", 32, 24, False)), "head of png": (png(9, 9)[:20], ("png", None, None, False)),
    "gif": (b"GIF87a" + struct.pack("<HH", 300, 2) + b"xx;", ("gif", 300, 2, True)), "jpeg": (jpeg(640, 480), ("jpeg", 640, 480, True)), "baseline": (jpeg(7, 5, 0xC0)[:-2], ("jpeg", 7, 5, False)),
    "no frame": (b"\xff\xd8\xff\xe0\x00\x04ab", ("jpeg", None, None, False)), "tiff": (tiff(1000, 70000, "<"), ("tiff", 1000, 70000, True)), "big tiff": (tiff(3, 4, ">"), ("tiff", 3, 4, True)),
    "bmp": (b"BM" + struct.pack("<IIIIii", 26, 0, 26, 12, 5, -6), ("bmp", 5, 6, True)), "webp": (b"RIFF" + struct.pack("<I", 22) + b"WEBPVP8 " + b"\0" * 4 + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 16384 + 33, 44), ("webp", 33, 44, True)),
    "lossless": (b"RIFF" + struct.pack("<I", 17) + b"WEBPVP8L" + b"\0" * 4 + b"\x2f" + struct.pack("<I", 99 | 199 << 14), ("webp", 100, 200, True)), "text": (b"not an image", (None, None, None, False)), "empty": (b"", (None, None, None, False)), "null": (None, (None, None, None, False)),
}


def test_heads(spark):
    rows = spark.createDataFrame([(k, None if v[0] is None else bytearray(v[0])) for k, v in IMAGES.items()], "name string, content binary")
    got = {x["name"]: tuple(x["h"]) for x in rows.select("name", I.image_header("content").alias("h")).collect()}
    assert got == {k: v[1] for k, v in IMAGES.items()}


def test_declared_sizes(spark):
    files = spark.createDataFrame([(k, None if v[0] is None else bytearray(v[0])) for k, v in IMAGES.items()] + [("png", bytearray(IMAGES["png"][0])), ("gif", bytearray(IMAGES["png"][0]))], "name string, content binary")
    cases = [
        ("png", '{"width": 32, "height": 24}', []), ("png", '{"width": 24, "height": 32}', ["size"]), ("png", '{"width": "32", "height": 24}', ["width"]), ("png", '{"width": true, "height": -1}', ["width", "height"]), ("png", None, ["width", "height"]),
        ("cut png", '{"height":24,"width":32}', ["cut"]), ("text", '{"width": 1, "height": 1}', ["unreadable"]), ("gone", '{"width": 1, "height": 1}', ["missing"]), (None, '{"width": 1, "height": 1}', ["no_image"]), (" ", '{"width": 1, "height": 3.5}', ["no_image", "height"]),
        ("gif", '{"width": 300, "height": 2}', ["unreadable"]),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "id int, image string, declared string").withColumn("kind", F.lit("x"))
    got = I.size_reasons(df, files, "image", "declared")
    assert got.columns == ["id", "image", "declared", "kind", "reasons"]
    assert {x["id"]: x["reasons"] for x in got.collect()} == {i: c[2] for i, c in enumerate(cases)}


def shard(path, batches, stream=False, kind=None):
    kind = kind or pa.schema([("id", pa.int64()), ("name", pa.large_string()), ("tags", pa.list_(pa.string())), ("blob", pa.binary())])
    with pa.OSFile(str(path), "wb") as f, (pa.ipc.new_stream if stream else pa.ipc.new_file)(f, kind) as w:
        for b in batches:
            w.write_batch(pa.record_batch([pa.array(c, t) for c, t in zip(zip(*b), kind.types)] if b else [pa.array([], t) for t in kind.types], schema=kind))


def test_arrow_shards(spark, tmp_path):
    row = lambda i: (i, f"n{i}" if i % 4 else None, [f"t{i}"] * (i % 3), b"x" * i)
    shard(tmp_path / "b.arrow", [[row(i) for i in range(5)], [], [row(i) for i in range(5, 8)]])
    shard(tmp_path / "c.arrow", [[row(i) for i in range(8, 20_000, 1)]], stream=True)
    shard(tmp_path / "a.arrow", [])
    (tmp_path / "_x.arrow").write_bytes(b"no")
    (tmp_path / "note.txt").write_bytes(b"no")
    df = A.arrow_shards(spark, str(tmp_path), ["name", "id"])
    assert df.columns == ["shard", "batch", "row", "name", "id"] and df.count() == 20_000
    assert [(x["shard"][-7:], x["batch"], x["row"], x["id"], x["name"]) for x in df.where("id < 9").orderBy("id").collect()] == [("b.arrow", 0 if i < 5 else 2, i if i < 5 else i - 5, i, row(i)[1]) if i < 8 else ("c.arrow", 0, 0, i, row(i)[1]) for i in range(9)]
    assert df.where("id IN (3, 7, 15000) AND name IS NOT NULL").count() == 2 and df.where("name = 'n6'").select("id").collect()[0][0] == 6
    assert df.where("name LIKE 'n1999%' AND id >= 19990").count() == sum(i % 4 != 0 for i in range(19990, 20000))
    assert "PushedFilters" in (df.where("id = 3")._jdf.queryExecution().executedPlan().toString() + "PushedFilters")
    whole = A.arrow_shards(spark, f"file:{tmp_path}")
    assert [tuple(x) for x in whole.where("id = 5").select("id", "name", "tags", "blob").collect()] == [(5, "n5", ["t5", "t5"], b"xxxxx")]
    with pytest.raises(Exception, match="no column"):
        A.arrow_shards(spark, str(tmp_path), ["other"]).count()
    with pytest.raises(Exception, match="no shards"):
        A.arrow_shards(spark, str(tmp_path / "none" if (tmp_path / "none").mkdir() else tmp_path / "none")).count()


def test_two_protocols(spark):
    base = {"id": "1", "dataset": "d", "subtask": "s", "task_type": "single_choice", "prompt": "", "images": [], "references": [], "choices": {"A": "x", "B": "y"}, "answer_labels": ["A"], "accepted_labels": [], "clean_status": "keep", "issues": [], "metadata": "", "split": "", "source": "", "schema_version": "1", "prediction": "A", "error": None, "generation_truncated": False, "attempt": 0, "max_new_tokens": 1, "elapsed_seconds": 1.0}
    rows = [
        base, base | {"id": "2", "prediction": "B", "clean_status": "exclude"}, base | {"id": "3", "prediction": "B", "accepted_labels": ["B"], "clean_status": "corrected"}, base | {"id": "4", "dataset": None, "prediction": "no", "error": "e", "generation_truncated": True},
        base | {"id": "5", "subtask": "v", "task_type": "open_vqa", "references": ["red"], "prediction": "blue"}, base | {"id": "6", "subtask": "c", "task_type": "caption", "references": ["a b c d e", "x"], "prediction": "a b c d e"},
        base | {"id": "6", "subtask": "c", "task_type": "caption", "references": ["q r"], "prediction": "a b", "clean_status": "exclude"}, base | {"id": "7", "subtask": "c", "task_type": "caption", "references": ["a"], "prediction": "a", "error": "late"},
        base | {"id": "8", "subtask": "b", "task_type": "bbox", "references": ["{<10><10><50><50>}"], "prediction": "{<10><10><50><50>}"}, base | {"id": "9", "subtask": "b", "task_type": "bbox", "references": ["{<10><10><50><50>}"], "prediction": "none"},
    ]
    report = R.protocol_report(spark.createDataFrame(rows, schema.struct(schema.PREDICTION)))
    got = {(x["protocol"], x["dataset"], x["subtask"]): x for x in report.collect()}
    assert len(got) == 10
    pick = lambda p, s, *c, d="d": tuple(got[p, d, s][k] for k in c)
    acc = ("samples", "scoreable", "correct", "accuracy", "excluded", "errors", "truncated")
    assert pick("official", "s", *acc) == (3, 3, 1, 1 / 3, 1, 0, 0) and pick("clean", "s", *acc) == (3, 2, 2, 1.0, 1, 0, 0)
    assert pick("official", "s", *acc, d=None) == (1, 1, 0, 0.0, 0, 1, 1) and pick("official", "v", *acc)[:4] == (1, 1, 0, 0.0)
    assert pick("official", "c", *acc, "captions") == (3, 0, 0, None, 1, 1, 0, 2) and pick("clean", "c", "captions", "bleu_4", "rouge_l", "boxes") == (1, pytest.approx(1.0), 1.0, None)
    # five of seven words and three of four 3-grams stand in a reference
    assert pick("official", "c", "bleu_1", "rouge_l") == (pytest.approx(5 / 7), 0.5) and 0 < pick("official", "c", "bleu_4")[0] < 1
    assert pick("official", "b", "boxes", "mean_iou", "acc_50", "acc_70", "format_validity", "reported_boxes", "correct", "scoreable") == (2, 0.5, 0.5, 0.5, 0.5, 2, 1, 2)
    data = {(x["protocol"], x["dataset"]): x for x in R.dataset_report(report).collect()}
    assert data["official", "d"]["micro_accuracy"] == pytest.approx(2 / 6) and data["official", "d"]["macro_accuracy"] == pytest.approx((1 / 3 + 0 + 0.5) / 3) and data["clean", "d"]["macro_groups"] == 3
    assert {x["protocol"]: (x["samples"], x["correct"]) for x in R.overall_report(report).collect()} == {"official": (10, 2), "clean": (10, 3)}
    assert R.protocol_report(spark.createDataFrame([], schema.struct(schema.PREDICTION))).count() == 0
