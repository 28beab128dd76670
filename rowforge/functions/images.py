"""Sizes of images from the heads of their files, and whether they are whole."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = "kind string, width long, height long, whole boolean"


def _png(b: bytes) -> tuple | None:
    if len(b) >= 24 and b[12:16] == b"IHDR":
        return (*struct.unpack(">II", b[16:24]), b.endswith(b"IEND\xaeB`\x82"))


def _gif(b: bytes) -> tuple | None:
    if len(b) >= 10:
        return (*struct.unpack("<HH", b[6:10]), b.endswith(b";"))


def _bmp(b: bytes) -> tuple | None:
    if len(b) >= 26:
        w, h = struct.unpack("<ii", b[18:26])
        return abs(w), abs(h), len(b) >= struct.unpack("<I", b[2:6])[0]


def _jpeg(b: bytes) -> tuple | None:
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        mark = b[at + 1]
        if mark == 0xFF:  # a filling byte
            at += 1
        elif mark == 0x01 or 0xD0 <= mark <= 0xD8:  # marks without a body
            at += 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame
            if at + 9 > len(b):
                return None
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h, b"\xff\xd9" in b[-32:]
        else:
            at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    return None


def _webp(b: bytes) -> tuple | None:
    if b[8:12] != b"WEBP":
        return None
    whole = len(b) >= struct.unpack("<I", b[4:8])[0] + 8
    if b[12:16] == b"VP8X" and len(b) >= 30:
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1, whole
    if b[12:16] == b"VP8L" and len(b) >= 25 and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, whole
    if b[12:16] == b"VP8 " and len(b) >= 30 and b[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack("<HH", b[26:30])
        return w & 0x3FFF, h & 0x3FFF, whole
    return None


def _tiff(b: bytes) -> tuple | None:
    end = "<" if b[:2] == b"II" else ">"
    at = struct.unpack(end + "I", b[4:8])[0]
    if at + 2 > len(b):
        return None
    n = struct.unpack(end + "H", b[at : at + 2])[0]
    size = {}
    for k in range(at + 2, min(at + 2 + 12 * n, len(b) - 11), 12):
        tag, kind = struct.unpack(end + "HH", b[k : k + 4])
        if tag in (256, 257):
            size[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), b[k + 8 : k + (10 if kind == 3 else 12)])[0]
    return (size[256], size[257], at + 2 + 12 * n <= len(b)) if len(size) == 2 else None


#: First bytes, name and reader of each kind.
KINDS = [(b"\x89PNG\r\n\x1a\n", "png", _png), (b"GIF87a", "gif", _gif), (b"GIF89a", "gif", _gif), (b"\xff\xd8\xff", "jpeg", _jpeg), (b"RIFF", "webp", _webp), (b"BM", "bmp", _bmp), (b"II*\x00", "tiff", _tiff), (b"MM\x00*", "tiff", _tiff)]


def read_header(b: bytes | None) -> tuple:
    """(kind, width, height, whole); nulls where the bytes aren't an image's."""
    for start, kind, read in KINDS:
        if b is not None and b.startswith(start):
            try:
                found = read(bytes(b))
            except struct.error:
                found = None
            return (kind, *found) if found else (kind, None, None, False)
    return None, None, None, False


def image_header(content: Column | str) -> Column:
    """A file's kind, width and height in pixels, and whether its end is there, without decoding it.

    Defined cases: null, empty and other contents have null kind and size and aren't whole; a head that ends before its size has a kind only.
    """

    @F.pandas_udf(HEADER)
    def headers(values: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([read_header(v) for v in values], columns=["kind", "width", "height", "whole"], index=values.index)
        return found.astype({"width": "Int64", "height": "Int64"})

    return headers(F.col(content) if isinstance(content, str) else content)


def with_pixels(df: DataFrame, files: DataFrame, image: str) -> DataFrame:
    """df with the kind, width, height and wholeness of each image's file, and whether there is one.

    files: name, content. Equal names are one image only if they have one size; a name with several is ambiguous: it exists and has no size.
    """
    heads = files.select(F.col("name").alias(image), image_header("content").alias("h"))
    one = heads.groupBy(image).agg(F.collect_set(F.struct("h.kind", "h.width", "h.height", "h.whole")).alias("hs"))
    own = one.select(image, F.when(F.size("hs") == 1, F.col("hs")[0]).alias("h"), F.lit(True).alias("found"))
    out = df.join(own, image, "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"h.{c}").alias(c if c not in df.columns else f"file_{c}") for c in ("kind", "width", "height", "whole")], F.coalesce("found", F.lit(False)).alias("exists"))


def size_reasons(df: DataFrame, files: DataFrame, image: str, declared: str) -> DataFrame:
    """df with `reasons` why its image and declared size can't be used, empty for a good one (F2).

    declared: JSON text of an object with width and height. Reasons: no_image (null or blank name), width, height (missing, not an integer, such as
    true, "32" or 3.5, or not over 0), missing (no file), unreadable (no size in its head), cut (its end isn't there), size (not the declared one).
    """
    raw = lambda k: F.regexp_extract(F.coalesce(F.col(declared), F.lit("")), rf'"{k}"\s*:\s*("(?:[^"\\]|\\.)*"|[^,}}\s]+)', 1)
    number = lambda k: F.when(raw(k).rlike(r"^-?[0-9]+$"), raw(k).try_cast("long"))
    bad = lambda k: number(k).isNull() | (number(k) <= 0)
    slim = with_pixels(df.select(*df.columns), files, image)
    name = lambda c: F.col(c if c not in df.columns else f"file_{c}")
    none = F.col(image).isNull() | (F.trim(F.col(image).cast("string")) == "")
    unreadable = name("width").isNull() | name("height").isNull()
    reasons = F.array(
        F.when(none, "no_image"), F.when(bad("width"), "width"), F.when(bad("height"), "height"), F.when(~none & ~F.col("exists"), "missing"), F.when(F.col("exists") & unreadable, "unreadable"),
        F.when(F.col("exists") & ~unreadable & ~name("whole"), "cut"),
        F.when(F.col("exists") & ~unreadable & ~bad("width") & ~bad("height") & ((number("width") != name("width")) | (number("height") != name("height"))), "size"),
    )
    return slim.withColumn("reasons", F.array_compact(reasons)).select(*df.columns, "reasons")
