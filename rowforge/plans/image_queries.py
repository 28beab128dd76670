"""Queries of image heads: files are written from rows as bytes, whose sizes SQL knows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.functions import images as I  # noqa: E741

from .registry import query

_KIND = "['png', 'gif', 'jpeg', 'webp', 'bmp'][p_partkey % 5 + 1]"
_FILES_SQL = f"f AS (SELECT p_partkey, p_size * 13 + 1 AS width, p_partkey % 700 + 1 AS height, {_KIND} AS kind, p_partkey % 7 <> 0 AS whole FROM part)"


def _files(t):
    """name (the part's key) and content: heads of five kinds, every seventh without its end."""
    p = t("part").select("p_partkey", (F.col("p_size") * 13 + 1).cast("long").alias("w"), (F.col("p_partkey") % 700 + 1).alias("h"), (F.col("p_partkey") % 7 != 0).alias("whole"))
    big = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    byte = lambda x, i: F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(255)), 2, "0")
    small = lambda x, n: F.concat(*[byte(x, i) for i in range(n)])
    end = lambda mark: F.when(F.col("whole"), F.lit(mark)).otherwise("")
    w, h = F.col("w"), F.col("h")
    kinds = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("0802000000"), F.lit("00000000"), end("0000000049454E44AE426082")),
        F.concat(F.lit("474946383961"), small(w, 2), small(h, 2), F.lit("000000"), end("3B")),
        # a segment of unknown data before the frame
        F.concat(F.lit("FFD8FFE00006FFC01122FFFFC0001108"), big(h, 2), big(w, 2), F.lit("03"), end("FFD9")),
        F.concat(F.lit("52494646"), F.when(F.col("whole"), "16000000").otherwise("17000000"), F.lit("57454250565038580A00000000000000"), small(w - 1, 3), small(h - 1, 3)),
        F.concat(F.lit("424D"), F.when(F.col("whole"), "1A000000").otherwise("FF000000"), F.lit("000000001A00000028000000"), small(w, 4), small(h, 4)),
    ]
    content = F.element_at(F.array(*kinds), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("name"), F.unhex(content).alias("content"))


@query("f22_image_headers", f"WITH {_FILES_SQL} SELECT p_partkey, kind, width, height, whole FROM f")
def _(t):
    return _files(t).select(F.col("name").alias("p_partkey"), I.image_header("content").alias("x")).select("p_partkey", "x.*")


@query("p24_pixels", f"WITH {_FILES_SQL} SELECT l_orderkey, l_linenumber, l_partkey AS image, kind, width, height, whole, p_partkey IS NOT NULL AS exists FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) LEFT JOIN f ON p_partkey = l_partkey AND p_partkey % 9 <> 0")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("image")).distinct()
    return I.with_pixels(rows, _files(t).where("name % 9 <> 0"), "image")


@query(
    "f2_size_reasons",
    f"""WITH {_FILES_SQL}, r AS (SELECT *, p_partkey % 9 <> 0 AS there, p_partkey % 6 AS k, p_partkey % 10 = 0 AS nameless FROM f)
       SELECT p_partkey, list_filter([CASE WHEN nameless THEN 'no_image' END, CASE WHEN k IN (1, 2) THEN 'width' END, CASE WHEN k IN (1, 3) THEN 'height' END, CASE WHEN NOT nameless AND NOT there THEN 'missing' END,
         CASE WHEN NOT nameless AND there AND NOT whole THEN 'cut' END, CASE WHEN NOT nameless AND there AND k = 4 THEN 'size' END], lambda x: x IS NOT NULL) AS reasons FROM r""",
)
def _(t):
    p, k = t("part"), F.col("p_partkey") % 6
    w, h = (F.col("p_size") * 13 + 1).cast("string"), (F.col("p_partkey") % 700 + 1).cast("string")
    said = (
        F.when(k == 1, F.lit('{"width": true, "height": "32"}')).when(k == 2, F.concat(F.lit('{"width": 0, "height": '), h, F.lit("}"))).when(k == 3, F.concat(F.lit('{"width": '), w, F.lit(', "height": 3.5}')))
        .when(k == 4, F.concat(F.lit('{"width": '), w, F.lit('9, "height":'), h, F.lit("}"))).otherwise(F.concat(F.lit('{"height": '), h, F.lit(',"width": '), w, F.lit("}")))
    )
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey")).alias("image"), said.alias("declared"))
    return I.size_reasons(rows, _files(t).where("name % 9 <> 0"), "image", "declared").select("p_partkey", "reasons")
