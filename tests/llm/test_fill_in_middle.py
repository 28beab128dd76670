"""Fill-in-middle against a plain loop, with chunks small enough that cuts fall on and beside their ends."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rowforge.llm import fill_in_middle as M

UNITS = {"line": re.compile(r"[^\n]*\n|[^\n]+"), "char": re.compile(r"(?s:.)"), "word": re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+")}


def plain_loop(doc_id, text, unit="line", rate=100, spm=50):
    text = text or ""
    units = UNITS[unit].findall(text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in M.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = random.Random(12)
    made = ["".join(r.choice("aé\n\n 変x\U0001f600\r") for _ in range(r.randrange(1, 90))) for _ in range(150)]
    return [None, "", "\n", "\n\n\n", "no line end", "a\nb", "a\nb\n", "one <P> mark\nx", "<S>", "< P>\n<M\n>", "é" * 50 + "\n" + "変" * 50, "x" * 64 + "\n" + "y" * 64, "ab\n" * 400, "same\nrow\n", "same\nrow\n", *made]


@pytest.mark.parametrize("unit, chunk", [("line", 1), ("line", 7), ("line", 64), ("line", M.CHUNK_BYTES), ("char", 5), ("word", 6), ("word", M.CHUNK_BYTES)])
def test_cuts_are_those_of_a_plain_loop(spark, unit, chunk):
    rows = [(i, s) for i, s in enumerate(texts())] + [(None, "null id\nx\ny\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in M.fill_in_middle(docs, unit=unit, chunk_bytes=chunk).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()}
    assert len(got) == len(rows)
    for i, s in rows:
        r = got[i]
        if unit != "word" or s is None or not re.match(r"[\x20\x09-\x0D]", s):  # the pattern joins blanks at a text's start to its first word
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_loop(i, s, unit)
        assert r["back"] == (s or "")


def test_rate_marks_and_names(spark):
    docs = spark.createDataFrame([(i, "p\nq\nr\n", 1, "x", "y") for i in range(200)], "doc_id long, text string, n int, row string, data string")
    got = M.fill_in_middle(docs, rate=30, spm=0, marks=("[pre]", "[suf]", "[mid]"), keep=["doc_id", "row", "data", "n"])
    assert got.columns == ["doc_id", "row", "data", *M.FIELDS]
    forms = {r["form"]: r["count"] for r in got.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 30 < forms["psm"] < 90
    back = M.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))
    assert got.where(back != "p\nq\nr\n").count() == 0 and got.where("form = 'psm' AND output LIKE '[pre]%'").count() == forms["psm"]


def test_no_rows(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
