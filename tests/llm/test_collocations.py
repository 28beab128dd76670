"""Collocations against a plain loop."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from rowforge.llm import collocations as M


def plain_loop(rows, max_n, min_count, drop_share, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, max_n + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = collections.defaultdict(list)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    for (lang, p), a in candidates.items():
        inside = any(len(q) > len(p) and 100 * b >= drop_share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in candidates.items() if o == lang)
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, rows in found.items() for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top])}


def texts():
    r = random.Random(11)
    vocabulary = ["new", "York", "city", "of", "the", "é", "変化", "a\x00b", "zzz", "x" * 300]
    rows = [(r.choice(["en", "fr", None, "und", "é"]), "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", ":"]) for _ in range(r.randrange(60)))) for _ in range(120)]
    return [*rows, *[("en", "New York city of the")] * 9, (None, None), ("en", ""), ("en", " \t "), ("en", ".;:"), ("fr", "word"), ("en", "same row same row"), ("en", "same row same row"), ("en", "long " * 20_000)]


@pytest.mark.parametrize("max_n, min_count, share, top", [(5, 3, 100, 2000), (3, 2, 60, 7), (2, 1, 100, 50), (1, 1, 100, 5)])
def test_phrases_are_those_of_a_plain_loop(spark, monkeypatch, max_n, min_count, share, top):
    monkeypatch.setattr(M, "BIN_ROWS", 40)
    rows = texts()
    docs = spark.createDataFrame([(i, lang, s, 1, 2) for i, (lang, s) in enumerate(rows)], "doc_id long, lang string, text string, phrase int, a int")
    got = [tuple(r)[:8] for r in M.collocations(docs, max_n=max_n, min_count=min_count, drop_share=share, top=top).collect()]
    assert len(set(got)) == len(got) and set(got) == plain_loop(rows, max_n, min_count, share, top)


def test_large_products_are_exact(spark):
    values = [(9_007_199_254_740_993, 9_007_199_254_740_995, 9_007_199_254_741_001, 9_007_199_254_740_999), (10**16 + 1, 9 * 10**16 + 7, 10**16 + 1, 10**16 + 3), (100, 10**12 + 1, 333, 777)]
    got = spark.createDataFrame(values, "a long, n long, l long, r long").select(F.expr(M.SCORE)).collect()
    assert [r[0] for r in got] == [1000 * a * n // (left * right) for a, n, left, right in values]


def test_the_table_of_shorter_grams_may_fill_up(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = {tuple(r) for r in M.collocations(docs, min_count=3).collect()}
    monkeypatch.setattr(M, "MOST_BITS", 6)
    monkeypatch.setattr(M, "BATCH_BYTES", 64)
    monkeypatch.setattr(M, "BLOCK_BYTES", 500)
    assert {tuple(r) for r in M.collocations(docs, min_count=3).collect()} == want


def test_no_rows(spark):
    assert M.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
