"""MinHash near duplicates and set links against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from rowforge.llm import common as C
from rowforge.llm import jaccard_join as J
from rowforge.llm import minhash as M
from rowforge.llm import set_links as S

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORDS.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def smallest(n, pairs):
    """The least index that each can reach."""
    low = list(range(n))
    moved = True
    while moved:
        moved = False
        for i, j in pairs:
            m = min(low[i], low[j])
            moved |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    return low


def near_copies(r, words, n, changes):
    for _ in range(n):
        w = list(words)
        for _ in range(r.randrange(changes + 1)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        yield " ".join(w)


def texts():
    r = random.Random(13)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "The", "变化"]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = make(60)
    out = [None, "", " \t\n", "one", "One", "one two", "a b c", "A\nb  c", "a b d"]
    out += [" ".join([*make(20), *passage, *make(20)]) for _ in range(90)]  # a passage that many share, without being near copies
    for n, changes in ((80, 2), (90, 3), (150, 3), (300, 9)):
        out += near_copies(r, make(n), 90, changes)  # groups over LIGHT
    chain = make(200)
    for i in range(25):  # each near the next one, the ends far apart
        chain = [*chain[:i * 6], *[f"c{i}x{k}" for k in range(6)], *chain[i * 6 + 6 :]]
        out.append(" ".join(chain))
    out += [" ".join(make(r.randrange(1, 12))) for _ in range(40)] + [" ".join(make(5000))] * 2
    r.shuffle(out)
    return out


@pytest.mark.parametrize("size, threshold, block", [(3, (85, 100), S.BLOCK_TOKENS), (3, (85, 100), 6_000), (5, (80, 100), 3_000)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, size, threshold, block):
    monkeypatch.setattr(S, "LEAST_TOKENS", 50)
    rows = texts()
    sets = [shingles(s, size) for s in rows]
    num, den = threshold
    linked = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = smallest(len(rows), linked)
    docs = spark.createDataFrame([(i, s, 1, "x") for i, s in enumerate(rows)], "doc_id long, text string, node int, digest string")
    got = {r["doc_id"]: r for r in M.minhash_join(docs, size=size, threshold=threshold, block_tokens=block).collect()}
    assert len(got) == len(rows)
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(rows))] == [(len(sets[i]), want[i], want[i] == i) for i in range(len(rows))]


def test_few_representatives_hide_no_link(spark, monkeypatch):
    """A cluster of many blocks, of which small groups link with members of a large one that don't represent it."""
    monkeypatch.setattr(S, "LEAST_TOKENS", 1)
    r = np.random.default_rng(5)
    core = r.integers(0, 2**63, 40, dtype=np.uint64)
    sets = []
    for _ in range(120):
        sets.append(np.unique(np.concatenate([np.delete(core, r.integers(0, 40)), r.integers(0, 2**63, 1, dtype=np.uint64)])))
    for i in range(0, 60, 7):  # near one of them, farther from the others
        sets.append(np.unique(np.concatenate([np.delete(sets[i], [1, 2, 3]), r.integers(0, 2**63, 3, dtype=np.uint64)])))
    sets += [r.integers(0, 2**63, 40, dtype=np.uint64) for _ in range(20)]
    sets = [np.sort(s) for s in sets]
    t = J.Threshold(85, 100)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    want = smallest(len(sets), pairs)
    for block in (10**6, 400, 90):
        table = C.cut(spark.createDataFrame([(7, i, len(s), s.tobytes()) for i, s in enumerate(sets)], "cluster long, node long, n long, tokens binary"), "test-sets")
        got = {x["node"]: x["comp"] for x in S.connected(table, t, "test", block).collect()}
        assert [got.get(i, i) for i in range(len(sets))] == want


def test_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, a), (5, a), (5, b), (None, a), (None, b + " end"), (None, None), (9, b), (None, "alone here now")]
    got = [tuple(r) for r in M.minhash_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(got, key=key) == sorted([(5, 46, 5, True), (5, 46, 5, True), (5, 46, 5, True), (None, 46, 5, False), (None, 47, 5, False), (None, 0, None, True), (9, 46, 5, False), (None, 1, None, True)], key=key)


def test_signatures_agree_as_often_as_sets_do():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 2**63, 400, dtype=np.uint64))
    other = np.concatenate([base[:300], r.integers(0, 2**63, 100, dtype=np.uint64)])
    same = M.signatures([base, other], 256)
    assert abs((same[0] == same[1]).mean() - 300 / 500) < 0.12
    assert M.least_matches(64, 85, 100) == 37 and M.least_matches(64, 1, 1) == 64


def test_no_rows(spark):
    assert M.minhash_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in M.minhash_join(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1, True)]
