"""op8 where frequency bins tell nothing, as on tables much larger than the bins: common passages connect no sets."""

import random

import numpy as np
import pytest
from test_operators import brute_join, frame

from rowforge.llm import jaccard_join as J


def test_common_passages_make_no_clusters(spark, monkeypatch):
    r = random.Random(31)
    passage = [f"p{i}" for i in range(22)]
    texts = []
    for i in range(120):
        own = [f"d{i}x{k}" for k in range(40)]
        texts.append(" ".join(own[:20] + passage + own[20:]))
        if i % 12 == 0:  # a near copy
            texts.append(" ".join([*own[:20], *passage, *own[20:], "more"]))
    r.shuffle(texts)
    edges = {}
    components = J.components

    def spy(e, name):
        edges[name] = e.where("a <> b").distinct().count()
        return components(e, name)

    monkeypatch.setattr(J, "components", spy)
    monkeypatch.setattr(J, "_frequencies", lambda parts: np.zeros(1 << J.SKETCH_BITS, "<u4"))
    got = J.jaccard_join(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == brute_join(texts, 3, 90, 100)
    assert edges["jaccard-clusters"] == 10


@pytest.mark.parametrize("n", [20, 990, 1005, 3000])
def test_buckets_bound_links(n):
    t, r = J.Threshold(90, 100), np.random.default_rng(n)
    base = r.integers(0, 2**64, 2 * n, dtype=np.uint64)
    sets = [np.unique(base[i : i + n]) for i in range(0, n, max(1, n // 60))] + [np.unique(base[: n + k]) for k in (1, n // 20, n // 9, n // 2)]
    known = [J.buckets(s) for s in sets]
    refused = 0
    for i, a in enumerate(sets):
        size = np.array([len(s) for s in sets])
        ok = J._can_link(t, np.full(len(sets), len(a)), size, [known[i]] * len(sets), known)
        both = np.array([len(np.intersect1d(a, s)) for s in sets])
        links = 100 * both >= 90 * (len(a) + size - both)
        assert ok[links].all()
        refused += int((~ok).sum())
    assert refused > len(sets)
    wide = J.buckets(np.arange(300, dtype=np.uint64) * np.uint64(256))
    assert wide is None and J._can_link(t, np.array([300]), np.array([300]), [wide], [known[0]]).all()


def test_sets_that_link_with_equals_only():
    t = J.Threshold(90, 100)
    assert [n for n in range(12) if t.links_others(n)] == [9, 10, 11]


def test_sets_of_nine_link_with_one_more(spark):
    w = [f"w{i}" for i in range(13)]
    texts = [" ".join(w[:n]) for n in (10, 11, 12, 13)]  # 8, 9, 10, 11 shingles
    got = J.jaccard_join(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == brute_join(texts, 3, 90, 100)
    assert [x["component_id"] for x in got] == [0, 1, 1, 1]
