"""The ten operators against brute force on small rows, with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowforge.llm import common as C
from rowforge.llm import decontamination, jaccard_join, language_id, license_scan, mixing, pii, pivot_search, sharding, suffix_dedup, toxicity

DDL = "doc_id long, text string, lang string, source string"


def frame(spark, texts, ddl=DDL):
    rows = [(i, s, ["en", "fr", None][i % 3], ["a", "b", None, "c"][i % 4]) for i, s in enumerate(texts)]
    return spark.createDataFrame(rows, ddl)


def lower_ascii(s):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (s or "").encode())


SPACE_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
NAME_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- shared helpers ----------------------------------------------------------------------------


def test_words_are_those_of_the_patterns():
    r = random.Random(1)
    texts = ["".join(r.choice("aB \t\n.é変0_-\x00") for _ in range(r.randrange(60))) for _ in range(200)] + ["", "x" * (C.STEP_BYTES + 5) + " y", " "]
    data = [s.encode() for s in texts]
    x = C.Texts(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]), 0, len(data))
    for kind, pattern in (("space", SPACE_WORDS), ("nonword", NAME_WORDS)):
        w = C.words(x, C.byte_table(kind, lower=True))
        seen = {}
        for i, s in enumerate(texts):
            want = pattern.findall(lower_ascii(s))
            lo, hi = w.off[i], w.off[i + 1]
            assert [lower_ascii(data[i][a - x.off[i] : b - x.off[i]].decode("utf-8", "ignore")) for a, b in zip(w.start[lo:hi], w.end[lo:hi])] == want
            for word, h in zip(want, w.hash[lo:hi]):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_sliding_minimum():
    a = np.random.default_rng(0).integers(0, 50, 100).astype(np.uint64)
    for w in (1, 2, 3, 7, 64):
        assert C.sliding_min(a, w).tolist() == [a[i : i + w].min() for i in range(len(a) - w + 1)]


# --- 1 -----------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    data = [(s or "").encode() for s in texts]
    n = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        c = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                c[i : i + length] = b"\1" * length
        kept = bytes(v for v, g in zip(b, c) if not g)
        out.append((len(b), sum(c), sum(1 for i in range(len(c)) if c[i] and (not i or not c[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 7, 2])
def test_op1_removes_what_repeats(spark, hot):
    r = random.Random(3)
    p = "".join(r.choice("abc é\n") for _ in range(300))
    texts = [None, "", "a" * 300, p[:59], p[:60] + "x", "y" + p[:60], p[30:180] + "z" * 50, "é" * 80, "q" + p + "w" + p, p, p] + [p[50:140] + f"{i}" * 40 for i in range(12)] + [f"{i}" * 30 + p[100:170] + chr(97 + i) * 30 for i in range(9)]
    got = suffix_dedup.remove_repeats(frame(spark, texts), length=60, gram=12, hot_contexts=hot).orderBy("doc_id").collect()
    assert [(x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got] == brute_repeats(texts, 60)
    for x, s in zip(got, texts):
        b = (s or "").encode()
        assert bytes(x["kept"]) == b"".join(b[i : i + 1] for i in range(len(b)) if not any(q["lo"] <= i < q["hi"] for q in x["removed_spans"]))


def test_op1_of_nothing(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    assert [x["n_removed"] for x in suffix_dedup.remove_repeats(frame(spark, ["a", None])).collect()] == [0, 0]


# --- 2 -----------------------------------------------------------------------------------------


def test_op2_is_exact(spark):
    r = np.random.default_rng(2)
    vecs = [r.normal(size=8).tolist() for _ in range(120)] + [[0.5] * 8] * 12 + [None, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [1.0, 2.0]]
    rows = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    use = rows.where(pivot_search.usable(F.col("embedding"))).select("vec_id", pivot_search.scaled(F.col("embedding")).alias("v"))
    good = {i: np.floor(64 * np.array(v + [0.0] * (8 - len(v)))) for i, v in enumerate(vecs) if v is not None and None not in v and np.isfinite(v).all()}
    index, table = pivot_search.build(use, pivots=5)
    for block in (8192, 3):
        got = collections.defaultdict(list)
        for x in pivot_search.top_k(index, table, use.where("vec_id % 10 = 0"), k=7, block=block, annulus=9).orderBy("query_id", "rank").collect():
            got[x["query_id"]].append((x["vec_id"], x["score"]))
        for q in (i for i in good if i % 10 == 0):
            assert got[q] == sorted(((i, int(good[q] @ v)) for i, v in good.items() if i != q), key=lambda t: (-t[1], t[0]))[:7]


def test_op2_blocks_read_what_they_need(spark):
    r = np.random.default_rng(5)
    vecs = np.floor(np.concatenate([r.normal(size=(60, 6)) + 400 * np.eye(6)[c] for c in range(6)]) * 8)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, v array<double>")
    index, table = pivot_search.build(rows, pivots=6)
    queries = rows.where("vec_id % 10 = 0")
    got = collections.defaultdict(list)
    for x in pivot_search.top_k(index, table, queries, k=5, block=4, annulus=8, together=3).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    for i in range(0, 360, 10):
        assert got[i] == sorted(((j, int(vecs[i] @ v)) for j, v in enumerate(vecs) if j != i), key=lambda t: (-t[1], t[0]))[:5]
    q = vecs[:4]
    fifth = np.array([sorted(vecs @ x)[-6] for x in q])
    kept = table.where(pivot_search._within(index, q, fifth))
    assert 20 <= kept.count() <= 120  # one cluster of six, or little more
    scan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in scan or "PushedFilters: [And(" in scan, scan


def test_op2_of_nothing_and_of_few(spark):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    index, table = pivot_search.build(none)
    assert pivot_search.top_k(index, table, none).count() == 0
    two = spark.createDataFrame([(0, [2.0]), (1, [3.0])], "vec_id long, v array<double>")
    index, table = pivot_search.build(two)
    assert [tuple(x) for x in pivot_search.top_k(index, table, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 6)]


def test_op2_scores_beyond_doubles():
    q, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0]])
    assert int(pivot_search._scores(q, x)[0][0]) == 2**60 + 1


# --- 3 -----------------------------------------------------------------------------------------


def test_op3_gradients():
    p = toxicity._start(np.random.default_rng(0))
    p = {k: v.astype(np.float64) for k, v in p.items()}
    r = np.random.default_rng(1)
    v = r.normal(size=(6, toxicity.DIM)) * 0.5
    v[-1] = 0
    ids = r.integers(0, 5, (3, toxicity.WINDOW))
    ids[1, 20:] = -1
    y = np.array([1.0, 0, 1])

    def loss(q, u):
        z = toxicity._forward(q, u, ids)
        return float((np.logaddexp(0, z) - y * z).sum())

    tapes = {}
    z = toxicity._forward(p, v, ids, tapes)
    g, dv = toxicity._backward(p, v, ids, tapes, toxicity._sigmoid(z) - y)
    for name in ("Uf", "Wb", "bf", "A", "v", "o", "c"):
        flat = p[name].ravel()
        for i in r.integers(0, flat.size, 3):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss(p, v)
            flat[i] = old - 1e-4
            down = loss(p, v)
            flat[i] = old
            assert g[name].ravel()[i] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-4), name
    u = v.copy()
    u[2, 3] += 1e-4
    assert dv[2, 3] == pytest.approx((loss(p, u) - loss(p, v)) / 1e-4, rel=2e-2, abs=2e-3)


def test_op3_learns_and_scores_all(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 4)))

    def text(bad):
        w = [word() for _ in range(r.randrange(20, 160))]
        if bad:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["zugma", "zugre", "vixo", "vixanu", "qopt"])
        return " ".join(w)

    texts, labels = zip(*[(text(i % 2), i % 2) for i in range(600)])
    model = toxicity.fit([s.encode() for s in texts], np.array(labels))
    new = [text(i % 2) for i in range(60)] + [None, "", "..."]
    got = toxicity.score(frame(spark, new), model, keep=["doc_id"]).orderBy("doc_id").collect()
    hits = sum((x["score"] >= 0.5) == bool(i % 2) for i, x in enumerate(got[:60]))
    assert hits >= 44 and all(0 <= x["score"] <= 1 for x in got)
    assert len({x["score"] for x in got[60:]}) == 1 and got[60]["n_windows"] == 1
    assert toxicity.score(frame(spark, []), model).count() == 0
    long = toxicity.score(frame(spark, [" ".join(["ba"] * 1000)]), model).first()
    assert long["n_windows"] == 1 + -(-(1000 - 32) // 16)


def op3_by_hand(p, text):
    """The score by loops over windows, places, gates and words, from the parameters alone."""
    h, sig = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    low = bytes(toxicity.TABLE[np.frombuffer(text.encode(), np.uint8)])
    spans = [m.span() for m in re.finditer(rb"[^\0]+", low)]
    assert all(b - a <= toxicity.PIECE for a, b in spans)

    def vector(a, b):
        x = np.zeros(toxicity.DIM)
        w = C.words(C.Texts(np.frombuffer(text.encode()[a:b], np.uint8), np.array([0, b - a]), 0, 1), toxicity.TABLE)
        x[: toxicity.WORD_DIM] = p["word"][int(w.hash[0] >> np.uint64(40)) % toxicity.WORD_BINS]
        c, tri, m32 = low[a:b], [], 0xFFFFFFFF
        for i in range(len(c)):
            left, right = c[i - 1] if i else 1, c[i + 1] if i + 1 < len(c) else 2
            v = ((((left * 0x01000193 & m32) ^ c[i]) * 0x85EBCA6B & m32) ^ (right * 0xC2B2AE35 & m32)) * 0x9E3779B1 & m32
            tri.append(p["char"][(v >> 16) % toxicity.CHAR_BINS])
        x[toxicity.WORD_DIM : toxicity.WORD_DIM + toxicity.CHAR_DIM] = np.mean(tri, 0)
        v, heads = 0, []
        for j in range(min(len(c), max(toxicity.HEADS))):
            v = ((v ^ c[j]) * 0x01000193 + j + 1) & m32
            if j + 1 in toxicity.HEADS:
                heads.append(p["head"][((v * 0x9E3779B1 & m32) >> 16) % toxicity.HEAD_BINS])
        if heads:
            x[toxicity.WORD_DIM + toxicity.CHAR_DIM :] = np.mean(heads, 0)
        return x

    def gru(xs, a):
        s, out = np.zeros(h), []
        for x in xs:
            g, u = x @ p[f"W{a}"] + p[f"b{a}"], s @ p[f"U{a}"]
            z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
            s = (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :]) + z * s
            out.append(s)
        return out

    best = -np.inf
    for k in range(1 + max(0, -(-(len(spans) - toxicity.WINDOW) // toxicity.STRIDE))):
        xs = [vector(*v) for v in spans[k * toxicity.STRIDE :][: toxicity.WINDOW]]
        states = [np.concatenate(v) for v in zip(gru(xs, "f"), gru(xs[::-1], "b")[::-1])]
        e = np.exp([np.tanh(v @ p["A"]) @ p["v"] for v in states])
        best = max(best, float(sum(a * v for a, v in zip(e / e.sum(), states)) @ p["o"] + p["c"][0]))
    return sig(p["scale"] * best + p["shift"])


def test_op3_scores_are_those_of_plain_loops(spark):
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdefghijé") for _ in range(r.randrange(1, 12)))
    texts = [" ".join(word() for _ in range(r.choice([1, 5, 31, 32, 33, 48, 49, 90]))) + r.choice(["", "!", " ,"]) for _ in range(24)]
    model = toxicity.fit([s.encode() for s in texts], np.array([i % 2 for i in range(24)]))
    got = toxicity.score(frame(spark, texts), model).orderBy("doc_id").collect()
    assert [x["score"] for x in got] == pytest.approx([op3_by_hand(model, s) for s in texts], abs=2e-4)


def test_op3_samples_of_long_texts_and_repeated_ids(spark):
    long = " ".join(f"word{i}" for i in range(30000))
    part = toxicity.sampled(long, 1000, "7")
    assert len(part.encode()) <= 1000 and set(part.split()) <= set(long.split()) and part == toxicity.sampled(long, 1000, "7") != toxicity.sampled(long, 1000, "8")
    assert max(int(w[4:]) for w in part.split()) > 15000
    cjk = toxicity.sampled("漢字" * 30000, 1000, "7")
    assert 500 < len(cjk.encode()) <= 1000
    docs = spark.createDataFrame([(i % 20, f"text {'vixo' if i % 2 else 'ba'} of {i}") for i in range(200)] + [(20, long), (21, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(22)] + [(0, 0), (99, 1)], "doc_id long, toxic int")
    scores = [[x["score"] for x in toxicity.score(docs, toxicity.train(d, labels)).orderBy("doc_id", "text").collect()] for d in (docs, docs.repartition(5).orderBy(F.rand(3)))]
    assert scores[0] == scores[1]


def test_op3_without_labels(spark):
    docs, none = frame(spark, ["a b", None]), spark.createDataFrame([], "doc_id long, toxic int")
    assert {x["score"] for x in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert {x["score"] for x in toxicity.score(docs, toxicity.train(docs, one)).collect()} == {0.75}


# --- 4 -----------------------------------------------------------------------------------------


def shards(spark, df, n=8):
    d = sharding.described(df).select("doc_id", "size", "__h", "__crc", "__salt", *sharding.DIMENSIONS)
    return C.cut(sharding.kd_shards(C.cut(d, "t"), n), "t")


def test_op4_balances_and_keeps_groups(spark):
    r = random.Random(4)
    texts = [r.choice("abcdefgh") * r.randrange(1, 400) for _ in range(600)] + ["same text"] * 20 + [None, ""]
    got = shards(spark, frame(spark, texts), 5).collect()
    assert len(got) == len(texts) and {x["shard"] for x in got} == set(range(5))
    size = collections.Counter()
    of = collections.defaultdict(set)
    for x in got:
        assert x["size"] == len((texts[x["doc_id"]] or "").encode()) + 1
        size[x["shard"]] += x["size"]
        of[texts[x["doc_id"]] or ""].add(x["shard"])
    assert max(size.values()) - min(size.values()) <= 3 * 400
    assert all(len(v) == 1 for v in of.values())


def test_op4_is_the_tree_of_a_plain_recursion(spark):
    """The same splits by sorting each node's rows, with coordinates worked out anew."""
    r = random.Random(14)
    rows = [(i, r.choice("abcdefgh") * r.randrange(1, 300) + str(i), r.choice(["de", "en", None]), r.choice([f"https://site{k:02}.org/crawl-2024" for k in range(12)] + [None])) for i in range(500)]
    d = sharding.described(spark.createDataFrame(rows, DDL)).select("doc_id", "size", "__h", "__crc", "__salt", *sharding.DIMENSIONS)
    got = {x["doc_id"]: x["shard"] for x in sharding.kd_shards(C.cut(d, "t"), 6).collect()}
    low = {x["doc_id"]: x["__h"] % (1 << 64) >> 44 for x in d.collect()}
    rank = [{v: k + 1 for k, v in enumerate(sorted({x[c] for x in rows if x[c] is not None}))} for c in (3, 2)]
    units = [(i, len(t.encode()) + 1, [np.log2(len(t.encode()) + 1), rank[0].get(s, 0), rank[1].get(lang, 0)]) for i, t, lang, s in rows]
    lo, hi = np.min([u[2] for u in units], 0), np.max([u[2] for u in units], 0)
    at = {i: [(int((x - a) / (b - a) * ((1 << 24) - 1)), low[i]) for x, a, b in zip(c, lo, hi)] for i, _, c in units}
    size = {i: n for i, n, _ in units}
    want = {}

    def split(ids, first, n):
        if n == 1:
            want.update(dict.fromkeys(ids, first))
            return
        wide = max(range(3), key=lambda k: max(at[i][k][0] for i in ids) - min(at[i][k][0] for i in ids))
        ids, rest, run = sorted(ids, key=lambda i: at[i][wide]), sum(size[i] for i in ids) * (n // 2) // n, 0
        for k, i in enumerate(ids):
            if run + size[i] > rest:
                break
            run += size[i]
        k += run + size[ids[k]] - rest < rest - run
        split(ids[:k], first, n // 2)
        split(ids[k:], first + n // 2, n - n // 2)

    split(list(size), 0, 6)
    assert got == want


def test_op4_target_bytes_and_long_names(spark):
    rows = [(i, "x" * 99 + str(i), "en", f"https://{'abz'[i % 3]}.example.org/a-very-long-source-name") for i in range(90)]
    d = sharding.described(spark.createDataFrame(rows, DDL)).select("doc_id", "size", "__h", "__crc", "__salt", *sharding.DIMENSIONS)
    assert {x["x_source"] for x in d.collect()} == {1.0, 2.0, 3.0}
    d = C.cut(d, "t")
    placed = sharding.place(d, sharding.plan(d, target_bytes=2600)).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(placed) == 4 and max(x["s"] for x in placed) <= 2600


def test_op4_deals_out_a_group_that_is_too_large(spark):
    got = shards(spark, frame(spark, ["x" * 50] * 4000 + [f"{i}" * 7 for i in range(1000)]))
    size = [x["s"] for x in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(size) == 8 and max(size) / min(size) < 1.25


def test_op4_slots(spark):
    from rowforge.llm.prefix import numbered

    df = C.cut(frame(spark, ["t"] * 100).withColumn("g", F.col("doc_id") % 3), "t")
    got = numbered(df, "g", F.col("doc_id"), [F.col("doc_id")], "slot", per_bin=7).collect()
    for g in range(3):
        assert sorted(x["slot"] for x in got if x["g"] == g) == list(range(sum(1 for x in got if x["g"] == g)))
    assert shards(spark, frame(spark, [])).count() == 0


# --- 5 -----------------------------------------------------------------------------------------


def test_op5_meets_targets(spark):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)) if i % 17 else None, "en", s) for i, s in enumerate(r.choices(["a", "b", "c", "d", None], [60, 3, 2, 30, 5], k=400))]
    df = spark.createDataFrame(rows, DDL)
    keyed = C.cut(mixing.keyed(df, "doc_id", "source", mixing.word_count(F.col("text"))).select("doc_id", "source", "__source", "__size", "__key", "__k"), "t")
    got = mixing.mix(keyed, mixing.cut_points(keyed), "doc_id").collect()
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    full, want = set(), {}
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] / w > 3 * size[s]}
        if not over:
            break
        full |= over
    want = {s: 3 * size[s] if s in full else rest * weight[s] / w for s in order}
    taken = collections.Counter()
    for x in got:
        taken[x["source"]] += x["taken"]
        assert x["target"] == pytest.approx(want[x["source"]]) and x["source_size"] == size[x["source"]] and x["taken"] <= 3 * x["__size"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in order) and len(full) > 0
    again = mixing.mix(keyed.repartition(3), mixing.cut_points(keyed.repartition(5)), "doc_id").collect()
    assert sorted((x["doc_id"], x["taken"]) for x in got) == sorted((x["doc_id"], x["taken"]) for x in again)


def test_op5_whole_documents_and_nothing(spark):
    df = frame(spark, ["a b c d"] * 30)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and set(out.select("text").distinct().collect()[0]) == {"a b c d"}
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
    names = ["target", "rest", "epochs", "at", "before", "here", "source_size", "taken", "size", "id", "__k", "__size", "__part", "__row"]
    clash = df.withColumns({n: F.lit("x") for n in names})
    got = mixing.mixed_documents(clash)
    assert got.columns == clash.columns and got.count() == out.count()


# --- 6 -----------------------------------------------------------------------------------------


def test_op6_declares_and_inherits(spark):
    apache = next(t for n, t in license_scan.TEMPLATES if n == "Apache-2.0" and len(t) > 300)
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "print(1)"), ("a/b/c/LICENSE.txt", apache), ("a/b/c/d/y.py", "code"), ("a/b/z.py", "# SPDX-License-Identifier: GPL-3.0-or-later\n\nx = 1\n" + "call(x)\n" * 30),
        ("q/none.py", "nothing here"), ("a/b/null.py", None), (None, "Licensed under CC BY-NC 4.0."), ("q/warranty.txt", "The warranty of the toaster lasts two years and covers the parts."), ("a/b/x.py", "print(1)"),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    got = license_scan.inherit(license_scan.declare(df, keep=["path"])).collect()
    by = collections.defaultdict(set)
    for x in got:
        by[x["path"]].add((x["declared"], x["licence"], x["from_dir"]))
    assert len(got) == len(rows)
    assert by["a/LICENSE"] == {("MIT", "MIT", None)} and by["a/b/x.py"] == {(None, "MIT", "a")} and by["a/b/null.py"] == {(None, "MIT", "a")}
    assert by["a/b/c/d/y.py"] == {(None, "Apache-2.0", "a/b/c")} and by["a/b/z.py"] == {("GPL-3.0", "GPL-3.0", None)}
    assert by["q/none.py"] == {(None, None, None)} and by["q/warranty.txt"] == {(None, None, None)} and by[None] == {("CC-BY-NC-4.0", "CC-BY-NC-4.0", None)}
    assert license_scan.inherit(license_scan.declare(df.limit(0))).count() == 0


def brute_inherit(rows, found):
    """Each path's licence: its own, else that of the nearest folder above it that a file speaks for."""
    speaks = {}
    for path, declared, cosine, share in found:
        if path is not None and declared and (re.search(license_scan.LICENCE_FILE, path) or share >= 0.5):
            folder = path.rsplit("/", 1)[0] if "/" in path else ""
            best = (-round(cosine, 9), path, declared)
            speaks[folder] = min(speaks.get(folder, best), best)
    out = []
    for path, declared, *_ in found:
        licence, at = declared, None
        if not declared and path is not None:
            folder = path.rsplit("/", 1)[0] if "/" in path else ""
            while True:
                if folder in speaks:
                    licence, at = speaks[folder][2], folder
                    break
                if not folder:
                    break
                folder = folder.rsplit("/", 1)[0] if "/" in folder else ""
        out.append((path, declared, licence, at))
    return out


def test_op6_nulls_have_folders_of_their_own(spark, tmp_path):
    """Documents with null and odd columns, against a walk up the folders."""
    apache = next(t for n, t in license_scan.TEMPLATES if n == "Apache-2.0" and len(t) > 300)
    mit = "Released under the MIT License."
    rows = [
        (1, apache, "src", None), (2, "code", "src", None), (3, "code", None, "src"), (4, "code", "src", "en"), (5, "code", None, "en"), (None, apache, None, "en"), (None, "code", "src", "en"), (6, "code", "src/en", None),
        (7, "code", "", "en"), (8, "code", "%00", "en"), (9, mit, "src", None), (10, None, None, None), (11, apache, "", ""), (12, "", "", ""), (13, "code", "%", "%"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = license_scan.op6(spark, str(tmp_path)).collect()
    found = [(x["path"], x["declared"], x["cosine"], 1.0 if x["declared"] == "Apache-2.0" else 0.0) for x in got]
    assert collections.Counter((x["path"], x["declared"], x["licence"], x["from_dir"]) for x in got) == collections.Counter(brute_inherit(rows, found))
    by = {x["doc_id"]: (x["licence"], x["from_dir"]) for x in got if x["doc_id"] is not None}
    assert by[2] == ("Apache-2.0", "src/%00") and by[5] == ("Apache-2.0", "%00/en") and by[9] == ("MIT", None) and by[12] == ("Apache-2.0", "%/%")
    assert all(by[i] == (None, None) for i in (3, 4, 6, 7, 8, 10, 13)) and len({x["path"] for x in got}) == len(rows)


def test_op6_cosine_is_that_of_dictionaries():
    m = license_scan.Model(np.zeros(license_scan.BINS), 3)
    bins, _ = license_scan.features(b"Released under the MIT License, or so.")
    k, cos = m.best(bins)
    idf = m.idf
    vec = lambda b: {i: n * idf[i] for i, n in collections.Counter(b.tolist()).items()}
    dot = lambda a, b: sum(x * b.get(i, 0) for i, x in a.items())
    a = vec(bins)
    all_ = [dot(a, t) / (dot(a, a) * dot(t, t)) ** 0.5 for t in (vec(license_scan.features(t.encode())[0]) for _, t in license_scan.TEMPLATES)]
    assert license_scan.TEMPLATES[k][0] == "MIT" and cos == pytest.approx(max(all_))


# --- 7 -----------------------------------------------------------------------------------------

PII_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_base(t):
    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        if k == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if k == "card":
            return 14 <= len(d) <= 19 and sum((lambda x: x - 9 if x > 9 else x)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(d))) % 10 == 0
        return k == "email" or 10 <= len(d) <= 15

    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PII_PATTERNS.items()) for m in re.finditer(p, t or "") if ok(k, m.group()))


def test_op7_base_spans(spark):
    r = random.Random(7)
    soup = ["".join(r.choice(["1", "23", "255", "256", ".", ".", "-", " ", "@", "+", "a", "é", "𝒳", "(", "4111111111111111", "a@b.co"]) for _ in range(60)) for _ in range(150)]
    texts = soup + ["x@y.z a@b-c.d_e@f.g 1.2.3.4.5", "1.2.3.4 " * 700, "a@b.c," * 300, "1" * 3000, "a." * 2000 + "@", "+1" + " " * 2000, None, "", 'call 415-555-2671, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    got = pii.find_pii(frame(spark, texts), keep=["doc_id"]).orderBy("doc_id").collect()
    for x, s in zip(got, texts):
        base = [(b["start"], pii.KINDS.index(b["kind"]), b["end"], b["kind"]) for b in x["base"]]
        assert base == pii_base(s), s[:80]
        assert {tuple(b[:3]) for b in x["base"]} <= {tuple(b[:3]) for b in x["spans"]}
        assert not any(a["start"] < b["end"] and b["start"] < a["end"] for a in x["spans"] if a["kind"] in pii.WIDE for b in x["base"])
    assert any(b["kind"] == "secret" for b in got[-1]["spans"])
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_op7_added_spans_on_planted_data(spark):
    """Recall and precision of what the method adds, on planted secrets, numbers and names among look-alikes."""
    r = random.Random(16)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    d = lambda n: "".join(r.choice("23456789") for _ in range(n))
    good = {
        "secret": lambda: f'{r.choice(["token", "TOKEN", "Api_Key", "password"])} {r.choice("=:")} "{hexa(40)}"',
        "ssn": lambda: f"social security {r.randrange(100, 665)}-{d(2)}-{d(4)}",
        "local_phone": lambda: r.choice(["call ({}) {}-{}", "phone {}-{}-{}", "tel {}.{}.{}"]).format(d(3), d(3), d(4)),
        "written_email": lambda: f"write to {r.choice(pii.NAMES[:60])}.{r.choice(['smith', 'lee'])} [at] mail{d(1)} [dot] {r.choice(['com', 'org', 'de'])}",
        "name": lambda: f"dear {r.choice(['Mr', 'Mrs.', 'Dr.', 'Herr', 'Sra.', 'Mme'])} {r.choice(pii.NAMES).title()} {r.choice(['Smith', 'Weber', 'Gómez', 'Lefèvre-Dupont', 'Müller'])}",
    }
    bad = [lambda: f"version {d(3)}-{d(3)}.{d(4)}", lambda: f"isbn {d(3)}-{d(3)}-{d(4)}", lambda: f"release 000-{d(2)}-{d(4)}", lambda: "token = averylongplainwordindeed", lambda: f"page {d(3)} 1{d(2)}-{d(4)}", lambda: "see table [at] the end"]
    fill = lambda: " ".join(r.choice(["some", "words", "of", "no", "matter"]) for _ in range(r.randrange(3, 9)))
    lead = {"secret": "", "ssn": "social security ", "local_phone": "", "written_email": "write to ", "name": "dear "}
    texts, want, places = [], [], []
    for i in range(600):
        kind = r.choice(list(good)) if i % 2 else None
        before, planted = fill(), (good[kind] if kind else r.choice(bad))()
        texts.append(f"{before} {planted} {fill()}")
        want.append(kind)
        skip = len(lead[kind] if kind != "local_phone" else planted[: re.search("[(0-9]", planted).start()]) if kind else 0
        places.append((len(before) + 1 + skip, len(before) + 1 + len(planted)))
    got = pii.find_pii(frame(spark, texts)).orderBy("doc_id").collect()
    added = [{b["kind"] for b in x["spans"] if b["kind"] in pii.WIDE} for x in got]
    hit = sum(k in a for k, a in zip(want, added) if k)
    wrong = sum(len(a - {k}) for k, a in zip(want, added))
    assert hit >= 0.9 * sum(k is not None for k in want) and hit >= 0.9 * (hit + wrong)
    exact = sum(any(b["kind"] == k and (b["start"], b["end"]) == at for b in x["spans"]) for k, at, x in zip(want, places, got) if k)
    assert exact == hit


def test_op7_added_spans_are_whole(spark):
    """Start and end of names and written-out addresses in four languages, among capitalised words that aren't names."""
    cases = [
        ("we met Dr. José Gómez, who", "name", "Dr. José Gómez"), ("dear Dr. Müller, thank", "name", "Dr. Müller"), ("chère Mme Éloïse Lefèvre-Dupont, bonjour", "name", "Mme Éloïse Lefèvre-Dupont"), ("liebe Frau Jürgen Ößler, hallo", "name", "Frau Jürgen Ößler"),
        ("de Sra. María Ángeles Núñez García, hola", "name", "Sra. María Ángeles Núñez García"), ("by Mr. O'Brien, yes", "name", "Mr. O'Brien"), ("from Dr. " + "A" + "b" * 90 + " Li.", "name", "Dr. " + "A" + "b" * 90 + " Li"),
        ("write to anna.maria [at] mail.example [dot] com, please", "written_email", "anna.maria [at] mail.example [dot] com"), ("write to " + "x" * 80 + "(at)" + "y" * 70 + ".museum now", "written_email", "x" * 80 + "(at)" + "y" * 70 + ".museum"),
    ]
    fill = [f"the Report of Monday number {i} has nothing" for i in range(20)]
    docs = frame(spark, [c[0] for c in cases] + fill)
    for x in pii.candidates(docs, keep=["doc_id"]).orderBy("doc_id").collect():
        spans = [(c["kind"], c["start"], c["end"]) for c in x["wide"]]
        if x["doc_id"] < len(cases):
            text, kind, span = cases[x["doc_id"]]
            assert spans == [(kind, text.index(span), text.index(span) + len(span))]
        else:
            assert not spans
    long = frame(spark, ["a" * 300_000, "Dr " * 50_000, "x.y-" * 60_000 + "[at] z"])
    assert pii.find_pii(long).count() == 3


def test_op7_gazetteers_are_parameters(spark):
    texts = ["a note from Dr. Zorblax Qu"] * 3 + ["x@y.zz"] * 3
    votes = lambda **kw: {tuple(c["votes"]) for x in pii.candidates(frame(spark, texts), **kw).collect() for c in x["wide"] + x["base"]}
    assert votes() == {(0, 0, 1, 0), (1, -1, 0, 0)} and votes(names=["zorblax"], endings=["zz"]) == {(0, 1, 1, 0), (1, 1, 0, 0)}
    with pytest.raises(ValueError, match="at most"):
        pii.candidates(frame(spark, texts), names=["a"] * 20_001)


def test_op7_reliabilities(spark):
    true, rows = [0.9, 0.8, 0.7, 0.6], []
    for v in itertools.product((1, -1), repeat=4):
        p = [np.prod([a if x > 0 else 1 - a for a, x in zip(true, v)]), np.prod([1 - a if x > 0 else a for a, x in zip(true, v)])]
        rows.append((list(v), int(1e6 * (0.5 * p[0] + 0.5 * p[1]))))
    fit = pii.reliabilities(spark.createDataFrame(rows, "votes array<int>, n long")).first()
    assert fit["yes"] == pytest.approx(true, abs=0.03) and fit["prior"] == pytest.approx(0.5, abs=0.05)


# --- 8 -----------------------------------------------------------------------------------------


def brute_join(texts, size, num, den):
    sets = []
    for s in texts:
        w = SPACE_WORDS.findall(lower_ascii(s))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            links[i] += 1
            links[j] += 1
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), find(i), links[i]) for i in range(len(sets))]


@pytest.mark.parametrize(("size", "threshold", "block"), [(3, (90, 100), 1_000_000), (5, (80, 100), 1_000_000), (2, (60, 100), 2000)])
def test_op8_is_exact(spark, size, threshold, block):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 2, 4, 12, 40, 90]))] for _ in range(40)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(r.randrange(3)):
            c = list(b)
            for _ in range(r.randrange(3)):
                c[r.randrange(len(c))] = r.choice(vocab)
            texts.append("\t".join(c).upper())
    texts += [None, "", "  \n", "one", "ONE", "one"]
    got = jaccard_join.jaccard_join(frame(spark, texts), size=size, threshold=threshold, block_tokens=block).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == brute_join(texts, size, *threshold)


def test_op8_frequent_shingles_keep_their_links(spark):
    r = random.Random(9)
    core = [f"c{i}" for i in range(60)]
    texts = []
    for i in range(90):  # more copies than pairs are counted under
        c = list(core)
        c[i % 60] = f"x{i}"
        texts.append(" ".join(c))
    r.shuffle(texts)
    got = jaccard_join.jaccard_join(frame(spark, texts), size=1, threshold=(90, 100)).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == brute_join(texts, 1, 90, 100)


def test_op8_pairs_of_groups():
    light = jaccard_join.LIGHT
    key, node, need = np.zeros(light + 5, np.uint64), np.arange(light + 5), np.full(light + 5, 4, np.int8)
    k, n, q = jaccard_join._thinned(key, node, need)
    assert (q == 0).sum() == 1 and len(np.unique(k)) == light + 5
    order = np.lexsort((n, k))
    a, b, shared, needed = jaccard_join._pairs(k[order], n[order], q[order], None)
    assert set(zip(a.tolist(), b.tolist())) == {(0, i) for i in range(1, light + 5)} and (shared >= needed).all()
    a, b, shared, needed = jaccard_join._pairs(np.array([1, 1, 2, 2, 2]), np.array([5, 6, 5, 6, 7]), np.array([2, 2, 2, 2, 1], np.int8), None)
    assert sorted(zip(a.tolist(), b.tolist(), shared.tolist(), needed.tolist())) == [(5, 6, 2, 2), (5, 7, 1, 1), (6, 7, 1, 1)]


def test_op8_of_nothing(spark):
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0


# --- 9 -----------------------------------------------------------------------------------------


def test_op9_predicts(spark):
    r = random.Random(10)
    syl = {"xx": ["ba", "do", "ki"], "yy": ["lü", "rö", "zä"]}
    make = lambda k: " ".join("".join(r.choice(syl[k]) for _ in range(3)) for _ in range(30))
    train = spark.createDataFrame([(make(k), k) for k in ("xx", "yy", "yy") for _ in range(20)] + [("zzz", None)], "text string, lang string")
    model = language_id.train(train)
    assert model[0] == ["xx", "yy"]
    docs = [make("xx"), make("yy"), None, "", "12 34 !", make("yy").upper()]
    got = language_id.predict(frame(spark, docs).withColumn("score", F.lit("clash")), model).orderBy("doc_id").collect()
    assert [x["lang_pred"] for x in got] == ["xx", "yy", "und", "und", "und", "yy"]
    assert all(0 <= x["score"] <= 1 for x in got) and got[2]["score"] == 0
    none = language_id.train(train.where("false"))
    assert {x["lang_pred"] for x in language_id.predict(frame(spark, docs), none).collect()} == {"und"}


def op9_grams(text, orders=(1, 2, 3, 4)):
    fold = re.sub("[\t-\r]", " ", re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    return [fold[i : i + k] for k in orders for i in range(len(fold) - k + 1)]


def op9_bin(gram, buckets):
    data = gram.encode()
    p, off = language_id._points(C.Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 0, 1))
    return int(language_id._grams(p, off, len(gram), buckets)[0][0])


@pytest.mark.parametrize("matrix_bytes", [128 << 20, 2 * (1 << 10) * 4])
def test_op9_scores_are_those_of_a_plain_loop(spark, monkeypatch, matrix_bytes):
    monkeypatch.setattr(language_id, "MATRIX_BYTES", matrix_bytes)  # the smaller one takes blocks of two languages
    monkeypatch.setattr(language_id, "STEP_NUMBERS", 64)
    buckets, r = 1 << 10, random.Random(12)
    alphabet = {"aa": "abc ", "bb": "bcdé ", "cc": "cdeü\t", "dd": "xyz1", "ee": "ab漢字"}
    rows = [("".join(r.choice(alphabet[k]) for _ in range(r.randrange(0, 60))), k) for k in alphabet for _ in range(r.randrange(2, 9))] + [("zz", None), (None, "aa")]
    count, docs = {k: np.full(buckets, 0.5) for k in alphabet}, collections.Counter()
    for text, k in rows:
        if k:
            docs[k] += 1
            for g in op9_grams(text or ""):
                count[k][op9_bin(g, buckets)] += 1
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string").repartition(3), buckets=buckets)
    assert model.langs == sorted(alphabet) and len(model.blocks()) == (1 if matrix_bytes > 1 << 20 else 3)
    texts = ["".join(r.choice("abcdéüxyz1 漢") for _ in range(r.randrange(1, 50))) + "a" for _ in range(40)]
    got = language_id.predict(frame(spark, texts), model).orderBy("doc_id").collect()
    for x, text in zip(got, texts):
        z = {k: np.log((docs[k] + 1) / (sum(docs.values()) + len(alphabet))) + sum(np.log(count[k][op9_bin(g, buckets)] / count[k].sum()) for g in op9_grams(text)) for k in alphabet}
        best = max(sorted(z), key=lambda k: z[k])
        assert x["lang_pred"] == best and x["score"] == pytest.approx(1 / sum(np.exp(v - z[best]) for v in z.values()), rel=1e-3)


def test_op9_long_texts_count_as_they_do_whole(monkeypatch):
    text = "".join(random.Random(13).choice("abé漢𝒳 1") for _ in range(5000)).encode()
    x = C.Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0, 1)
    want = language_id.sparse_counts(x, 1 << 12)
    monkeypatch.setattr(language_id, "SEGMENT", 97)
    got = language_id.sparse_counts(x, 1 << 12)
    assert all((a == b).all() for a, b in zip(want, got))


def test_op9_memory_of_a_very_long_text():
    """50 MB and 60 languages: peak memory of the counts and their product."""
    import tracemalloc

    text = np.frombuffer(b"some words of a very long text " * (50 * (1 << 20) // 31), np.uint8)
    logp = np.zeros((language_id.BUCKETS, 60), np.float32)
    tracemalloc.start()
    s = language_id.products(*language_id.sparse_counts(C.Texts(text, np.array([0, len(text)]), 0, 1), language_id.BUCKETS), logp, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert s.shape == (1, 60) and peak < 1 << 28


# --- 10 ----------------------------------------------------------------------------------------


def brute_leaks(texts, items, window):
    of = collections.defaultdict(set)
    for k, t in items:
        w = NAME_WORDS.findall(lower_ascii(t))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            of[tuple(w[i : i + n])].add(str(k))
    out = []
    for t in texts:
        w = NAME_WORDS.findall(lower_ascii(t))
        hit, found = bytearray(len(w)), set()
        for n in {len(k) for k in of}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in of:
                    hit[i : i + n] = b"\1" * n
                    found |= of[tuple(w[i : i + n])]
        out.append((len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_op10_finds_every_window(spark, broadcast):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 6, 9, 10, 14, 30])))) for i in range(12)] + [(12, None), (13, "..."), (14, "w1 W2, w3")]
    texts = []
    for _ in range(40):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 60))]
        if r.random() < 0.6:
            s = NAME_WORDS.findall(lower_ascii(r.choice(items[:12])[1]))
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.decode() for x in s[: r.randrange(1, 31)]]
        texts.append(" ".join(x.upper() if r.random() < 0.2 else x for x in w))
    texts += [None, "", texts[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, texts).withColumn("items", F.lit("clash"))
    got = decontamination.decontaminate(df, bench, broadcast_rows=broadcast).orderBy("doc_id").collect()
    want = brute_leaks(texts, items, 10)
    assert [(x["n_words"], x["n_hit"], x["items"]) for x in got] == want
    for x, t in zip(got, texts):
        b = (t or "").encode()
        words = [w for s in x["hit_spans"] for w in NAME_WORDS.findall(b[s["start"] : s["end"]])]
        assert len(words) == x["n_hit"]


def test_op10_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, ["a b c", None])
    assert [x["n_hit"] for x in decontamination.decontaminate(docs, none).collect()] == [0, 0]
    assert decontamination.decontaminate(frame(spark, []), none).count() == 0


def test_crc_fold_is_that_of_zlib(spark):
    got = spark.range(50).select("id", (F.crc32(F.col("id").cast("string")) % 5).alias("f")).collect()
    assert all(x["f"] == zlib.crc32(str(x["id"]).encode()) % 5 for x in got)
