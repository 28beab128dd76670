"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its hashed word embedding beside two of its characters: the mean of the
embeddings of its hashed trigrams, and that of its beginnings of 3 to 8 bytes. A word longer than PIECE bytes (a clause
of a script without blanks, joined tokens) is read as consecutive pieces that overlap by SHARED bytes, each in the place of a word. Texts are read in windows of `WINDOW` words that overlap by
half; forward and backward gated units read a window, attention pools their states, and a
text's score is that of its most toxic window, calibrated on the training texts.

Training sees a bounded sample of labelled rows (TRAIN_ROWS a class, in hash order) in one task, which returns the parameters: first with each window under its text's label,
then by multiple instances, where a toxic text answers for its highest window only. Texts of any length are in the sample; of one over TRAIN_BYTES,
pieces at random places go to the task, TRAIN_BYTES in all. Scoring covers every window of every whole text.

Defined cases: null and wordless texts are one empty window; with no labelled rows,
or labels of one class only, every score is that class's smoothed rate; labels other
than 0 and 1 are passed over; repeated rows get the same score; of rows that share an id, training reads the first by text, and a
label that an id has twice counts once if it is the same; in op3 a null id trains nothing and has a null held_out; input columns named as a new one are replaced.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW, STRIDE, HIDDEN = 32, 16, 8
WORD_BINS, WORD_DIM, CHAR_BINS, CHAR_DIM = 1 << 14, 8, 1 << 12, 8
HEAD_BINS, HEAD_DIM, HEADS = 1 << 14, 8, range(3, 9)
DIM = WORD_DIM + CHAR_DIM + HEAD_DIM
TRAIN_ROWS, TRAIN_BYTES = 1500, 16_000
TRAIN_PIECES = 32
PIECE, SHARED = 48, 3  # all trigrams of a long word are in some piece
EPOCHS, BATCH, RATE, WORD_DROP, HOLD = (3, 8), 512, 0.01, 0.5, 5
TABLE = C.byte_table("nonword", lower=True)
f32 = np.float32


# --- inputs ------------------------------------------------------------------------------------


def _windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all windows, and each row's offset among them; a row without words has one of length 0."""
    n = np.diff(off)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    at = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(at[-1]) - np.repeat(at[:-1], count)
    start = np.repeat(off[:-1], count) + k * STRIDE
    return start, np.minimum(WINDOW, np.repeat(off[1:], count) - start), at


def _pieces(x: C.Texts) -> C.Words:
    """Words of a block, those longer than PIECE bytes as pieces."""
    w = C.words(x, TABLE)
    size = w.end - w.start
    if not (size > PIECE).any():
        return w
    count = 1 + np.maximum(0, -(-(size - PIECE) // (PIECE - SHARED)))
    at = np.concatenate([[0], np.cumsum(count)])
    word = np.repeat(np.arange(len(size)), count)
    start = w.start[word] + (np.arange(at[-1]) - at[word]) * (PIECE - SHARED)
    end = np.minimum(start + PIECE, w.end[word])
    h = w.hash[word]
    part = np.flatnonzero(count[word] > 1)
    s, n = start[part], end[part] - start[part]
    own = n.astype(np.uint64)
    for j in range(PIECE):
        own = np.where(j < n, own * C.POW + C.BYTE_KEYS[TABLE[x.data[np.minimum(s + j, len(x.data) - 1)]]], own)
    h[part] = C.mix(own)
    return C.Words(h, start, end, at[w.off])


class Vocabulary:
    """Distinct words of some texts: word bins and character trigram bins."""

    def __init__(self, x: C.Texts, w: C.Words):
        _, first, self.id = np.unique(w.hash, return_index=True, return_inverse=True)
        self.word = (w.hash[first] >> np.uint64(40)).astype(np.int64) % WORD_BINS
        s, e = w.start[first], w.end[first]
        n = e - s
        self.off = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(self.off[-1]) - np.repeat(self.off[:-1], n)
        at = np.repeat(s, n) + place
        low = TABLE[x.data]
        c = low[at].astype(np.uint32)
        left = np.where(place > 0, low[np.maximum(at - 1, 0)], 1).astype(np.uint32)
        right = np.where(place < np.repeat(n, n) - 1, low[np.minimum(at + 1, len(low) - 1)], 2).astype(np.uint32)
        h = (left * np.uint32(0x01000193) ^ c) * np.uint32(0x85EBCA6B) ^ right * np.uint32(0xC2B2AE35)
        self.char = ((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) % CHAR_BINS
        self.size = n
        h = np.zeros(len(s), np.uint32)
        heads = []
        for j in range(max(HEADS)):
            has = j < e - s
            h = (h ^ np.where(has, low[np.minimum(s + j, max(len(low) - 1, 0))], 0).astype(np.uint32)) * np.uint32(0x01000193) + np.uint32(j + 1)
            if j + 1 in HEADS:
                heads.append(np.where(has, ((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) % HEAD_BINS, HEAD_BINS))
        self.head = np.stack(heads, 1)
        self.heads = np.maximum((self.head < HEAD_BINS).sum(1), 1)

    def inputs(self, p: dict) -> np.ndarray:
        v = np.zeros((len(self.word) + 1, DIM), f32)  # the last is the pad
        v[:-1, :WORD_DIM] = p["word"][self.word]
        if len(self.word):
            v[:-1, WORD_DIM : WORD_DIM + CHAR_DIM] = np.add.reduceat(p["char"][self.char], self.off[:-1], axis=0) / self.size[:, None]
            v[:-1, WORD_DIM + CHAR_DIM :] = np.concatenate([p["head"], np.zeros((1, HEAD_DIM), f32)])[self.head].sum(1) / self.heads[:, None]
        return v

    def matrix(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Word numbers of windows, one a row; -1 (the pad) beyond their length."""
        k = start[:, None] + np.arange(WINDOW)[None, :]
        inside = np.arange(WINDOW)[None, :] < length[:, None]
        return np.where(inside, self.id[np.minimum(k, max(len(self.id) - 1, 0))], -1) if len(self.id) else np.full(k.shape, -1)


# --- network -----------------------------------------------------------------------------------


def _start(rng: np.random.Generator) -> dict:
    h, d = HIDDEN, DIM
    n = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(f32)
    p = {"word": n(WORD_BINS, WORD_DIM, k=0.02), "char": n(CHAR_BINS, CHAR_DIM, k=0.1), "head": n(HEAD_BINS, HEAD_DIM, k=0.1)}
    for a in "fb":
        p |= {f"W{a}": n(d, 3 * h, k=d**-0.5), f"U{a}": n(h, 3 * h, k=h**-0.5), f"b{a}": np.zeros(3 * h, f32)}
    return p | {"A": n(2 * h, h, k=(2 * h) ** -0.5), "v": n(h, k=h**-0.5), "o": n(2 * h, k=(2 * h) ** -0.5), "c": np.zeros(1, f32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _projected(p: dict, v: np.ndarray, a: str) -> np.ndarray:
    """Inputs times weights for each word of a vocabulary; the pad's update gate stays shut, so states pass through it."""
    g = v @ p[f"W{a}"] + p[f"b{a}"]
    g[-1] = 0
    g[-1, :HIDDEN] = 40
    return g


def _run(p: dict, g: np.ndarray, ids: np.ndarray, a: str, tape: list | None) -> np.ndarray:
    """States of one direction at every place."""
    h, n = HIDDEN, len(ids)
    s, out = np.zeros((n, h), f32), np.empty((WINDOW, n, h), f32)
    for t in range(WINDOW) if a == "f" else range(WINDOW - 1, -1, -1):
        x, u = g[ids[:, t]], s @ p[f"U{a}"]
        zr = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        c = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
        new = c + z * (s - c)
        if tape is not None:
            tape.append((t, s, z, r, c, u[:, 2 * h :]))
        s = out[t] = new
    return out


def _forward(p: dict, v: np.ndarray, ids: np.ndarray, tapes: dict | None = None, g: dict | None = None):
    g = g or {a: _projected(p, v, a) for a in "fb"}
    hs = np.concatenate([_run(p, g[a], ids, a, None if tapes is None else tapes.setdefault(a, [])) for a in "fb"], axis=2)
    k = np.tanh(hs @ p["A"])
    e = k @ p["v"]
    e = np.where(ids.T < 0, f32(-1e9), e)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    ctx = np.einsum("tn,tnh->nh", w, hs)
    if tapes is not None:
        tapes["att"] = (hs, k, w, ctx)
    return ctx @ p["o"] + p["c"]


def _backward(p: dict, v: np.ndarray, ids: np.ndarray, tapes: dict, dy: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of the vocabulary's inputs."""
    h = HIDDEN
    hs, k, w, ctx = tapes["att"]
    g = {"o": ctx.T @ dy, "c": dy.sum(keepdims=True).astype(f32)}
    dctx = dy[:, None] * p["o"][None, :]
    dw = np.einsum("nh,tnh->tn", dctx, hs)
    de = w * (dw - (w * dw).sum(0))
    dk = de[..., None] * p["v"] * (1 - k * k)
    g["v"] = np.einsum("tn,tnh->h", de, k)
    g["A"] = np.einsum("tni,tnj->ij", hs, dk)
    dhs = w[..., None] * dctx[None] + dk @ p["A"].T
    dv = np.zeros_like(v)
    for n, a in enumerate("fb"):
        dU, ds = np.zeros_like(p[f"U{a}"]), np.zeros((len(ids), h), f32)
        dx = np.empty((WINDOW, len(ids), 3 * h), f32)
        for t, s, z, r, c, uc in reversed(tapes[a]):
            ds = ds + dhs[t][:, n * h : (n + 1) * h]
            dc = ds * (1 - z) * (1 - c * c)
            dz = ds * (s - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dc], 1)
            du = np.concatenate([dz, dr, dc * r], 1)
            dU += s.T @ du
            ds = ds * z + du @ p[f"U{a}"].T
        dx[ids.T < 0] = 0
        flat = ids.T.ravel()
        per = np.stack([np.bincount(flat + 1, dx[..., j].ravel(), len(v))[1:] for j in range(3 * h)], 1).astype(f32)
        g[f"U{a}"], g[f"W{a}"], g[f"b{a}"] = dU, v[:-1].T @ per, per.sum(0)
        dv[:-1] += per @ p[f"W{a}"].T
    return g, dv


class _Adam:
    def __init__(self, p: dict):
        self.m, self.q, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict, g: dict, rate: float) -> None:
        self.t += 1
        fix = rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.q[k] += 0.001 * (d * d - self.q[k])
            p[k] -= (fix * self.m[k] / (np.sqrt(self.q[k]) + 1e-8)).astype(f32)


def _all_logits(p: dict, vocab: Vocabulary, start: np.ndarray, length: np.ndarray, batch: int = 2048) -> np.ndarray:
    v = vocab.inputs(p)
    g = {a: _projected(p, v, a) for a in "fb"}
    return np.concatenate([_forward(p, v, vocab.matrix(start[i : i + batch], length[i : i + batch]), None, g) for i in range(0, len(start), batch)] or [np.zeros(0, f32)])


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 11, odds: float | None = None) -> dict:
    """Parameters; `scale` and `shift` turn a text's highest logit into its score's logit.

    odds: toxic over clean among all labelled rows, where the sample has others.
    """
    labels = np.asarray(labels, int)
    if len(set(labels.tolist())) < 2:
        rate = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.0
        return {"constant": float(rate)}
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(s) for s in texts])])
    x = C.Texts(data, off, 0, len(texts))
    w = _pieces(x)
    vocab = Vocabulary(x, w)
    start, length, at = _windows(w.off)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    rng = np.random.default_rng(seed)
    p = _start(rng)
    adam = _Adam(p)
    batch = int(np.clip(len(row) // 24, 32, BATCH))  # few windows still make some steps an epoch
    held = np.arange(len(texts)) % HOLD == 0  # a part of the sample only picks the epoch and calibrates
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held = np.ones(len(texts), bool)
        learn = np.ones(len(texts), bool)
    else:
        learn = ~held
    best, z = (np.inf, {}), np.zeros(0)
    for epoch in range(sum(EPOCHS)):
        single = epoch < EPOCHS[0]
        if single:
            pick = np.flatnonzero(learn[row])
            y = labels[row[pick]].astype(f32)
            weight = np.where(y > 0, 0.5, 1.0)
        else:  # each text answers for its highest window; clean texts for some others too
            top = (at[:-1] + np.array([z[a:b].argmax() for a, b in zip(at[:-1], at[1:], strict=True)]))[learn]
            others = np.flatnonzero(learn[row] & (labels[row] == 0) & (rng.random(len(row)) < 0.25))
            pick = np.concatenate([top, top, others])
            y, weight = labels[row[pick]].astype(f32), np.ones(len(pick))
        order = rng.permutation(len(pick))
        for i in range(0, len(order), batch):
            k = pick[order[i : i + batch]]
            ids, back = np.unique(vocab.matrix(start[k], length[k]), return_inverse=True)
            back = back.reshape(len(k), WINDOW) - (ids[0] < 0)
            words = ids[ids >= 0]
            sub = _part(vocab, words)
            v, tapes = sub.inputs(p), {}
            known = (rng.random(len(sub.word)) >= WORD_DROP).astype(f32)[:, None]  # a word left out must be told by its characters
            v[:-1, :WORD_DIM] *= known
            logit = _forward(p, v, back, tapes)
            dy = ((_sigmoid(logit) - y[order[i : i + batch]]) * weight[order[i : i + batch]] / len(k)).astype(f32)
            g, dv = _backward(p, v, back, tapes, dy)
            dv = dv[:-1]
            dv[:, :WORD_DIM] *= known
            g["word"] = np.stack([np.bincount(sub.word, dv[:, j], WORD_BINS) for j in range(WORD_DIM)], 1).astype(f32)
            each = np.repeat(dv[:, WORD_DIM : WORD_DIM + CHAR_DIM] / sub.size[:, None], sub.size, axis=0)
            g["char"] = np.stack([np.bincount(sub.char, each[:, j], CHAR_BINS) for j in range(CHAR_DIM)], 1).astype(f32)
            each = dv[:, WORD_DIM + CHAR_DIM :] / sub.heads[:, None]
            g["head"] = np.stack([np.bincount(sub.head.ravel(), np.repeat(each[:, j], len(HEADS)), HEAD_BINS + 1)[:-1] for j in range(HEAD_DIM)], 1).astype(f32)
            norm = float(np.sqrt(sum((d.astype(np.float64) ** 2).sum() for d in g.values())))
            g = {n: d * f32(min(1.0, 5.0 / (norm + 1e-9))) for n, d in g.items()}
            adam.step(p, g, RATE)
        z = _all_logits(p, vocab, start, length)
        high = np.maximum.reduceat(z, at[:-1]).astype(np.float64)[held]
        scale, shift = _calibrate(high, labels[held])
        q = scale * high + shift
        loss = float((np.logaddexp(0, q) - labels[held] * q).mean())
        if loss < best[0]:
            best = (loss, {n: v.copy() for n, v in p.items()} | {"scale": scale, "shift": shift})
    p = best[1]
    if odds:
        p["shift"] += float(np.log(odds) - np.log(labels.sum() / (len(labels) - labels.sum())))
    return p


def _part(vocab: Vocabulary, words: np.ndarray) -> Vocabulary:
    """The same vocabulary with some of its words."""
    sub = object.__new__(Vocabulary)
    sub.word, sub.size, sub.head, sub.heads = vocab.word[words], vocab.size[words], vocab.head[words], vocab.heads[words]
    sub.off = np.concatenate([[0], np.cumsum(sub.size)])
    sub.char = vocab.char[np.repeat(vocab.off[words] - sub.off[:-1], sub.size) + np.arange(sub.off[-1])]
    sub.id = np.zeros(0, int)
    return sub


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a one-dimensional logistic regression with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b, mid = 1.0, 0.0, (z[y == 1].mean() + z[y == 0].mean()) / 2
    z = z - mid
    for _ in range(100):
        q = _sigmoid(a * z + b)
        w = q * (1 - q) + 1e-9
        d, s = q - target, np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(s, [(d * z).sum(), d.sum()])
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -0.5, 0.5)
    a = max(a, 1e-3)
    return float(a), float(b - a * mid)


# --- Spark -------------------------------------------------------------------------------------


def sampled(text: str | None, most: int, key: str) -> str:
    """A text of up to `most` bytes as it is; of a longer one, TRAIN_PIECES pieces at random places, the same ones for a key, cut at blanks where they have any."""
    data = (text or "").encode("utf-8", "replace")
    if len(data) <= most:
        return data.decode()
    size = most // TRAIN_PIECES - 1
    starts = np.sort(np.random.default_rng(zlib.crc32(key.encode())).integers(0, len(data) - size, TRAIN_PIECES))
    out = []
    for i in starts.tolist():
        piece = data[i : i + size]
        lo, hi = piece.find(b" ") + 1, piece.rfind(b" ")
        out.append((piece[lo:hi] if 0 < lo < hi else piece).decode("utf-8", "ignore"))
    return " ".join(out)


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> dict:
    """Parameters fitted to a bounded sample of labelled texts: the first `rows` of each class in hash order."""
    ids = documents.select(F.col(id_col).alias("id"))
    known = C.cut(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").distinct().join(ids, "id", "left_semi"), "toxicity-labels")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).select("id", "y", F.xxhash64(F.lit("train"), "id").alias("h")).orderBy("h", "id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    few = C.cut(chosen.select("id", "y"), "toxicity-sample")  # 2 x rows at most
    n = known.agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean")).first()
    odds = n["toxic"] / n["clean"] if n["toxic"] and n["clean"] else None
    if not n["toxic"] + n["clean"]:
        return fit([], np.zeros(0, int))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = list(map(str, b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(1), pa.array([sampled(s, max_bytes, k) for s, k in zip(b.column(2).to_pylist(), key, strict=True)], pa.string())], names=["id", "y", "text"])

    got = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id").select("id", "y", "text").mapInArrow(shorten, "id string, y int, text string")
    got = got.groupBy("id", "y").agg(F.min("text").alias("text"))

    def task(t: pa.Table) -> pa.Table:
        sample = sorted(zip(t["id"].to_pylist(), t["text"].to_pylist(), t["y"].to_pylist(), strict=True))
        model = fit([s.encode("utf-8", "replace") for _, s, _ in sample], np.array([y for *_, y in sample], int), odds=odds)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    return pickle.loads(got.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(task, "model binary").first()["model"])  # our own bytes


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("n_windows", T.LongType()), T.StructField("worst_span", T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))]


def _score(p: dict, x: C.Texts) -> dict[str, pa.Array]:
    w = _pieces(x)
    start, length, at = _windows(w.off)
    if "constant" in p:
        best, score = at[:-1], np.full(len(x), p["constant"])
    else:
        z = _all_logits(p, Vocabulary(x, w), start, length).astype(np.float64)
        high = np.maximum.reduceat(z, at[:-1])
        first = np.flatnonzero(z == np.repeat(high, np.diff(at)))
        best = first[np.searchsorted(first, at[:-1])]
        score = 1 / (1 + np.exp(-np.clip(p["scale"] * high + p["shift"], -700, 700)))
    none = length[best] <= 0
    n = max(len(w.hash) - 1, 0)
    lo = np.where(none, 0, (w.start[np.minimum(start[best], n)] if len(w.hash) else 0) - np.where(none, 0, x.off[:-1]))
    hi = np.where(none, 0, (w.end[np.minimum(start[best] + np.maximum(length[best], 1) - 1, n)] if len(w.hash) else 0) - np.where(none, 0, x.off[:-1]))
    return {"score": pa.array(score), "n_windows": pa.array(np.diff(at)), "worst_span": pa.StructArray.from_arrays([pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64))], names=["start", "end"])}


def score(documents: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """documents with score, n_windows and worst_span (bytes of the most toxic window)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return C.append_columns(documents, text_col, FIELDS, lambda x: _score(shared.value, x), keep)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold != 0))
    return score(docs, model, keep=["doc_id"]).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows")
