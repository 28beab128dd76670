"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every hashed n-gram (1 to 4 code points, ASCII letters lower-cased,
white space as one blank) of every training document into `buckets` bins per
language, and the documents of each language for its prior. The log-probability matrix (languages x buckets) is
broadcast, in blocks of languages that hold at most MATRIX_BYTES. A text is a sparse
vector of counts by bin; its product with the matrix is summed in steps of bounded bytes, and a text longer than
SEGMENT bytes is counted segment by segment, so memory doesn't grow with texts or languages.

Defined cases: a null text or one without a letter gets `und` and score 0; with
no training rows every text gets `und`; ties go to the language that sorts
first; documents whose language or, in op9, id is null train nothing, and a null id has a null held_out; repeated rows each count; input columns named as a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

ORDERS, BUCKETS = (1, 2, 3, 4), 1 << 16
#: Most bytes of the log-probability matrix that are broadcast at once.
MATRIX_BYTES = 128 << 20
#: Bytes of one text that are counted at once, numbers of a step of the product, and languages that a task counts before it passes them on.
SEGMENT, STEP_NUMBERS, HELD_LANGUAGES = 1 << 20, 1 << 20, 256
_KEYS = (np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32), np.uint32(0x2C1B3C6D))


def _fold() -> np.ndarray:
    """Code points below 2^16 as they count: ASCII lower-cased, blanks alike, digits alike."""
    t = np.arange(1 << 16, dtype=np.uint32)
    t[65:91] += 32
    t[[9, 10, 11, 12, 13]] = 32
    t[48:58] = 48
    return t


FOLD = _fold()


def _points(x: C.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a block and the offsets of its rows (broken UTF-8 is replaced)."""
    lead = (x.data & 0xC0) != 0x80
    text = x.data.tobytes().decode("utf-8", "replace")
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.concatenate([[0], np.cumsum(lead)])
    if n[-1] != len(p):  # broken UTF-8: row by row
        rows = [np.frombuffer(x.text(i).decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for i in range(len(x))]
        p, off = np.concatenate([*rows, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    else:
        off = n[x.off]
    return np.where(p < 1 << 16, FOLD[p & 0xFFFF], p), off


def _grams(p: np.ndarray, off: np.ndarray, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the k-grams of each row and the offsets of the rows among them."""
    if len(p) < k:
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    h = np.full(len(p) - k + 1, k, np.uint32)
    for j in range(k):
        h = (h ^ p[j : len(p) - k + 1 + j]) * _KEYS[0][j]
        h ^= h >> np.uint32(15)
    h = (h * _KEYS[1]) >> np.uint32(7)
    ok = C.whole(off, len(p), k)
    n = np.concatenate([[0], np.cumsum(ok)])
    return (h[ok] & np.uint32(buckets - 1)).astype(np.int32), n[np.minimum(off, len(n) - 1)]


def _whole_counts(data: np.ndarray, buckets: int, orders: tuple[int, ...]) -> np.ndarray:
    """Counts by bin of one long text, in segments that begin at a code point and look ahead as far as the longest n-gram."""
    total, ahead = np.zeros(buckets, np.int64), 4 * max(orders)
    lo = 0
    while lo < len(data):
        hi = min(lo + SEGMENT, len(data))
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi += 1
        near = np.flatnonzero((data[hi : hi + ahead] & 0xC0) != 0x80)
        end = hi + int(near[max(orders) - 1]) if len(near) >= max(orders) else min(len(data), hi + ahead)
        own, _ = _points(C.Texts(data[lo:hi], np.array([0, hi - lo]), 0, 1))
        p, off = _points(C.Texts(data[lo:end], np.array([0, end - lo]), 0, 1))
        for k in orders:
            g, _ = _grams(p, off, k, buckets)
            total += np.bincount(g[: len(own)], minlength=buckets)
        lo = hi
    return total


def sparse_counts(x: C.Texts, buckets: int, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin, count) of a block of texts, by row and bin."""
    if len(x) == 1 and len(x.data) > SEGMENT:
        n = _whole_counts(x.data, buckets, orders)
        bins = np.flatnonzero(n)
        return np.zeros(len(bins), np.int64), bins, n[bins]
    p, off = _points(x)
    kind = np.uint32 if len(x) * buckets < 1 << 32 else np.uint64
    keys = []
    for k in orders:
        g, at = _grams(p, off, k, buckets)
        keys.append(np.repeat(np.arange(len(x), dtype=kind) * kind(buckets), np.diff(at)) + g.astype(kind))
    key = np.concatenate(keys)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    found = key[first].astype(np.int64)
    return found // buckets, found % buckets, np.diff(np.append(first, len(key)))


class Model(NamedTuple):
    """Languages in order, their log priors, and the table (lang, counts) that blocks of the matrix are made of."""

    langs: list[str]
    prior: np.ndarray
    counts: DataFrame | None
    buckets: int

    def blocks(self) -> list[list[str]]:
        size = max(1, MATRIX_BYTES // (self.buckets * 4))
        return [self.langs[i : i + size] for i in range(0, len(self.langs), size)]

    def matrix(self, langs: list[str]) -> np.ndarray:
        """Log-probabilities (buckets x languages) of a block, half a count added to each bin."""
        rows = {r[0]: r[1] for r in self.counts.where(F.col("lang").isin(langs)).collect()}  # a row a language of the block
        out = np.empty((self.buckets, len(langs)), np.float32)
        for i, name in enumerate(langs):
            m = np.frombuffer(rows[name], "<i8") + 0.5
            out[:, i] = np.log(m / m.sum())
        return out


def train(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> Model:
    """The model after counting all n-grams of all rows."""
    src = documents.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}  # counts by bin, and the number of documents behind them

        def flush() -> Iterator[pa.RecordBatch]:
            for name, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([v.astype("<i8").tobytes()], pa.binary())], names=["lang", "counts"])
            sums.clear()

        for b in batches:
            code = b.column(0).dictionary_encode()
            names, ids = code.dictionary.to_pylist(), code.indices.to_numpy()
            for x in C.texts(b.column(1)):
                row, bins, n = sparse_counts(x, buckets, orders)
                own = ids[x.lo : x.hi]
                for i in np.unique(own):
                    at = own[row] == i
                    if names[i] not in sums:
                        sums[names[i]] = np.zeros(buckets + 1, np.int64)
                    sums[names[i]][:-1] += np.bincount(bins[at], n[at], buckets).astype(np.int64)
                    sums[names[i]][-1] += int((own == i).sum())
                if len(sums) > HELD_LANGUAGES:
                    yield from flush()
        yield from flush()

    table = C.cut(_summed(src.mapInArrow(count, _COUNTS), buckets + 1), "language-counts")
    seen = sorted(table.select("lang", F.expr(f"substring(counts, {buckets * 8 + 1}, 8)").alias("n")).collect(), key=lambda r: r[0].encode())  # a row a language
    docs = np.array([int.from_bytes(r[1], "little") for r in seen], np.float64)
    prior = np.log((docs + 1) / (docs.sum() + len(docs))) if len(seen) else np.zeros(0)
    return Model([r[0] for r in seen], prior, table.select("lang", F.expr(f"substring(counts, 1, {buckets * 8})").alias("counts")), buckets)


_COUNTS = "lang string, counts binary"


def _summed(parts: DataFrame, size: int) -> DataFrame:
    """One count vector a language; parts has one a language and task.

    Added up in two steps, the first salted, so that no task gets all the parts of a frequent language.
    """

    def add(key: tuple, part: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for v in part["counts"]:
            total += np.frombuffer(v.as_buffer(), "<i8")
        return pa.table({"lang": pa.array([key[0].as_py()]), "counts": pa.array([total.tobytes()], pa.binary())})

    salted = parts.withColumn("salt", F.spark_partition_id() % 64).groupBy("lang", "salt").applyInArrow(add, _COUNTS)
    return salted.groupBy("lang").applyInArrow(add, _COUNTS)


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
_PART = [T.StructField("__at", T.StringType()), T.StructField("__best", T.DoubleType()), T.StructField("__sum", T.DoubleType())]


def products(row: np.ndarray, bins: np.ndarray, n: np.ndarray, logp: np.ndarray, rows: int) -> np.ndarray:
    """Sparse counts (by row) times the matrix, in steps of STEP_NUMBERS."""
    s, step = np.zeros((rows, logp.shape[1])), max(1, STEP_NUMBERS // max(logp.shape[1], 1))
    for i in range(0, len(row), step):
        r = row[i : i + step]
        at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        s[r[at]] += np.add.reduceat(logp[bins[i : i + step]] * n[i : i + step, None], at, axis=0)
    return s


def predict(documents: DataFrame, model: Model, text_col: str = "text", orders: tuple[int, ...] = ORDERS, keep: list[str] | None = None) -> DataFrame:
    """documents with lang_pred and score, the posterior of the predicted language."""
    kept = [c for c in (documents.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    sc = documents.sparkSession.sparkContext
    df = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), F.col(f"`{text_col}`").alias("__t"))
    df = df.withColumn("__letter", F.coalesce(F.col("__t").rlike(r"\p{L}"), F.lit(False)))
    blocks, at = model.blocks(), 0
    for k, langs in enumerate(blocks):
        shared = sc.broadcast((langs, model.matrix(langs), model.prior[at : at + len(langs)]))
        at += len(langs)

        def score(x: C.Texts, shared=shared) -> dict[str, pa.Array]:
            names, logp, prior = shared.value
            s = products(*sparse_counts(x, logp.shape[0], orders), logp, len(x)) + prior
            best = s.argmax(1)
            top = s[np.arange(len(x)), best]
            total = np.exp(s - top[:, None]).sum(1)
            return {"__at": pa.array(names).take(pa.array(best)), "__best": pa.array(top), "__sum": pa.array(total)}

        rest = [c for c in df.columns if c != "__t" or k + 1 < len(blocks)]
        df = C.append_columns(df, "__t", _PART, score, rest).withColumnsRenamed({f.name: f"{f.name}_{k}" for f in _PART})
        if k + 1 < len(blocks):
            df = C.cut(df, "language-block")  # one block of the matrix is in memory at a time
    n = range(len(blocks))
    if not blocks:
        pred, post = F.lit("und"), F.lit(0.0)
    else:
        tops = [F.struct(F.col(f"__best_{k}").alias("b"), F.lit(-k).alias("k"), F.col(f"__at_{k}").alias("l")) for k in n]
        top = F.array_max(F.array(*tops))
        pred = top["l"]
        post = 1 / sum((F.col(f"__sum_{k}") * F.exp(F.col(f"__best_{k}") - top["b"]) for k in n), F.lit(0.0))
    out = df.select("__row", F.when(F.col("__letter"), pred).otherwise(F.lit("und")).alias("lang_pred"), F.when(F.col("__letter"), post).otherwise(F.lit(0.0)).alias("score"))
    return out.select("__row.*", "lang_pred", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(docs.where(fold != 1))
    return predict(docs, model, keep=["doc_id"]).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")
