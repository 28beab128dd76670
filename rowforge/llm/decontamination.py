"""Benchmark decontamination by winnowing.

A window is `window` consecutive words of a benchmark item (a shorter item is
one window). Of each window, the least hash of its `gram`-word grams is kept
as its fingerprint, for items and documents alike, so any shared window has a
shared fingerprint. Document windows whose fingerprint occurs in the benchmark
are extended to the whole window and compared with the item windows by 64-bit
hash; the words of those that agree are hit.

The benchmark's fingerprints go to the executors as a broadcast while they
number fewer than `broadcast_rows`; beyond that, documents' fingerprints and
windows are joined with them by shuffles.

Defined cases: a null or wordless text has no words and no hits; null or
wordless items have no windows; an empty benchmark leaves all documents clean;
repeated rows each get their own result; item ids are compared as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW, GRAM = 10, 5
#: Rows of (window, item) that may be broadcast: 24 bytes each and the ids.
BROADCAST_ROWS = 1_000_000
TABLE = C.byte_table("nonword", lower=True)


def _fingerprints(h: np.ndarray, size: int, gram: int) -> np.ndarray:
    """The least gram hash of each window of `size` words."""
    k = min(gram, size)
    return C.sliding_min(C.grams(h, k), size - k + 1)


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Distinct (size, fp, win, item): each item's windows, their fingerprints and hashes."""
    src = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in C.texts(b.column(1)):
                w = C.words(x, TABLE)
                for i in range(len(x)):
                    h = w.hash[w.off[i] : w.off[i + 1]]
                    if not len(h):
                        continue
                    n = min(window, len(h))
                    fp, win = _fingerprints(h, n, gram), C.grams(h, n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), n, np.int32)), C.signed(fp), C.signed(win), pa.repeat(b.column(0)[x.lo + i], len(fp))], names=["size", "fp", "win", "item"])

    return src.mapInArrow(run, "size int, fp long, win long, item string").where("item is not null").distinct()


class _Index:
    """The benchmark's windows, by size, as sorted arrays."""

    def __init__(self, table: pa.Table):
        size = table["size"].to_numpy()
        self.items = np.array(table["item"].to_pylist(), object)
        self.by = {}
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            fp = np.unique(table["fp"].to_numpy()[at].view(np.uint64))
            win = table["win"].to_numpy()[at].view(np.uint64)
            at = at[np.argsort(win, kind="stable")]
            win, first = np.unique(np.sort(win), return_index=True)
            self.by[int(n)] = (fp, C.Filter(fp), win, at, np.append(first, len(at)))


def _scan(index: _Index, gram: int, x: C.Texts) -> dict[str, pa.Array]:
    w = C.words(x, TABLE)
    n, rows = len(w.hash), len(x)
    step = np.zeros(n + 1, np.int32)
    owners, owned = [], []
    for size, (fps, bits, wins, at, first) in index.by.items():
        if n < size:
            continue
        fp = _fingerprints(w.hash, size, gram)
        s = np.flatnonzero(bits(fp))
        s = s[C.lookup(fps, fp[s]) >= 0]
        if not len(s):
            continue
        row = np.searchsorted(w.off, s, "right") - 1
        s, row = s[(ok := s + size <= w.off[row + 1])], row[ok]
        g = C.mix(sum(w.hash[s + j] * C.GRAM_KEYS[j] for j in range(size)) + np.uint64(size))
        hit = C.lookup(wins, g)
        s, row, hit = s[hit >= 0], row[hit >= 0], hit[hit >= 0]
        np.add.at(step, s, 1)
        np.add.at(step, s + size, -1)
        for r, k in np.unique(np.stack([row, hit], 1), axis=0) if len(s) else ():
            owners.append(np.full(first[k + 1] - first[k], r))
            owned.append(at[first[k] : first[k + 1]])
    covered = np.cumsum(step)[:n] > 0
    total = np.concatenate([[0], np.cumsum(covered)])
    found: list[list[str]] = [[] for _ in range(rows)]
    if owners:
        r, o = np.concatenate(owners), np.concatenate(owned)
        for i in np.unique(r):
            found[i] = sorted({index.items[k] for k in o[r == i]})
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    cut = np.zeros(n + 1, bool)  # a run of hit words ends with its row
    cut[w.off] = True
    lo = np.flatnonzero((edge > 0) | (cut & np.append(covered, False)))
    hi = np.flatnonzero((edge < 0) | (cut & np.concatenate([[False], covered])))
    run = pa.StructArray.from_arrays([pa.array(w.start[lo] - x.off[(r := np.searchsorted(w.off, lo, "right") - 1)]), pa.array(w.end[hi - 1] - x.off[r])], names=["start", "end"])
    return {
        "n_words": pa.array(np.diff(w.off)),
        "n_hit": pa.array(total[w.off[1:]] - total[w.off[:-1]]),
        "items": pa.array(found, pa.list_(pa.string())),
        "hit_spans": C.lists(run, np.searchsorted(lo, w.off)),
    }


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS, keep: list[str] | None = None) -> DataFrame:
    """documents with n_words, n_hit, items (sorted ids whose windows occur) and hit_spans (byte ranges)."""
    spark = documents.sparkSession
    table = C.cut(benchmark_windows(benchmark, item_id, item_text, window, gram), "bench-windows")
    if C.rows_fewer_than(table, broadcast_rows):
        shared = spark.sparkContext.broadcast(_Index(table.toArrow()))
        return C.append_columns(documents, text_col, FIELDS, lambda x: _scan(shared.value, gram, x), keep)
    return _by_join(documents, table, text_col, gram, keep)


def _emit(sizes: list[int], gram: int, wanted: bool):
    """Rows (rid, size, fp) of each document's windows, or (rid, size, win, start, end) of those with a wanted fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0).to_numpy()
            for x in C.texts(b.column(1)):
                w = C.words(x, TABLE)
                for size in sizes:
                    if len(w.hash) < size:
                        continue
                    fp = _fingerprints(w.hash, size, gram)
                    s = np.flatnonzero(C.whole(w.off, len(w.hash), size))
                    row = np.searchsorted(w.off, s, "right") - 1
                    if not wanted:
                        pairs = np.unique(np.stack([row.astype(np.uint64), fp[s]], 1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(rid[x.lo + pairs[:, 0].astype(np.int64)]), pa.array(np.full(len(pairs), size, np.int32)), C.signed(pairs[:, 1])], names=["rid", "size", "fp"])
                        continue
                    pick = np.zeros(len(s), bool)
                    for i in np.unique(row):
                        want = b.column(2)[x.lo + int(i)].as_py() or ()
                        here = np.flatnonzero(row == i)
                        pick[here] = np.isin(fp[s[here]], np.array([f["fp"] for f in want if f["size"] == size], np.int64).view(np.uint64))
                    s, row = s[pick], row[pick]
                    g = C.grams(w.hash, size)[s]
                    yield pa.RecordBatch.from_arrays([pa.array(rid[x.lo + row]), pa.array(np.full(len(s), size, np.int32)), C.signed(g), pa.array(s - w.off[row]), pa.array(w.start[s] - x.off[row]), pa.array(w.end[s + size - 1] - x.off[row])], names=["rid", "size", "win", "word", "start", "end"])

    return run


def _count_words(x: C.Texts) -> dict[str, pa.Array]:
    return {"n_words": pa.array(np.diff(C.words(x, TABLE).off))}


def _by_join(documents: DataFrame, table: DataFrame, text_col: str, gram: int, keep: list[str] | None) -> DataFrame:
    """The same result for a benchmark of any size, by joins on fingerprints and windows."""
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())  # one to `window` of them
    kept = documents.columns if keep is None else keep
    src = C.cut(documents.select(F.monotonically_increasing_id().alias("__rid"), F.col(text_col).alias("__body"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row")), "bench-docs")
    body = src.select(F.col("__rid").alias("rid"), F.col("__body").alias("body"))
    fps = body.mapInArrow(_emit(sizes, gram, False), "rid long, size int, fp long")
    want = fps.join(table.select("size", "fp").distinct(), ["size", "fp"], "left_semi").groupBy("rid").agg(F.collect_set(F.struct("size", "fp")).alias("want"))
    wins = C.cut(body.join(want, "rid").mapInArrow(_emit(sizes, gram, True), "rid long, size int, win long, word long, start long, end long"), "bench-wins")
    hit = wins.join(table.select("size", "win").distinct(), ["size", "win"], "left_semi")
    items = wins.select("rid", "size", "win").distinct().join(table.select("size", "win", "item").distinct(), ["size", "win"]).groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # runs of words: windows in order, each joined to the run before it if they touch
    folded = F.aggregate(
        F.array_sort(F.collect_set(F.struct("word", F.expr("word + size AS stop"), "start", "end"))),
        F.expr("cast(array() as array<struct<word:bigint,stop:bigint,start:bigint,end:bigint>>)"),
        lambda a, v: F.when(
            (F.size(a) > 0) & (v["word"] <= F.element_at(a, -1)["stop"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["word"].alias("word"), F.greatest(F.element_at(a, -1)["stop"], v["stop"]).alias("stop"), F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], v["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(F.struct(v["word"].alias("word"), v["stop"].alias("stop"), v["start"].alias("start"), v["end"].alias("end"))))),
    )
    runs = hit.groupBy("rid").agg(folded.alias("runs"))
    counted = C.append_columns(src.select("__rid", "__body"), "__body", [FIELDS[0]], _count_words, ["__rid"])
    out = src.select("__rid", "__row").join(counted, "__rid").join(runs.withColumnRenamed("rid", "__rid"), "__rid", "left").join(items.withColumnRenamed("rid", "__rid"), "__rid", "left")
    return out.select(
        *[F.col(f"__row.`{c}`").alias(c) for c in kept if c not in {f.name for f in FIELDS}],
        "n_words",
        F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["word"]), F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))), F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("hit_spans"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
