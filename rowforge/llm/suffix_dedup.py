"""Removal of repeated byte strings by column-wise suffix construction over many strings.

Every byte that is covered by a string of `length` bytes that also starts elsewhere
is found and removed, whole texts taken as UTF-8 bytes, matches within one row.

1. Alignment. In each window of `length` bytes the least hash of its `gram`-byte grams marks an
   anchor; equal windows have equal anchors at equal places. Windows are
   grouped by the anchor they choose, and only anchors whose hash occurs again anywhere can
   hold a repeated window. A run of windows with one anchor is a context: its bytes, from the first
   window's start to the last one's end.
2. Equal contexts are one string with a count. Strings are dealt to buckets by anchor hash,
   so equal windows meet, in the same column, counted from the anchor.
3. In a bucket, the suffix order is built column by column, from the last to the first. The state of the collection - the suffix
   order and the common prefixes of neighbours - lies in sequential files; each round reads those of the round before and the next column, inserts one
   symbol of each string in front of its suffix (the symbols in suffix order are the round's column of the
   Burrows-Wheeler transform), moves each suffix to where counts and ranks of the transform put it, updates the common prefix of neighbours - 0 between
   different symbols, else 1 + the least one between their old places - and writes both for the next round. As strings are aligned at anchors, a round's suffixes
   need comparing with those of the same round only, so each round costs its strings and not
   what was inserted before. Memory holds a few numbers a string.
   Neighbours with a common prefix of `length` or more are a class of equal windows; it is repeated if it counts more than one.
4. An anchor with more than `hot_contexts` different contexts would make one task hold them all. Its contexts are cut into
   blocks of BLOCK columns; all windows of a block share its middle bytes, so parts of one block that have a window in common have the same middle, which
   deals them to groups that are constructed as above. Parts with one middle and more than `hot_contexts` different flanks are all but one string; their
   windows are dealt out singly, where equal windows are one string with a count and nothing is left to sort.
5. Each row's repeated windows are joined to it and their bytes cut out.

Defined cases: null is empty; texts under `length` bytes have no windows; strings are
judged on the input; overlapping repeats within one text count; repeated rows are repeats of each other
and lose all windows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LENGTH, GRAM = 200, 24
#: Different contexts of one anchor (or parts with one middle) that one task holds, and columns of a part.
HOT_CONTEXTS, BLOCK = 20_000, 16
#: Strings that a bucket should hold on average.
BUCKET_STRINGS = 30_000
PAD = 255  # in no UTF-8 text
U = np.uint64


# --- 1: anchors --------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each place on, by doubling spans."""
    h, have = C.BYTE_KEYS[data], 1
    out, done = None, 0
    left = gram
    while left:
        if left & 1:
            if out is None:
                out, done = h, have
            else:
                n = len(h) - done
                out = out[: max(n, 0)] * C.GRAM_KEYS[have.bit_length()] + h[done : done + max(n, 0)]
                out = out[: len(data) - done - have + 1]
                done += have
        left >>= 1
        if left:
            n = len(h) - have
            h = h[: max(n, 0)] * C.GRAM_KEYS[have.bit_length() + 20] + h[have : have + max(n, 0)]
            have *= 2
    return C.mix(out)


def _leftmost_min(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the first least value among each w neighbours."""
    low, place, have = h, np.arange(len(h), dtype=np.int32), 1
    while have < w:
        step = min(have, w - have)
        a, b = low[: len(low) - step], low[step:]
        right = b < a
        place = np.where(right, place[step:], place[: len(place) - step])
        low = np.where(right, b, a)
        have += step
    return place


def _contexts(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: each context's first window, number of windows, anchor place and anchor hash."""
    if len(data) < length:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    out, pos, windows = [], 0, len(data) - length + 1
    while pos < windows:  # bounded steps; a context that a step cuts in two stays right, each part its own
        end = min(pos + C.STEP_BYTES, windows)
        h = _gram_hashes(data[pos : end + length - 1], gram)
        place = _leftmost_min(h, length - gram + 1)[: end - pos]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        n = np.diff(np.append(first, len(place)))
        out.append((first + pos, n, place[first].astype(np.int64) + pos, h[place[first]]))
        pos = end
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _anchor_rows(x: C.Texts, length: int, gram: int) -> dict[str, pa.Array]:
    parts = [_contexts(x.data[x.off[i] : x.off[i + 1]], length, gram) for i in range(len(x))]
    off = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    col = lambda k, t: np.concatenate([p[k] for p in parts]).astype(t) if parts else np.zeros(0, t)
    return {
        "hashes": C.lists(C.signed(col(3, np.uint64)), off),
        "places": C.lists(pa.array(_packed(col(0, np.int64), col(1, np.int64), col(2, np.int64))), off),
    }


def _packed(first: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A context's first window, number of windows and anchor in one number: rows stay narrow in the shuffle."""
    return first << 24 | windows << 12 | anchor - first


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = place >> 24
    return first, place >> 12 & 4095, first + (place & 4095)


ANCHOR_FIELDS = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("hashes", "places")]


# --- 3: columns --------------------------------------------------------------------------------


class _Least:
    """Least value of ranges lo < i <= hi of an array, by tables of doubling spans."""

    def __init__(self, a: np.ndarray, longest: int):
        self.t = [a]
        while (1 << len(self.t)) <= longest:
            b, s = self.t[-1], 1 << (len(self.t) - 1)
            self.t.append(np.minimum(b[:-s], b[s:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.t[0].dtype)
        for j in np.unique(k):
            at = np.flatnonzero(k == j)
            out[at] = np.minimum(self.t[j][lo[at] + 1], self.t[j][hi[at] - (1 << int(j)) + 1])
        return out


def repeated_columns(strings: list, shift: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (string, lo, hi) of windows, by start, that occur more than once in columns of all strings.

    shift: the column of each string's first byte; count: how often each string occurs.
    """
    m = len(strings)
    size = np.array([len(s) for s in strings])
    shift = shift - int(shift.min())
    width = int((shift + size).max())
    last, begin = np.full(m, -2), np.full(m, -1)  # of each string: the last window found, and the one that began its run
    found = []
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as old, tempfile.TemporaryFile() as new:
        # columns, last one first, written in slabs of so many columns that a slab is bounded
        slab = max(1, min(width, (32 << 20) // max(m, 1)))
        data = np.frombuffer(b"".join(strings), np.uint8)
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        for hi in range(width, 0, -slab):
            lo = max(0, hi - slab)
            j = np.arange(hi - 1, lo - 1, -1)[:, None] - shift[None, :]
            inside = (j >= 0) & (j < size[None, :])
            part = np.full(j.shape, PAD, np.uint8)
            part[inside] = data[(at[None, :] + j)[inside]]
            columns.write(part)
        columns.seek(0)
        old.write(np.arange(m, dtype=np.int32))
        old.write(np.zeros(m, np.int16))
        for c in range(width - 1, -1, -1):
            old.seek(0)
            order, prefix = np.frombuffer(old.read(4 * m), np.int32), np.frombuffer(old.read(2 * m), np.int16)
            transform = np.frombuffer(columns.read(m), np.uint8)[order]  # what is inserted in front of each suffix, in their order
            move = np.argsort(transform, kind="stable")  # where counts and ranks put them
            symbol = transform[move]
            joint = np.zeros(m, np.int16)
            same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] != PAD)) + 1
            if len(same):
                lo, hi = move[same - 1], move[same]
                joint[same] = np.minimum(_Least(prefix, int((hi - lo).max()))(lo, hi) + 1, length)
            order, prefix = order[move], joint
            new.seek(0)
            new.write(order)
            new.write(prefix)
            old, new = new, old
            if c + length > width:
                continue
            whole = (c >= shift[order]) & (c + length <= shift[order] + size[order])
            cls = np.cumsum(prefix < length) - 1
            n = np.bincount(cls, np.where(whole, count[order], 0), cls[-1] + 1)
            hit = order[whole & (n[cls] > 1)]
            fresh = hit[last[hit] != c + 1]
            ended = fresh[begin[fresh] >= 0]
            found.append((ended, last[ended], begin[ended]))
            begin[fresh] = c
            last[hit] = c
    ended = np.flatnonzero(begin >= 0)
    found.append((ended, last[ended], begin[ended]))
    i, lo, hi = (np.concatenate(v) for v in zip(*found, strict=True))
    return i, lo - shift[i], hi - shift[i]


RUNS = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
ARROW_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


# --- Spark -------------------------------------------------------------------------------------


def _cut_contexts(length: int):
    """Rows (id row, context digest, first window, anchor hash, bytes of the first of equal contexts in a batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0)
            for x in C.texts(b.column(1)):
                wanted = b.column(2).slice(x.lo, len(x))
                rows, first, digest, hashes, text, shift, seen = [], [], [], [], [], [], set()
                for i in range(len(x)):
                    t = x.data[x.off[i] : x.off[i + 1]]
                    w = wanted[i].values
                    if w is None or not len(w):
                        continue
                    h = w.field("hash").to_numpy()
                    f, n, a = _unpacked(w.field("place").to_numpy())
                    for f_, n_, a_, h_ in zip(f.tolist(), n.tolist(), a.tolist(), h.tolist(), strict=True):
                        s = t[f_ : f_ + n_ + length - 1].tobytes()
                        d = xxhash.xxh3_128_digest(s + h_.to_bytes(8, "little", signed=True) + (a_ - f_).to_bytes(4, "little"))
                        rows.append(x.lo + i)
                        first.append(f_)
                        digest.append(d)
                        hashes.append(h_)
                        shift.append(f_ - a_)
                        text.append(None if d in seen else s)
                        seen.add(d)
                if rows:
                    yield pa.RecordBatch.from_arrays([rid.take(pa.array(rows)), pa.array(first, pa.int32()), pa.array(digest, pa.binary()), pa.array(hashes, pa.int64()), pa.array(shift, pa.int32()), pa.array(text, pa.binary())], names=["rid", "first", "digest", "hash", "shift", "bytes"])

    return run


def _bucket(length: int):
    def task(t: pa.Table) -> pa.Table:
        strings = [v.as_buffer() for v in t["bytes"].combine_chunks()]
        i, lo, hi = repeated_columns(strings, t["shift"].to_numpy().astype(np.int64), t["n"].to_numpy(), length)
        return pa.table({"digest": t["digest"].combine_chunks().take(pa.array(i)), "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32())})

    return task


PARTS = "part binary, digest binary, at int, n long, hash long, shift int, bytes binary"


def _parts(length: int, block: int):
    """Contexts cut into blocks of columns: (part, context digest, first window, count, hash of the middle, shift, bytes of the first of equal parts in a batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, at, part, hashes, shift, text, n, seen = [], [], [], [], [], [], [], set()
            for d, s, n_, h, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *[b.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
                last = first + len(s) - length  # columns first .. last begin windows
                for k in range(first // block, last // block + 1):
                    lo, hi = max(first, k * block) - first, min(last, k * block + block - 1) - first
                    own = s[lo : hi + length]
                    mid = s[k * block + block - 1 - first : k * block + length - first]
                    key = xxhash.xxh3_64_intdigest(mid + h.to_bytes(8, "little", signed=True) + k.to_bytes(4, "little", signed=True)) - (1 << 63)
                    p = xxhash.xxh3_128_digest(own + key.to_bytes(8, "little", signed=True) + (first + lo).to_bytes(4, "little", signed=True))
                    part.append(p)
                    digest.append(d)
                    at.append(lo)
                    hashes.append(key)
                    shift.append(first + lo)
                    n.append(n_)
                    text.append(None if p in seen else own)
                    seen.add(p)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(digest, pa.binary()), pa.array(at, pa.int32()), pa.array(n, pa.int64()), pa.array(hashes, pa.int64()), pa.array(shift, pa.int32()), pa.array(text, pa.binary())], names=["part", "digest", "at", "n", "hash", "shift", "bytes"])

    return run


def _windows(length: int):
    """Each window of strings: (window digest, string digest, place, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, s, n in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                s = memoryview(s.as_buffer())
                k = len(s) - length + 1
                w = [xxhash.xxh3_128_digest(s[i : i + length]) for i in range(k)]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.repeat(d, k), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, n))], names=["window", "digest", "at", "n"])

    return run


def _runs(strings: DataFrame, length: int, hot_contexts: int, block: int) -> DataFrame:
    """(digest, lo, hi): the repeated windows of distinct strings (digest, n, bytes, hash, shift), which can be equal within one hash only."""
    groups = C.cut(strings.groupBy("hash").agg(F.count("*").alias("strings"), F.sum("n").alias("total")).where("total > 1"), "suffix-groups")
    sums = groups.agg(F.coalesce(F.sum("strings"), F.lit(0)).alias("all"), F.coalesce(F.max("strings"), F.lit(0)).alias("most")).first()
    live = strings.join(groups.select("hash", "strings"), "hash")
    cold, hot = live.where(F.col("strings") <= hot_contexts), live.where(F.col("strings") > hot_contexts)
    buckets = max(1, -(-sums["all"] // BUCKET_STRINGS))
    runs = cold.withColumn("bucket", F.pmod("hash", F.lit(buckets * 4))).groupBy("bucket").applyInArrow(_bucket(length), "digest binary, lo int, hi int")
    if sums["most"] <= hot_contexts:
        return runs
    if block > 1:
        parts = C.cut(hot.select("digest", "bytes", "n", "hash", "shift").mapInArrow(_parts(length, block), PARTS), "suffix-parts")
        few = C.cut(parts.groupBy(F.col("part").alias("digest")).agg(F.sum("n").alias("n"), F.first("bytes", ignorenulls=True).alias("bytes"), F.first("hash").alias("hash"), F.first("shift").alias("shift")), "suffix-part-strings")
        inner = C.cut(_runs(few, length, hot_contexts, 1).withColumnRenamed("digest", "part"), "suffix-part-runs")
        more = parts.select("part", "digest", "at").join(inner, "part").select("digest", (F.col("lo") + F.col("at")).alias("lo"), (F.col("hi") + F.col("at")).alias("hi"))
    else:
        windows = C.cut(hot.select("digest", "bytes", "n").mapInArrow(_windows(length), "window binary, digest binary, at int, n long"), "suffix-windows")
        twice = windows.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
        more = windows.join(twice, "window", "left_semi").select("digest", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return runs.unionByName(more)


def _cut_out(x: C.Texts, runs: pa.Array, length: int) -> dict[str, pa.Array]:
    removed, spans, sha, kept, where = [], [], [], [], []
    for i in range(len(x)):
        t, w = x.data[x.off[i] : x.off[i + 1]], runs[x.lo + i].values
        if w is None or not len(w):
            removed.append(0)
            spans.append(0)
            where.append([])
            out = t.tobytes()
        else:
            step = np.zeros(len(t) + 1, np.int32)
            np.add.at(step, w.field("lo").to_numpy(), 1)
            np.add.at(step, w.field("hi").to_numpy() + length, -1)
            gone = np.cumsum(step)[:-1] > 0
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            lo, hi = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
            removed.append(int(gone.sum()))
            spans.append(len(lo))
            where.append([{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi, strict=True)])
            out = t[~gone].tobytes()
        kept.append(out)
        sha.append(hashlib.sha256(out).hexdigest())
    return {
        "n_bytes": pa.array(np.diff(x.off).astype(np.int64)),
        "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array(spans, pa.int64()),
        "removed_spans": pa.array(where, ARROW_RUNS),
        "kept_sha256": pa.array(sha, pa.string()),
        "kept": pa.array(kept, pa.binary()),
    }


def repeated_runs(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """rows (rid, text), rid unique -> (rid, runs): the windows of each text that occur again, as runs of starts."""
    if length - gram >= 4095:
        raise ValueError("a context's windows are numbered in 12 bits: length - gram must be under 4095")
    found = C.append_columns(rows, "text", ANCHOR_FIELDS, lambda x: _anchor_rows(x, length, gram), ["rid"])
    anchors = C.cut(found.select("rid", F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("places").alias("place")))), "suffix-anchors")
    # written, so that the join below has plain shuffles on both sides, which can be split at hot hashes
    again = C.cut(anchors.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "suffix-again")
    # several windows of one context in a row have one anchor only, so a text without another equal anchor is out
    wanted = anchors.join(again, "hash", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("place", "hash")).alias("wanted"))
    cut = rows.join(wanted, "rid").select("rid", "text", "wanted").mapInArrow(_cut_contexts(length), "rid long, first int, digest binary, hash long, shift int, bytes binary")
    contexts = C.cut(cut, "suffix-contexts")
    C.free(anchors, again)
    strings = C.cut(contexts.groupBy("digest").agg(F.count("*").alias("n"), F.first("bytes", ignorenulls=True).alias("bytes"), F.first("hash").alias("hash"), F.first("shift").alias("shift")), "suffix-strings")
    runs = C.cut(_runs(strings, length, hot_contexts, max(1, min(BLOCK, length // 2))), "suffix-runs")
    C.free(strings)
    each = contexts.select("rid", "first", "digest").join(runs, "digest").select("rid", (F.col("lo") + F.col("first")).alias("lo"), (F.col("hi") + F.col("first")).alias("hi"))
    found = C.cut(each.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "suffix-found")
    C.free(contexts, runs)
    return found


FIELDS = [
    *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
    T.StructField("removed_spans", RUNS),
    T.StructField("kept_sha256", T.StringType()),
    T.StructField("kept", T.BinaryType()),
]


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS, with_kept: bool = True, from_files: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, removed_spans, kept_sha256, kept) for each row; kept holds the remaining bytes.

    from_files: documents is read straight from Parquet files, so its rows are numbered by file and place; others are written once.
    """
    of = lambda rid: [rid.alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    if from_files:
        rows = C.numbered_files(documents, "__rid").select(*of(F.col("__rid")))
    else:
        rows = C.cut(documents.select(*of(F.monotonically_increasing_id())), "suffix-rows")
    runs = repeated_runs(rows.select("rid", "text"), length, gram, hot_contexts)
    names = [f.name for f in FIELDS if with_kept or f.name != "kept"]
    fields = [f for f in FIELDS if f.name in names]
    src = rows.join(runs, "rid", "left").select("id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in C.texts(b.column(1)):
                made = _cut_out(x, b.column(2), length)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x.lo, len(x)), *[made[n] for n in names]], names=["id", *names])

    return src.mapInArrow(run, T.StructType([src.schema["id"], *fields])).withColumnRenamed("id", id_col)


def op1(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False, from_files=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
