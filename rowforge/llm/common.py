"""Shared parts of the training-data operators.

Texts reach Python as Arrow buffers and are handled as numpy byte arrays, a
bounded block of rows at a time, so no Python object is made per word or per
character. Tables that cut lineage are written as Parquet under the folder
that all executors share.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of text handled at once in Python; a longer single text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Bytes hashed at once; bounds the 8-byte temporaries of a block.
STEP_BYTES = 1 << 19


# --- tables in the shared folder ---------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local one is made in local mode; on a cluster it is an error, as executors couldn't read each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="rowforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _drop_later(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has gone; the folder's owner clears it
            pass

    atexit.register(drop)


#: Part of the driver's largest heap that may be in use, and half the part that may be taken, before the leavings of finished jobs are collected.
HEAP_SHARE = 0.25


def let_go(spark: SparkSession) -> None:
    """Collect what finished jobs left in the driver's heap, if more than HEAP_SHARE of it is in use or twice that is taken from the machine.

    A job broadcasts its tasks, the settings of its scans and small tables, in chunks of 4 MB and pages of 1 MB. They outlive
    collections of young objects, and Spark asks for a whole one twice an hour only, so rows of short jobs grow the heap towards its limit.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    taken, most = heap.totalMemory(), HEAP_SHARE * heap.maxMemory()
    if taken - heap.freeMemory() > most or taken > 2 * most:
        gc.collect()  # plans that Python holds in cycles
        spark._jvm.java.lang.System.gc()


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that lost executors can reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rowforge/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    _drop_later(spark, path)
    let_go(spark)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = (weakref.ref(table), path)
    return table


_paths: dict[int, tuple] = {}


def free(*tables: DataFrame) -> None:
    """Delete tables that cut wrote, once all that was to be read from them has been written elsewhere."""
    for t in tables:
        known, path = _paths.pop(id(t), (None, None))
        if known is not None and known() is t:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def numbered_files(files: DataFrame, name: str) -> DataFrame:
    """files, read straight from Parquet files, with column `name`: a row's number by its file and its place in that file.

    Unlike monotonically_increasing_id it doesn't depend on how files are split, so each reading gives the same numbers.
    """
    spark = files.sparkSession
    paths = sorted(r[0] for r in files.select("_metadata.file_path").distinct().collect())  # a row a file
    number = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "__path string, __file long")
    rows = files.withColumns({"__path": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")})
    return rows.join(F.broadcast(number), "__path").withColumn(name, F.shiftleft("__file", 40) + F.col("__at")).drop("__path", "__file", "__at")


#: Keys that a broadcast of large groups holds at most, and rows of a key from which it counts as one.
LARGE_KEYS, LARGE_ROWS = 100_000, 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "left") -> DataFrame:
    """rows joined to groups (key, size, ...) without a task that gets all rows of a large group.

    rows and groups are tables; groups has a row a key, and `size` is how many rows it has. Groups of more than
    LARGE_ROWS rows, and more than all rows over LARGE_KEYS, are at most LARGE_KEYS: they are broadcast. The others are joined by key.
    """
    limit = max(LARGE_ROWS, rows.count() // LARGE_KEYS)
    large, small = groups.where(F.col(size) > limit).drop(size), groups.where(F.col(size) <= limit).drop(size)
    names = F.broadcast(large.select(key))
    rest = rows.join(names, key, "left_anti").join(small, key, how)
    return rest.unionByName(rows.join(F.broadcast(large), key))


def rows_fewer_than(df: DataFrame, limit: int) -> bool:
    """Whether df has fewer rows than limit, reading no more than that many."""
    return df.limit(limit).count() < limit


# --- texts as byte arrays ----------------------------------------------------------------------


@dataclass
class Texts:
    """Rows lo..hi of a batch: their bytes one after another; row i has data[off[i]:off[i + 1]]."""

    data: np.ndarray
    off: np.ndarray
    lo: int
    hi: int

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def texts(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Blocks of whole texts of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).view(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, ob, db = column.buffers()
    off = np.frombuffer(ob, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(db, np.uint8) if db is not None and db.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + block_bytes, "right")) - 1)
        hi = min(hi, n)
        yield Texts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo, hi)
        lo = hi


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField], fn: Callable[[Texts], dict[str, pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) and the columns that fn makes of each block of texts.

    An input column that bears the name of a new one is replaced by it.
    """
    new = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([*[src.schema[c] for c in kept], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in texts(b.column(len(kept))):
                made = fn(x)
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(x.lo, len(x)) for i in range(len(kept))], *[made[n] for n in new]], names=[*kept, *new])

    return src.mapInArrow(run, schema)


# --- hashing -----------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240607)
BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
POW = U64(int(_RNG.integers(2**61, 2**62)) * 4 + 1)
POW_INV = U64(pow(int(POW), -1, 2**64))
GRAM_KEYS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "n" not in _powers or len(_powers["n"]) < n:
        size = max(n, STEP_BYTES + 1)
        for k, base in (("n", POW), ("i", POW_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["n"][:n], _powers["i"][:n]


def byte_table(separators: str, lower: bool) -> np.ndarray:
    """What each byte counts as: 0 separates words; A-Z become a-z if lower.

    separators: "space" for blanks \\x20 and \\x09-\\x0D; "nonword" for all of
    ASCII but digits and lower-case letters (bytes of longer code points belong to words).
    """
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    if separators == "space":
        t[[9, 10, 11, 12, 13, 32]] = 0
        t[0] = 255  # U+0000 is part of a word here; byte 255 is in no UTF-8 text
    else:
        drop = np.ones(128, bool)
        drop[48:58] = False
        drop[97:123] = False
        low = t[:128].copy()
        t[:128] = np.where(drop[low], 0, low)
    return t


@dataclass
class Words:
    """Words of a block: 64-bit hashes, byte spans, and where each row's words begin."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray  # row i has words off[i] .. off[i + 1]

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def words(x: Texts, table: np.ndarray) -> Words:
    n = len(x.data)
    key = np.where(table == 0, U64(0), BYTE_KEYS[table])
    rows = x.off[:-1]
    is_row = np.zeros(n + 1, bool)
    is_row[rows] = True
    hs, ss, es = [], [], []
    pos = 0
    while pos < n:
        end = min(pos + STEP_BYTES, n)
        if end < n and not (is_row[end] or table[x.data[end]] == 0):
            part = np.flatnonzero((table[x.data[pos:end]] == 0) | is_row[pos:end])
            if len(part) and part[-1] > 0:
                end = pos + int(part[-1])
            else:  # one word longer than a step
                while end < n and not (is_row[end] or table[x.data[end]] == 0):
                    more = min(end + STEP_BYTES, n)
                    found = np.flatnonzero((table[x.data[end:more]] == 0) | is_row[end:more])
                    end = end + int(found[0]) if len(found) else more
        d = x.data[pos:end]
        m = table[d] != 0
        first = m.copy()
        first[1:] &= ~m[:-1] | is_row[pos + 1 : end]
        s = np.flatnonzero(first)
        if len(s):
            last = m.copy()
            last[:-1] &= ~m[1:] | is_row[pos + 1 : end]
            e = np.flatnonzero(last)
            p, q = powers(len(d))
            v = key[d] * p
            c = np.cumsum(v, dtype=np.uint64)
            hs.append(mix((c[e] - c[s] + v[s]) * q[s] + (e - s).astype(np.uint64)))
            ss.append(s + pos)
            es.append(e + 1 + pos)
        pos = end
    if not hs:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, np.zeros(len(x.off), np.int64))
    s = np.concatenate(ss)
    return Words(np.concatenate(hs), s, np.concatenate(es), np.searchsorted(s, x.off, "left"))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that start at each place; rows are not told apart (see gram_rows)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    g = h[: len(h) - k + 1] * GRAM_KEYS[0]
    for j in range(1, k):
        g += h[j : len(h) - k + 1 + j] * GRAM_KEYS[j]
    return mix(g + U64(k))


def whole(off: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of the n - k + 1 places, which have k items that belong to one row."""
    if n < k:
        return np.zeros(0, bool)
    ok = np.zeros(n + 1, np.int32)
    lo, hi = off[:-1], np.maximum(off[1:] - k + 1, off[:-1])
    np.add.at(ok, lo, 1)
    np.add.at(ok, hi, -1)
    return np.cumsum(ok)[: n - k + 1] > 0


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    out, have = a, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def lists(values: pa.Array, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)


def lookup(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in sorted_values, or -1."""
    if not len(sorted_values) or not len(x):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[i] == x, i, -1)


class Filter:
    """A bit for each of 2^bits hash prefixes: a cheap test before the exact one."""

    def __init__(self, values: np.ndarray, bits: int = 20):
        self.shift = U64(64 - bits)
        self.bit = np.zeros(1 << bits, bool)
        self.bit[values >> self.shift] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.bit[x >> self.shift]
