"""Exact Jaccard join of documents on word shingles, by a token-group matrix.

1. Each text becomes the set of its distinct shingles (64-bit hashes); equal sets are one node.
2. Candidates: two sets at the threshold share `least` (4) of the first n - ceil(threshold * n) + least
   shingles of each, in any order common to all (all of a smaller set's, if it has too few). The order is by rising
   frequency, so that shingles of frequent lines and passages come last; frequencies are those of 2^SKETCH_BITS
   hash bins, counted over all rows and broadcast (8 MB at any input). On large tables bins blur, and frequent shingles get among
   the first: a first round counts the first shingles of all sets, twice as many as are needed, and those of over CROWDED sets come last
   in the second one (a table of 2^MARK_BITS bits, 8 MB at any input). Pairs of sets under a shingle of up to LIGHT sets are
   counted, and those that share enough shingles are candidates if their sizes and the counts of their shingles by hash bucket, which
   bound the overlap, allow a link; under a shingle of more, all are
   connected to one of them, so its cost grows with its sets and not their pairs. Connected candidates form clusters.
3. A cluster's sets are dealt into blocks of bounded size, by size and hash; pairs of blocks whose sizes can
   match are compared. In a task, sets that look alike form groups, the matrix of
   groups and tokens holds each group's token union, the overlap of a set with a union bounds its overlap with each
   member, and only groups whose bound reaches the threshold are opened: there
   the overlaps are counted exactly. No pair leaves a task: what leaves is each node's least linked node and how many documents it links with.
4. Connected components of these links.

The join is exact but for collisions of 64-bit hashes.

Defined cases: null or wordless texts have no shingles, link with nothing and are
their own component; a text of fewer words than a shingle is one shingle, its whole
sequence; repeated rows are copies that link with each other; a null id takes part in links but
names a component only if all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .components import components

TABLE = C.byte_table("space", lower=True)
#: Tokens of one block of a cluster (a set counts for LEAST_TOKENS at least, which bounds the sets), and sets in one group of the matrix.
BLOCK_TOKENS, LEAST_TOKENS, GROUP_SETS = 1_000_000, 500, 32
#: Rows that a task holds before it passes them on.
HELD_ROWS = 2_000_000
#: Shingles that candidates share at least; sets under a shingle up to which pairs are counted; bits of frequency bins.
LEAST_SHARED, LIGHT, SKETCH_BITS = 4, 64, 21
#: Sets from which a shingle among their first ones comes last; bits that mark such shingles, and bits that part them into groups.
CROWDED, MARK_BITS, PART_BITS = 16, 26, 12
#: Hash buckets of small and large sets, and shingles from which a set is large.
FEW_BUCKETS, MANY_BUCKETS, LARGE = 64, 256, 1000
U = np.uint64


class Threshold:
    """A link: den * |a & b| >= num * |a | b|."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def common(self, n):
        """Least overlap of a set of n with any set it links with."""
        return -(-self.num * n // self.den)

    def prefix(self, n):
        """How many of a set's first shingles hold `needed` ones of any set it links with."""
        return min(n, n - self.common(n) + LEAST_SHARED)

    def needed(self, n):
        return min(LEAST_SHARED, self.common(n))

    def links_others(self, n):
        """Whether a set of n can link with any but its equals: at best with one of a single shingle more."""
        return self.den * n >= self.num * (n + 1)


def shingle_sets(x: C.Texts, size: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, in order."""
    w = C.words(x, TABLE)
    g = C.grams(w.hash, size)
    for i in range(len(x)):
        lo, hi = int(w.off[i]), int(w.off[i + 1])
        if hi - lo >= size:
            yield np.unique(g[lo : hi - size + 1])
        elif hi > lo:
            yield C.grams(w.hash[lo:hi], hi - lo)
        else:
            yield np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> int:
    total = np.add.reduce(s * (s >> U(7) | U(1)), keepdims=True) + np.array([len(s)], np.uint64) * C.GRAM_KEYS[63]
    return int(C.mix(total).view(np.int64)[0])


def buckets(s: np.ndarray) -> bytes | None:
    """How many of a set's shingles are in each hash bucket, in a byte each; null where they don't fit."""
    n = np.bincount((s & U(MANY_BUCKETS - 1)).astype(np.int64), minlength=MANY_BUCKETS)
    if len(s) < LARGE:
        n = n.reshape(-1, FEW_BUCKETS).sum(0)  # the bucket by the lower bits of the hash
    return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def _members(documents: DataFrame, size: int) -> DataFrame:
    """(id, n_shingles, node, buckets, bins): a row each of documents (id, text), and one a task with the counts of hash bins and its number as n_shingles."""
    binary = [T.StructField("buckets", T.BinaryType()), T.StructField("bins", T.BinaryType())]
    schema = T.StructType([T.StructField("id", documents.schema["id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), *binary])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, kind = np.zeros(1 << SKETCH_BITS, np.int64), None
        for b in batches:
            kind = b.column(0).type
            for x in C.texts(b.column(1)):
                sets = list(shingle_sets(x, size))
                bins += np.bincount((np.concatenate(sets) >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x.lo, len(x)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.int64()), pa.array([buckets(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(len(x), pa.binary())], names=names)
        if kind is not None and bins.any():
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([task], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([_packed(bins)], pa.binary())], names=names)

    return documents.mapInArrow(run, schema)


def _packed(bins: np.ndarray) -> bytes:
    return np.minimum(bins, 2**32 - 1).astype("<u4").tobytes()


def _frequencies(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' bins (task, bins), by sixteens, so that no task gets more than a few."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for v in t["bins"]:
            total += np.frombuffer(v.as_buffer(), "<u4")
        return pa.table({"task": pa.array([key[0].as_py()], pa.int64()), "bins": pa.array([_packed(total)], pa.binary())})

    most = parts.agg(F.max("task")).first()[0]
    while most:
        parts = parts.withColumn("task", F.floor(F.col("task") / 16)).groupBy("task").applyInArrow(add, "task long, bins binary")
        most //= 16
    rows = parts.collect()  # one row of a fixed size
    return np.frombuffer(rows[0]["bins"], "<u4") if rows else np.zeros(1 << SKETCH_BITS, "<u4")


def _first_shingles(s: np.ndarray, t: Threshold, frequency: np.ndarray, marks: np.ndarray | None = None, times: int = 1) -> np.ndarray:
    """The set's rarest shingles, `times` as many as its prefix takes; marked ones last, equal frequencies by hash."""
    rank = frequency[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]
    if marks is not None:
        at = _mixed(s) >> np.uint32(32 - MARK_BITS)
        rank = rank + ((marks[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & np.uint8(1)).astype(np.int64) * 2**32
    return s[np.argsort(rank, kind="stable")[: times * t.prefix(len(s))]]


def _mixed(s: np.ndarray) -> np.ndarray:
    """32 bits of each shingle, others than those that name its frequency bin."""
    return (C.mix(s * C.GRAM_KEYS[43]) >> U(32)).astype(np.uint32)


def _crowded(documents: DataFrame, text_col: str, size: int, t: Threshold, frequency: np.ndarray) -> np.ndarray:
    """2^MARK_BITS bits, set for the shingles that more than CROWDED sets have among their first ones by frequency bins.

    Twice the prefix is counted: unless over half of it is marked, what moves up in place of marked shingles was counted too. Shingles are counted by 32 bits of their hash, in 2^PART_BITS groups; those that share a bit with a marked one count as marked.
    """
    shared = documents.sparkSession.sparkContext.broadcast(frequency)
    width = 1 << (MARK_BITS - PART_BITS)  # bits of a group

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seen, held = [], set(), 0

        def flush():
            x = np.sort(np.concatenate(firsts))
            part = x >> np.uint32(32 - PART_BITS)
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array([v.tobytes() for v in np.split(x, at[1:])], pa.binary())], names=["part", "items"])

        for b in batches:
            for x in C.texts(b.column(0)):
                for s in shingle_sets(x, size):
                    if t.links_others(len(s)) and (node := _digest(s)) not in seen:
                        seen.add(node)
                        firsts.append(_mixed(_first_shingles(s, t, shared.value, times=2)))
                        held += len(firsts[-1])
                if held >= HELD_ROWS:
                    yield flush()
                    firsts, seen, held = [], set(), 0
        if held:
            yield flush()

    def mark(key: tuple, rows: pa.Table) -> pa.Table:
        found, n = np.unique(np.concatenate([np.frombuffer(v.as_buffer(), np.uint32) for v in rows["items"]]), return_counts=True)
        bits = np.zeros(width, np.uint8)
        bits[(found[n > CROWDED] >> np.uint32(32 - MARK_BITS)) & np.uint32(width - 1)] = 1
        some = [key[0].as_py()] if bits.any() else []
        return pa.table({"part": pa.array(some, pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()] * len(some), pa.binary())})

    counted = documents.select(F.col(text_col).alias("text")).mapInArrow(emit, "part int, items binary").groupBy("part").applyInArrow(mark, "part int, bits binary")
    marks = np.zeros((1 << PART_BITS, width // 8), np.uint8)
    for r in counted.collect():  # 2^MARK_BITS bits at most
        marks[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return marks.ravel()


def _own_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key that stands for one edge."""
    return C.mix(a.view(np.uint64) * C.GRAM_KEYS[41] + b.view(np.uint64) * C.GRAM_KEYS[42])


def _thinned(key: np.ndarray, node: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with distinct nodes under each key. A key with more than LIGHT of them keeps one, marked by needed = 0; the others get an edge to it under a key of their own."""
    order = np.lexsort((node, key))
    key, node, needed = key[order], node[order], needed[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node, needed = key[once], node[once], needed[once]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    heavy = np.repeat(size > LIGHT, size)
    if not heavy.any():
        return key, node, needed
    hub = np.repeat(node[first], size)
    lead = np.zeros(len(key), bool)
    lead[first] = True
    needed = np.where(heavy & lead, 0, needed)
    pairs = np.unique(np.stack([node, hub], 1)[heavy & ~lead], axis=0)
    own, one = _own_key(pairs[:, 0], pairs[:, 1]), np.ones(len(pairs), needed.dtype)
    keep = ~heavy | lead
    return np.concatenate([key[keep], own, own]), np.concatenate([node[keep], pairs[:, 0], pairs[:, 1]]), np.concatenate([needed[keep], one, one])


def _pairs(key: np.ndarray, node: np.ndarray, needed: np.ndarray, hub: int | None) -> tuple[np.ndarray, ...]:
    """(a, b, shared, needed) of whole groups, sorted by key and node. hub: the first group goes on from one known to be large."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    marked = np.minimum.reduceat(needed, first) == 0
    large = (size > LIGHT) | marked
    if hub is not None:
        large[0] = True
    out = []
    for m in np.unique(size[~large]):
        if m > 1:
            at = first[(size == m) & ~large][:, None] + np.arange(m)[None, :]
            i, j = np.triu_indices(int(m), 1)
            out.append((node[at][:, i].ravel(), node[at][:, j].ravel(), np.ones(at.shape[0] * len(i), np.int64), np.minimum(needed[at][:, i], needed[at][:, j]).ravel().astype(np.int64)))
    if large.any():
        to = np.repeat(node[first], size)
        if hub is not None:
            to[: size[0]] = hub
        pick = np.repeat(large, size) & (node != to)
        out.append((to[pick], node[pick], np.ones(int(pick.sum()), np.int64), np.ones(int(pick.sum()), np.int64)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    a, b, n, need = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((b, a))
    a, b, n, need = a[order], b[order], n[order], need[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, int)
    return (a[at], b[at], np.add.reduceat(n, at), np.minimum.reduceat(need, at)) if len(at) else (a, b, n, need)


def _candidates(documents: DataFrame, text_col: str, size: int, t: Threshold, frequency: np.ndarray, marks: np.ndarray | None = None) -> DataFrame:
    """Edges (a, b, needed) between nodes that share enough of their first shingles, or one that is too frequent to count pairs under; there needed is 1."""
    shared, marked = (documents.sparkSession.sparkContext.broadcast(x) for x in (frequency, marks))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, needs, held = [], [], [], 0

        def flush():
            k, n, r = _thinned(np.concatenate(keys), np.concatenate(nodes), np.concatenate(needs))
            return pa.RecordBatch.from_arrays([C.signed(k), pa.array(n), pa.array(r)], names=["key", "node", "needed"])

        for b in batches:
            for x in C.texts(b.column(0)):
                for s in shingle_sets(x, size):
                    if t.links_others(len(s)):
                        keys.append(k := _first_shingles(s, t, shared.value, marked.value))
                        nodes.append(np.full(len(k), _digest(s)))
                        needs.append(np.full(len(k), t.needed(len(s)), np.int8))
                        held += len(k)
                if held >= HELD_ROWS:
                    yield flush()
                    keys, nodes, needs, held = [], [], [], 0
        if held:
            yield flush()

    rows = documents.select(F.col(text_col).alias("text")).mapInArrow(emit, "key long, node long, needed byte")
    return collisions(rows).where("shared >= needed").where("a <> b").select("a", "b", "needed")


def _can_link(t: Threshold, a: np.ndarray, b: np.ndarray, x: list[bytes | None], y: list[bytes | None]) -> np.ndarray:
    """Whether sets of sizes a and b can link, by size and by the least counts of their buckets."""
    ok = (t.den * np.minimum(a, b) >= t.num * np.maximum(a, b))
    for i in np.flatnonzero(ok):
        if x[i] is not None and y[i] is not None:
            u, v = np.frombuffer(x[i], np.uint8).astype(np.int64), np.frombuffer(y[i], np.uint8).astype(np.int64)
            if len(u) != len(v):
                u, v = (w.reshape(-1, FEW_BUCKETS).sum(0) for w in (u, v))
            most = int(np.minimum(u, v).sum())
            ok[i] = t.den * most >= t.num * (int(a[i]) + int(b[i]) - most)
    return ok


def _bounded(pairs: DataFrame, nodes: DataFrame, t: Threshold) -> DataFrame:
    """(a, b) of the pairs (a, b, needed) that can link by what is known of nodes (node, n, buckets); pairs under a frequent shingle (needed = 1) stay, as they stand for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = _can_link(t, b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_pylist(), b.column(5).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok)) for i in range(2)], names=["a", "b"])

    of = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("buckets").alias(f"of{end}"))
    known = pairs.where("needed > 1").select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "ofa", "ofb")
    return known.mapInArrow(run, "a long, b long").unionByName(pairs.where("needed = 1").select("a", "b"))


def collisions(rows: DataFrame) -> DataFrame:
    """(a, b, shared, needed) of the nodes that rows (key, node, needed) put under equal keys: how many they share and the least that was asked for, 1 under a key of many nodes."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # groups may go on in the next batch: the last one waits; of one known to be large, only its hub does
        rest: tuple[np.ndarray, ...] | None = None
        hub = None
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(3)]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
            key, node, needed = cols
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            if last == 0 and len(key) > LIGHT:  # one group only, and a large one
                hub = node[0] if hub is None else hub
                yield batch(_pairs(key, node, needed, hub))
                rest = (key[-1:], np.array([hub]), np.zeros(1, needed.dtype))
                continue
            if last:
                yield batch(_pairs(key[:last], node[:last], needed[:last], hub))
                hub = None
            rest = (key[last:], node[last:], needed[last:])
        if rest is not None and len(rest[0]):
            yield batch(_pairs(*rest, hub))

    def batch(c: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=["a", "b", "shared", "needed"])

    found = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(pair, "a long, b long, shared long, needed long")
    return found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("needed").alias("needed"))


def _sets(documents: DataFrame, text_col: str, size: int) -> DataFrame:
    """documents (with node and other columns) with `tokens`, only where the text's own set is the node."""

    def run(x: C.Texts) -> dict[str, pa.Array]:
        sets = list(shingle_sets(x, size))
        return {"own": pa.array([_digest(s) if len(s) else None for s in sets], pa.int64()), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())}

    fields = [T.StructField("own", T.LongType()), T.StructField("tokens", T.BinaryType())]
    return C.append_columns(documents, text_col, fields, run, [c for c in documents.columns if c != text_col]).where("own = node").drop("own")


def compare(sets: list[np.ndarray], side: np.ndarray, t: Threshold, group_sets: int = GROUP_SETS) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of sets, i < j; with two sides, only pairs across them."""
    r = len(sets)
    size = np.array([len(s) for s in sets])
    order = np.lexsort((size, np.array([s[0] for s in sets])))  # sets with the same least hash are likely alike: they stand side by side and form groups
    sets, size, side = [sets[i] for i in order], size[order], side[order]
    row = np.repeat(np.arange(r), size)
    tokens, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = n > 1  # a token of one set is in no overlap
    rank = np.cumsum(keep) - 1
    row, col = row[keep[col]], rank[col[keep[col]]]
    by = np.argsort(col, kind="stable")
    row, col, width = row[by], col[by], int(keep.sum())
    groups = [slice(i, min(i + group_sets, r)) for i in range(0, r, group_sets)]
    step = min(max(256, (8 << 20) // max(r, 1)), max(width, 1))
    edges = np.searchsorted(col, np.arange(0, width + step, step))

    def chunks():
        for c in range(len(edges) - 1):
            m = np.zeros((r, step), np.float32)
            at = slice(edges[c], edges[c + 1])
            m[row[at], col[at] - c * step] = 1
            yield m

    bound = np.zeros((r, len(groups)), np.float32)
    for m in chunks():
        union = np.stack([m[g].max(0) for g in groups])
        bound += m @ union.T
    least = np.array([size[g].min() for g in groups])
    most = np.array([size[g].max() for g in groups])
    # overlap that a link with a member needs: num * (|q| + |x|) / (num + den), |x| at its least
    small = np.maximum(-(-size[:, None] * t.num // t.den), least[None, :])
    need = -(-t.num * (size[:, None] + small) // (t.num + t.den))
    opened = (bound >= need) & (most[None, :] * t.den >= size[:, None] * t.num) & (least[None, :] * t.num <= size[:, None] * t.den)
    for k, g in enumerate(groups):
        opened[g.stop :, k] = False  # each pair once: from the set that stands no later than the group
    inter = {k: None for k in range(len(groups)) if opened[:, k].any()}
    queries = {k: np.flatnonzero(opened[:, k]) for k in inter}
    for m in chunks():
        for k in inter:
            part = m[queries[k]] @ m[groups[k]].T
            inter[k] = part if inter[k] is None else inter[k] + part
    ii, jj = [], []
    for k, both in inter.items():
        if both is None:
            continue
        q, x = queries[k], np.arange(groups[k].start, groups[k].stop)
        both = both.astype(np.int64)
        total = size[q][:, None] + size[x][None, :] - both
        hit = (t.den * both >= t.num * total) & (q[:, None] < x[None, :])
        a, b = np.nonzero(hit)
        ii.append(q[a])
        jj.append(x[b])
    if not ii:
        return np.zeros(0, int), np.zeros(0, int)
    i, j = np.concatenate(ii), np.concatenate(jj)
    if side.max() > 0:
        across = side[i] != side[j]
        i, j = i[across], j[across]
    i, j = order[i], order[j]
    return np.minimum(i, j), np.maximum(i, j)


def _least(r: int, i: np.ndarray, j: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Each item's least node among those linked with it, directly or not."""
    low = node.copy()
    while len(i):
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            break
        low = new
    return low


def _verify(t: Threshold):
    def task(table: pa.Table) -> pa.Table:
        node, at = np.unique(table["node"].to_numpy(), return_index=True)
        copies, side = table["copies"].to_numpy()[at], table["side"].to_numpy()[at]
        tokens = table["tokens"].combine_chunks()
        sets = [np.frombuffer(tokens[int(k)].as_buffer(), np.uint64) for k in at]
        i, j = compare(sets, side, t)
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        low = _least(len(node), i, j, node)
        return pa.table({"a": node, "b": low, "links": links})

    return task


def jaccard_join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, threshold: tuple[int, int] = (90, 100), block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, n_shingles, component_id, n_links) for each row of documents."""
    t = Threshold(*threshold)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    both = C.cut(_members(docs, size), "jaccard-members")
    members = both.where("bins is null").drop("bins", "buckets")
    frequency = _frequencies(both.where("bins is not null").select(F.col("n_shingles").alias("task"), "bins"))
    marks = _crowded(docs, "text", size, t, frequency)
    pairs = C.cut(_candidates(docs, "text", size, t, frequency, marks), "jaccard-pairs")
    alike = both.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
    clusters = components(C.cut(_bounded(pairs, alike, t), "jaccard-candidates"), "jaccard-clusters")
    nodes = members.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"))
    held = nodes.join(clusters, "node").withColumn("w", F.greatest("n", F.lit(LEAST_TOKENS))).withColumn("octave", F.floor(F.log("n") / math.log(t.den / t.num)).cast("int"))
    octaves = held.groupBy("comp", "octave").agg(F.ceil(F.sum("w") / block_tokens).cast("int").alias("blocks"))
    small = octaves.groupBy("comp").agg(F.collect_list(F.struct("octave", "blocks")).alias("octaves"), F.sum("blocks").alias("all"))
    held = C.cut(held, "jaccard-nodes")
    total = held.groupBy("comp").agg(F.sum("w").alias("tokens"))
    # a cluster of no more than a block is one task; of a larger one, each pair of blocks of the same or next octave
    plan = C.cut(small.join(total, "comp"), "jaccard-plan")
    near = F.filter("octaves", lambda o: F.abs(o["octave"] - F.col("octave")) <= 1)
    placed = held.join(plan, "comp").withColumn("block", F.when(F.col("tokens") <= block_tokens, F.struct(F.lit(0).alias("octave"), F.lit(0).cast("long").alias("k"))).otherwise(F.struct(F.col("octave"), F.pmod(F.xxhash64("node"), F.element_at(F.filter("octaves", lambda o: o["octave"] == F.col("octave")), 1)["blocks"]).alias("k"))))
    others = F.when(F.col("tokens") <= block_tokens, F.array(F.col("block"))).otherwise(F.flatten(F.transform(near, lambda o: F.transform(F.sequence(F.lit(0).cast("long"), o["blocks"].cast("long") - 1), lambda k: F.struct(o["octave"].alias("octave"), k.alias("k"))))))
    sent = placed.select("id", "node", "copies", "comp", "block", F.explode(others).alias("other")).select(
        "id", "node", "copies", "comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side")
    )
    texts = docs.join(sent.select(F.col("id").alias("rep"), "node").distinct(), F.col("id").eqNullSafe(F.col("rep"))).select("node", "text")
    tokens = _sets(texts, "text", size)
    work = sent.drop("id").join(tokens, "node")
    found = C.cut(work.groupBy("comp", "lo", "hi").applyInArrow(_verify(t), "a long, b long, links long"), "jaccard-links")
    linked = components(found.select("a", "b"), "jaccard-components")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    # classes are named by node; rows meet their node once, at the end, and a node of many copies is broadcast
    own = C.cut(nodes.select("node", "id", "copies").join(linked, "node", "left").join(counts, "node", "left").withColumn("class", F.coalesce("comp", "node")).drop("comp"), "jaccard-classes")
    names = C.cut(own.groupBy("class").agg(F.min("id").alias("component_id"), F.count("*").alias("size")).where("size > 1"), "jaccard-names")
    named = C.join_groups(own, names, "class", "size").select("node", "copies", F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = C.join_groups(members, C.cut(named, "jaccard-named"), "node", "copies")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def op8(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
