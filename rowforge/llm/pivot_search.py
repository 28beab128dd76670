"""Exact top-k by inner product with a pivot-distance index.

Inner products become distances by one more coordinate: with M the greatest norm, x gets
sqrt(M^2 - |x|^2) and q gets 0, so that |q - x|^2 = |q|^2 + M^2 - 2 q.x and the nearest are the highest.

Index: each vector's key is its nearest pivot and its distance to it; the table is
range-partitioned and sorted by that key, so a partition holds a few runs of one pivot, cut
into annuli of bounded size. Queries come in blocks of bounded size. A first pass
looks into the annuli nearest to a query's own key for k candidates; their k-th score
is a bound that only lets through what can still win. The second pass expands annuli outwards
from the query's distance to each pivot: |d(q, p) - d(x, p)| <= d(q, x), so once an
annulus is farther than the bound allows, so are all beyond it, and the search of that run stops.
A partition passes on no more than k rows a query. Pivots come from a bounded sample; every vector is indexed, and results are exact.

Components become floor(64 x). Scores are exact integers: products in double
precision where a bound on norms keeps sums below 2^53, in Python integers otherwise.

Defined cases: vectors that are null or hold a null or non-finite component take no part;
shorter vectors count as zero beyond their end; ties go to the smaller id; a query never meets the rows of its own id;
repeated rows are candidates each; a score that no long holds is an error; with fewer candidates than k, all are returned; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

K, SCALE = 20, 64
#: Rows sampled for pivots, pivots, rows of one annulus, bytes of one broadcast block of queries, blocks of one job, and queries scored at once.
SAMPLE_ROWS, PIVOTS, ANNULUS_ROWS, QUERY_BYTES, TOGETHER, STEP = 4096, 64, 512, 8 << 20, 4, 4096
KEY = ["pivot", "dist", "vec_id"]
FOUND = "b int, q long, query_id long, vec_id long, score long"
EXACT = 2.0**52


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def scaled(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("double"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, filled with zeros up to dim."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), dim))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)] = flat
    return out


class Index:
    """What all tasks know of the index: pivots with their extra coordinate, the greatest norm."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.most2 = most * most
        self.pivots = self.lift(pivots)
        self.dim = pivots.shape[1]

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.most2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From lifted vectors to each pivot."""
        d = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(d, 0))

    def from_query(self, q: np.ndarray) -> np.ndarray:
        return self.distances(np.concatenate([q, np.zeros((len(q), 1))], 1))

    def reach(self, qn: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How far a vector may be from a query of squared norm qn to score `bound` at least; with what rounding of three distances may take away."""
        whole = qn + self.most2
        return np.sqrt(np.maximum(whole - 2 * bound, 0)) * (1 + 1e-9) + 1e-6 + 4 * np.sqrt(np.finfo(float).eps * (self.dim + 8) * whole)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if np.sqrt((q * q).sum(1).max(initial=0) * (x * x).sum(1).max(initial=0)) < EXACT and np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < EXACT:
        return q @ x.T
    qi, xi = [[int(v) for v in r] for r in q], [[int(v) for v in r] for r in x]
    return np.array([[sum(a * b for a, b in zip(r, s, strict=True)) for s in xi] for r in qi], object)


class _Best:
    """Each query's k best (score, id) so far, ties to the smaller id, and what a score must reach to enter."""

    def __init__(self, k: int, own: np.ndarray, start: np.ndarray):
        self.k, self.own, self.bound = k, own, start.copy()
        self.score, self.id = [np.zeros((0,)) for _ in own], [np.zeros(0, np.int64) for _ in own]

    def add(self, rows: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Hold queries `rows` against vectors x; only queries that gain something cost more than the product."""
        for lo in range(0, len(rows), STEP):
            part = rows[lo : lo + STEP]
            scores = _scores(q[part], x)
            hit = (scores >= self.bound[part][:, None]).astype(bool) & (ids[None, :] != self.own[part][:, None])
            for i in np.flatnonzero(hit.any(1)):
                r, at = part[i], np.flatnonzero(hit[i])
                s, d = np.concatenate([self.score[r], scores[i, at]]), np.concatenate([self.id[r], ids[at]])
                top = np.lexsort((d, -s))[: self.k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], d[j]))[: self.k])
                self.score[r], self.id[r] = s[top], d[top]
                if len(top) == self.k:
                    self.bound[r] = max(self.bound[r], np.nextafter(float(s[top[-1]]), -np.inf))


def _search(index: Index, k: int, annulus: int, b: int, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, near_only: bool):
    """Over one partition, sorted by pivot and distance: rows (block, query place, query id, vec id, score)."""
    to = index.from_query(q)
    qn = (q * q).sum(1)
    own_pivot = to.argmin(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k, ids, floor)
        for batch in batches:
            pivot, dist, vid = (batch.column(i).to_numpy() for i in range(3))
            if not len(pivot):
                continue
            x = _matrix(batch.column(3), index.dim)
            for lo, hi in _pieces(pivot):
                p = int(pivot[lo])
                rings = [slice(i, min(i + annulus, hi)) for i in range(lo, hi, annulus)]
                inner, outer = np.array([dist[r].min() for r in rings]), np.array([dist[r].max() for r in rings])
                live = np.flatnonzero(own_pivot == p) if near_only else np.arange(len(q))
                # how far each ring is from each query at least, by the triangle inequality
                gap = np.maximum(np.maximum(inner[None, :] - to[live, p : p + 1], to[live, p : p + 1] - outer[None, :]), 0)
                if near_only:
                    close = gap.argmin(1)
                    for j in np.unique(close):
                        best.add(live[close == j], q, vid[rings[j]], x[rings[j]])
                    continue
                # rings in order of their distance from the query's sphere; the first that is too far ends the run
                step = np.argsort(gap, axis=1, kind="stable")
                for turn in range(len(rings)):
                    live = live[gap[live, step[live, turn]] <= index.reach(qn[live], best.bound[live])]
                    if not len(live):
                        break
                    for j in np.unique(step[live, turn]):
                        best.add(live[step[live, turn] == j], q, vid[rings[j]], x[rings[j]])
        n = [len(s) for s in best.score]
        if sum(n):
            place = np.repeat(np.arange(len(q)), n)
            scores = pa.array([int(s) for r in best.score for s in r], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), b, np.int32)), pa.array(place), pa.array(ids[place]), pa.array(np.concatenate(best.id)), scores], names=["b", "q", "query_id", "vec_id", "score"])

    return run


def _pieces(pivot: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(pivot)) + 1
    return list(zip(np.append(0, cut), np.append(cut, len(pivot)), strict=True))


def build(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, pivots: int = PIVOTS) -> tuple[Index | None, DataFrame]:
    """The index and its table (pivot, dist, vec_id, v), range-partitioned and sorted by pivot and distance. vectors: vec_id, v."""
    ends = vectors.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("n2")).first()
    if ends["dim"] is None:
        return None, vectors
    dim = max(ends["dim"], 1)
    few = vectors.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample_rows).collect()  # a bounded sample, for pivots only
    pool = np.zeros((len(few), dim))
    for i, r in enumerate(few):
        pool[i, : len(r["v"])] = r["v"]
    chosen = [0]
    far = ((pool - pool[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(pool)) and far.max() > 0:  # each next pivot is the farthest from those chosen
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((pool - pool[chosen[-1]]) ** 2).sum(1))
    index = Index(pool[chosen], float(np.sqrt(ends["n2"])))
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table = _keyed(index, vectors, False).repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY)
    return index, C.cut(table, "pivot-index")


def _keyed(index: Index, vectors: DataFrame, queries: bool) -> DataFrame:
    """(pivot, dist, vec_id, v): the nearest pivot of each vector, or of each query, and its distance."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), shared.value.dim)
                d = shared.value.from_query(x) if queries else shared.value.distances(shared.value.lift(x))
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near]), b.column(0), b.column(1)], names=[*KEY, "v"])

    return vectors.select("vec_id", "v").mapInArrow(key, "pivot int, dist double, vec_id long, v array<double>")


def _blocks(index: Index, queries: DataFrame, block: int) -> list[DataFrame]:
    """queries (vec_id, v) in blocks of about `block` rows that lie close to one another: ranges of their own keys, so that a block needs few parts of the index."""
    count = queries.count()
    if count <= block:
        return [queries] if count else []
    ranged = _keyed(index, queries, True).repartitionByRange(-(-count // block), *KEY)
    part = C.cut(ranged.withColumn("block", F.spark_partition_id()), "pivot-queries", ["block"])
    out = []
    for r in part.groupBy("block").count().orderBy("block").collect():  # a number a block
        rows, pieces = part.where(F.col("block") == r["block"]), -(-r["count"] // block)
        out += [rows.where(F.pmod(F.xxhash64("vec_id", F.lit("piece")), F.lit(pieces)) == i) if pieces > 1 else rows for i in range(pieces)]
    return out


def _within(index: Index, q: np.ndarray, bound: np.ndarray) -> Column:
    """The keys that can still hold a result of some query: an interval of distances a pivot, which the scan takes as its filter."""
    to, far = index.from_query(q), index.reach((q * q).sum(1), bound)[:, None]
    low, high = (to - far).min(0), (to + far).max(0)
    if np.isinf(high).any():
        return F.lit(True)
    return reduce(lambda a, b: a | b, [(F.col("pivot") == p) & F.col("dist").between(float(low[p]), float(high[p])) for p in range(len(low))])


def top_k(index: Index | None, table: DataFrame, queries: DataFrame, k: int = K, block: int | None = None, annulus: int = ANNULUS_ROWS, together: int = TOGETHER) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (vec_id, v), in blocks of `block` queries (as many as make QUERY_BYTES), `together` blocks a job."""
    spark = table.sparkSession
    blocks = [] if index is None else _blocks(index, queries, block or max(1, QUERY_BYTES // (8 * index.dim)))
    order = Window.partitionBy("b", "q").orderBy(F.col("score").desc(), "vec_id")
    out = []
    for at in range(0, len(blocks), together):
        got = [(ids, q) for ids, q in (_rows(index, b) for b in blocks[at : at + together]) if len(ids)]
        if not got:
            continue
        sent = [spark.sparkContext.broadcast((index, ids, q, np.full(len(ids), -np.inf))) for ids, q in got]
        near = [F.col("pivot").isin([int(p) for p in np.unique(index.from_query(q).argmin(1))]) for _, q in got]
        first = _union([table.where(w).mapInArrow(_task(s, k, annulus, b, True), FOUND) for b, (s, w) in enumerate(zip(sent, near, strict=True))])
        bound = [np.full(len(ids), -np.inf) for ids, _ in got]
        for r in first.groupBy("b", "q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k).select("b", "q", F.element_at("s", k).alias("s")).collect():  # a number a query of these blocks
            bound[r["b"]][r["q"]] = np.nextafter(float(r["s"]), -np.inf)
        for s in sent:
            s.unpersist()
        sent = [spark.sparkContext.broadcast((index, ids, q, f)) for (ids, q), f in zip(got, bound, strict=True)]
        found = _union([table.where(_within(index, q, f)).mapInArrow(_task(s, k, annulus, b, False), FOUND) for b, (s, (_, q), f) in enumerate(zip(sent, got, bound, strict=True))])
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if len(blocks) <= together:
            return best
        out.append(C.cut(best, "pivot-found"))
        for s in sent:
            s.unpersist()
    return _union(out) if out else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _rows(index: Index, block: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = block.select("vec_id", "v").orderBy("vec_id").toArrow()
    return got["vec_id"].to_numpy(), _matrix(got["v"], index.dim) if got.num_rows else np.zeros((0, index.dim))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _task(shared, k: int, annulus: int, b: int, near_only: bool):
    def run(batches):
        index, ids, q, floor = shared.value
        yield from _search(index, k, annulus, b, ids, q, floor, near_only)(batches)

    return run


def op2(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding"))).select("vec_id", scaled(F.col("embedding")).alias("v"))
    index, table = build(rows)
    return top_k(index, table, rows.where("vec_id % 20 = 0"))
