"""Near duplicates by an inverted join of MinHash signatures.

1. Each text becomes the set of its distinct shingles, and each set a signature: the least value of its shingles under each of
   `coordinates` hash functions. Equal sets are one node, told by 128 bits. Two sets of Jaccard similarity j agree in a coordinate with
   probability j, so at the threshold fewer than `matches` coordinates agree with a probability of MISS at most.
2. Nodes are posted under (coordinate, value). All pairs that agree in `matches` of the coordinates share at least SHARED of the first
   coordinates - matches + SHARED postings of each, in any order common to all (the prefix). The order is by rising frequency
   of the posting, so that values of common lines and passages come last and are skipped.
3. Collisions are merged: pairs are counted under postings of up to LIGHT nodes, those with enough collisions in the prefix
   probe the coordinates that were skipped, and pairs with `matches` of all are retained. Under a posting of more nodes all are
   connected to one of them, unprobed, so its cost grows with its nodes and not with their pairs.
4. Connected candidates form clusters. Links are confirmed on the full sets within clusters (see set_links), so what a signature
   lets through wrongly is dropped.
5. Connected components of the links; the least id of each stays.

A link is missed with probability MISS at most, if no path of other links connects its ends.

Defined cases: null or wordless texts have no shingles, link with nothing and are their own component; a text of fewer words than
a shingle is one shingle, its whole sequence; repeated rows are copies, of one id if they repeat it; a null id takes part in links but names a component only
if all its ids are null; an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import jaccard_join as J
from . import set_links
from .components import components

U = np.uint64
#: Coordinates of a signature; the chance to miss a pair at the threshold; collisions that a pair has in the prefix at least.
COORDINATES, MISS, SHARED = 64, 1e-7, 3
_RNG = np.random.default_rng(20250113)
_TIMES, _PLUS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1), _RNG.integers(1, 2**63, 256, dtype=np.uint64)


def least_matches(coordinates: int, num: int, den: int, miss: float = MISS) -> int:
    """The most matches that all but a share of `miss` of pairs with similarity num / den have."""
    j, below = num / den, 0.0
    for m in range(coordinates + 1):
        below += comb(coordinates, m) * j**m * (1 - j) ** (coordinates - m)
        if below > miss:
            return max(1, m)
    return coordinates


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row a set, none of them empty: the least 32-bit value of its items under each hash function."""
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(((flat * _TIMES[k] + _PLUS[k]) >> U(32)).astype(np.uint32), first)
    return out


def digest(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    a = np.add.reduce(C.mix(s ^ C.GRAM_KEYS[50]), keepdims=True) + U(len(s))
    b = np.add.reduce(C.mix(s ^ C.GRAM_KEYS[51]) * (s | U(1)), keepdims=True)
    return np.concatenate([C.mix(a), C.mix(b)]).tobytes()


def _members(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """(id, n_shingles, digest, signature) of each row; the latter two are null without shingles."""

    def run(x: C.Texts) -> dict[str, pa.Array]:
        sets = list(J.shingle_sets(x, size))
        full = [i for i, s in enumerate(sets) if len(s)]
        digests, signed = [None] * len(sets), [None] * len(sets)
        if full:
            for i, s in zip(full, signatures([sets[i] for i in full], coordinates), strict=True):
                digests[i], signed[i] = digest(sets[i]), s.tobytes()
        return {"n_shingles": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array(digests, pa.binary()), "signature": pa.array(signed, pa.binary())}

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType())]
    return C.append_columns(docs, "text", fields, run, ["id"])


def _matrix(column: pa.Array, coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), coordinates)


def _keys(s: np.ndarray) -> np.ndarray:
    """A 64-bit key for each (coordinate, value)."""
    return C.mix(s.astype(np.uint64) * C.GRAM_KEYS[52] + (np.arange(s.shape[1]).astype(np.uint64) * C.GRAM_KEYS[53])[None, :])


def _frequencies(nodes: DataFrame, coordinates: int) -> np.ndarray:
    """How many postings fall into each of 2^SKETCH_BITS hash bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(1 << J.SKETCH_BITS, np.int64)
        for b in batches:
            if b.num_rows:
                bins += np.bincount((_keys(_matrix(b.column(0), coordinates)).ravel() >> U(64 - J.SKETCH_BITS)).astype(np.int64), minlength=len(bins))
        if bins.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([J._packed(bins)], pa.binary())], names=["task", "bins"])

    return J._frequencies(C.cut(nodes.select("signature").mapInArrow(run, "task long, bins binary"), "minhash-frequencies"))


def _postings(nodes: DataFrame, coordinates: int, prefix: int, shared: int, frequency: np.ndarray) -> DataFrame:
    """(key, node, needed): each node under the rarest of its postings."""
    known = nodes.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = _keys(_matrix(b.column(1), coordinates))
            rank = known.value[(keys >> U(64 - J.SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
            # equal frequencies by key, so that the order is the same for all
            first = np.lexsort((keys, rank), axis=1)[:, :prefix]
            k = np.take_along_axis(keys, first, 1).ravel()
            node = np.repeat(b.column(0).to_numpy(), first.shape[1])
            k, node, need = J._thinned(k, node, np.full(len(k), shared, np.int8))
            yield pa.RecordBatch.from_arrays([C.signed(k), pa.array(node), pa.array(need)], names=["key", "node", "needed"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long, needed byte")


def _retained(pairs: DataFrame, nodes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """Of pairs (a, b), those whose signatures agree in `matches` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = (_matrix(b.column(2), coordinates) == _matrix(b.column(3), coordinates)).sum(1) >= matches
                yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(same)) for i in range(2)], names=["a", "b"])

    of = lambda end: nodes.select(F.col("node").alias(end), F.col("signature").alias(f"s{end}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def candidates(nodes: DataFrame, coordinates: int, matches: int, shared: int = SHARED) -> DataFrame:
    """Edges (a, b) between nodes (node, signature) that agree in `matches` coordinates, or are connected by a posting of many nodes."""
    shared = min(shared, matches)
    rows = _postings(nodes, coordinates, coordinates - matches + shared, shared, _frequencies(nodes, coordinates))
    found = C.cut(J.collisions(rows), "minhash-collisions")
    # under a posting of many nodes one collision is all that is asked for
    hubs = found.where(F.col("needed") < shared).select("a", "b") if shared > 1 else found.select("a", "b")
    counted = found.where((F.col("needed") == shared) & (F.col("shared") >= shared)).select("a", "b")
    return hubs.unionByName(_retained(counted, nodes, coordinates, matches)) if shared > 1 else hubs


def _tokens(docs: DataFrame, clustered: DataFrame, size: int) -> DataFrame:
    """clustered (id, digest, ...) with `tokens`: the sets of their texts; an id that several texts bear is decided by the digest."""

    def run(x: C.Texts) -> dict[str, pa.Array]:
        sets = list(J.shingle_sets(x, size))
        return {"own": pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())}

    fields = [T.StructField("own", T.BinaryType()), T.StructField("tokens", T.BinaryType())]
    texts = docs.join(clustered.withColumnRenamed("id", "rep"), F.col("id").eqNullSafe(F.col("rep"))).drop("rep", "id")
    found = C.append_columns(texts, "text", fields, run, [c for c in texts.columns if c != "text"]).where("own = digest").drop("own")
    return found.groupBy("node").agg(*[F.first(c).alias(c) for c in found.columns if c != "node"])  # rows may repeat


def minhash_join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: tuple[int, int] = (80, 100), coordinates: int = COORDINATES, matches: int | None = None, block_tokens: int = set_links.BLOCK_TOKENS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of documents; kept: the row's id names its component."""
    t = J.Threshold(*threshold)
    matches = least_matches(coordinates, *threshold) if matches is None else matches
    docs = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    members = C.cut(_members(docs, size, coordinates), "minhash-members")
    alike = members.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    nodes = C.cut(alike.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    clusters = components(C.cut(candidates(nodes, coordinates, matches), "minhash-candidates"), "minhash-clusters")
    clustered = nodes.join(clusters, "node").select("id", "digest", "node", "n", F.col("comp").alias("cluster"))
    sets = C.cut(_tokens(docs, clustered, size).select("cluster", "node", "n", "tokens"), "minhash-sets")
    linked = set_links.connected(sets, t, "minhash-links", block_tokens)
    own = C.cut(nodes.select("digest", "node", "id", "copies").join(linked, "node", "left").withColumn("class", F.coalesce("comp", "node")).drop("comp"), "minhash-classes")
    names = C.cut(own.groupBy("class").agg(F.min("id").alias("component_id"), F.count("*").alias("size")).where("size > 1"), "minhash-names")
    named = C.cut(C.join_groups(own, names, "class", "size").select("digest", "copies", F.coalesce("component_id", "id").alias("component_id")), "minhash-named")
    out = C.join_groups(members.select("id", "n_shingles", "digest"), named, "digest", "copies").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13(spark, sf_dir: str) -> DataFrame:
    return minhash_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, threshold=(85, 100))
