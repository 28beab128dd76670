"""Connected components of similar sets within clusters of candidates, without comparing all pairs of a large group.

Which sets link is decided on the sets themselves, but of a group of near copies not every link is needed: as soon as two sets are
connected, it makes no difference to the components whether they link as well.

1. The sets of a cluster are dealt into blocks of bounded size, by size and hash. A cluster of one block is compared in one task, and is done.
2. In a larger one, each block is compared by itself; of each component found, its least node goes on as its representative. Representatives
   are dealt and compared in the same way, again and again until they get no fewer. A group of near copies of any size
   comes down to few representatives after about the logarithm of its blocks.
3. Sets outside the largest component that a cluster has by then are compared with all sets of the cluster, block by block. A link that
   isn't known yet has an end outside that component, so none is lost.

Tasks pass on labels (a node and the least node it is connected with), never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .jaccard_join import Threshold, compare

#: Tokens of one block of a cluster; a set counts for LEAST_TOKENS at least, which bounds the sets.
BLOCK_TOKENS, LEAST_TOKENS = 1_000_000, 500
#: Representatives go on as long as a round leaves no more than this share of them.
SHRINKS = 0.8


def labels(r: int, i: np.ndarray, j: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Of r items, each one's least node among those connected with it by links (i, j)."""
    low = node.copy()
    while len(i):
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            break
        low = new
    return low


def _octave(n: str, t: Threshold) -> Column:
    """Sizes of linked sets are in the same or neighbouring octaves."""
    return F.floor(F.log(n) / math.log(t.den / t.num)).cast("int")


def _plan(rows: DataFrame, block_tokens: int, name: str) -> DataFrame:
    """(cluster, size, blocks, and for each octave of sizes how many blocks it has); a cluster no larger than a block has one octave."""
    weight = F.greatest("n", F.lit(LEAST_TOKENS))
    octaves = rows.groupBy("cluster", "octave").agg(F.sum(weight).alias("w"), F.count("*").alias("size"))
    whole = octaves.groupBy("cluster").agg(F.sum("size").alias("size"), F.sum("w").alias("w"), F.collect_list(F.struct("octave", F.ceil(F.col("w") / block_tokens).cast("int").alias("blocks"))).alias("octaves"))
    one = F.array(F.struct(F.lit(0).alias("octave"), F.lit(1).alias("blocks")))
    octaves = F.when(F.col("w") <= block_tokens, one).otherwise(F.col("octaves"))
    return C.cut(whole.select("cluster", "size", (F.col("w") <= block_tokens).alias("alone"), octaves.alias("octaves")), name)


def _block(octaves: Column, alone: Column) -> Column:
    """The block of a row, of those of its octave."""
    own = F.element_at(F.filter(octaves, lambda o: o["octave"] == F.col("octave")), 1)["blocks"]
    return F.when(alone, F.struct(F.lit(0).alias("octave"), F.lit(0).cast("long").alias("k"))).otherwise(F.struct(F.col("octave"), F.pmod(F.xxhash64("node"), own).alias("k")))


def _near(octaves: Column, alone: Column) -> Column:
    """All blocks whose sets may link with a row's."""
    near = F.filter(octaves, lambda o: alone | (F.abs(o["octave"] - F.col("octave")) <= 1))
    return F.flatten(F.transform(near, lambda o: F.transform(F.sequence(F.lit(0).cast("long"), o["blocks"].cast("long") - 1), lambda k: F.struct(o["octave"].alias("octave"), k.alias("k")))))


def _arrays(tokens: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint64) for v in tokens.combine_chunks()]


def _within(t: Threshold):
    """Labels of one block's sets; the tokens of representatives go along where the cluster has other blocks."""

    def task(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        i, j = compare(_arrays(table["tokens"]), np.zeros(len(node), int), t)
        low = labels(len(node), i, j, node)
        goes = (low == node) & ~table["alone"].to_numpy()
        tokens = pa.compute.if_else(pa.array(goes), table["tokens"].combine_chunks(), pa.nulls(len(node), pa.binary()))
        return pa.table({"cluster": table["cluster"], "node": node, "label": low, "n": table["n"], "tokens": tokens})

    return task


def _across(t: Threshold):
    """Labels of the sets of two blocks that link across them; a set may be in both."""

    def task(table: pa.Table) -> pa.Table:
        node, side = table["node"].to_numpy(), table["side"].to_numpy().astype(int)
        i, j = compare(_arrays(table["tokens"]), side, t)
        low = labels(len(node), i, j, node)
        return pa.table({"a": node[low < node], "b": low[low < node]})

    return task


def connected(sets: DataFrame, t: Threshold, name: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(node, comp) of the nodes that link with another one of their cluster.

    sets: a table of cluster, node (long), n and tokens (n sorted 64-bit hashes, at least one); a node has one row.
    Defined cases: sets without tokens aren't allowed; a null cluster isn't either; an empty table gives no rows.
    """
    sets = sets.withColumn("octave", _octave("n", t))
    rows, edges, many = sets, [], None
    while True:
        plan = _plan(rows, block_tokens, f"{name}-plan")
        placed = C.join_groups(rows, plan, "cluster", "size", "inner").withColumn("block", _block(F.col("octaves"), F.col("alone")))
        done = C.cut(placed.select("cluster", "block", "node", "n", "alone", "tokens").groupBy("cluster", "block").applyInArrow(_within(t), "cluster long, node long, label long, n long, tokens binary"), f"{name}-blocks")
        edges.append(done.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
        if many is None:
            many = plan.where("NOT alone")
        here, left = rows.count(), done.where("tokens IS NOT NULL").count()
        if not left or (len(edges) > 1 and left > SHRINKS * here):
            break
        rows = C.cut(done.where("tokens IS NOT NULL").select("cluster", "node", "n", "tokens", _octave("n", t).alias("octave")), f"{name}-representatives")
    found = edges[0] if len(edges) == 1 else C.cut(_all(edges), f"{name}-edges")
    if many.isEmpty():
        return components(found, name)
    return components(found.unionByName(_rest(sets, many, components(found, f"{name}-first"), t, name, block_tokens)), name)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def _rest(sets: DataFrame, many: DataFrame, comps: DataFrame, t: Threshold, name: str, block_tokens: int) -> DataFrame:
    """Edges of the sets outside the largest component of a cluster of several blocks."""
    known = C.join_groups(C.cut(sets.drop("tokens"), f"{name}-slim"), many.select("cluster", "size"), "cluster", "size", "inner")
    own = C.cut(known.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), f"{name}-known")
    sizes = own.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    most = C.cut(sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.sum("n").alias("size")), f"{name}-largest")
    outside = C.cut(C.join_groups(own, most, "cluster", "size", "inner").where("comp <> most").select("cluster", "node", "n", "octave"), f"{name}-outside")
    asked = _plan(outside, block_tokens, f"{name}-asked").select("cluster", F.col("alone").alias("ask_alone"), F.col("octaves").alias("ask"))
    both = C.cut(many.join(asked, "cluster"), f"{name}-pairs")
    held = C.cut(sets.join(outside.select("node", F.lit(1).alias("out")), "node", "left"), f"{name}-held")
    placed = C.join_groups(held, both, "cluster", "size", "inner")
    block, ask = _block(F.col("octaves"), F.col("alone")), _block(F.col("ask"), F.col("ask_alone"))
    all_near, ask_near = _near(F.col("octaves"), F.col("alone")), _near(F.col("ask"), F.col("ask_alone"))
    every = placed.select("cluster", "node", "tokens", F.lit(1).alias("side"), block.alias("block"), F.explode(ask_near).alias("ask"))
    asking = placed.where("out = 1").select("cluster", "node", "tokens", F.lit(0).alias("side"), F.explode(all_near).alias("block"), ask.alias("ask"))
    pairs = every.unionByName(asking)
    return C.cut(pairs.groupBy("cluster", "block", "ask").applyInArrow(_across(t), "a long, b long"), f"{name}-rest")
