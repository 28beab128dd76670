"""Sharding by a k-d tree over document metadata.

The tree starts with all documents and splits a node at the weighted median of
its widest metadata dimension until the leaves hold the target bytes; one leaf is
one shard. Dimensions are the bytes of the text and the ranks of source and language among their
distinct values, each scaled by its extent over the whole table. The target is given in bytes or as a number of
shards; a node that is to hold several shards splits in proportion to their numbers.

Medians are distributed (see prefix.literal_cuts): each pass sums weights by bin for all nodes of a level, splits known so far are
literals in the plan, and what is collected is one row a node. Ranks are found by ranges and joined back.

Equal texts are one unit with the metadata of their first member, and the order in
a dimension goes on by text hash, so they stay in one shard; only a group heavier than
1 / `pieces_per_leaf` of a shard is dealt out, in pieces of that weight, since
it could not be balanced otherwise. A unit at the median goes to the side that leaves sizes nearer.

Defined cases: a null text has size 1 (no bytes, plus 1); null source or language stands
before all others; repeated rows are members of one group; rows that share one id are numbered in one bin; fewer units than shards leave shards
empty; an empty table gives no rows; columns that bear the names used here are carried by the caller in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .prefix import dense_ranks, literal_cuts, numbered

SHARDS, PIECES_PER_LEAF = 8, 32
DIMENSIONS = ("x_size", "x_source", "x_lang")
GRID_BITS, HASH_BITS, PIECE_BITS = 24, 20, 10
ORDER_BITS = GRID_BITS + HASH_BITS + PIECE_BITS


GROUP = ["__h", "__crc", "size"]


@dataclass
class Tree:
    """Extents of the dimensions, the groups whose members don't place themselves, and each level's splits: node -> (dimension, first order value of the right side)."""

    ends: dict
    groups: DataFrame
    levels: list[dict[int, tuple[str, int]]]
    names: dict[int, int]


def _groups(docs: DataFrame, shards: int, pieces_per_leaf: int) -> DataFrame:
    """Groups of equal texts whose metadata differ, or which are too heavy to stay whole: the metadata of all, and the number of pieces."""
    total, rows = docs.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    piece = max(1, total // (shards * pieces_per_leaf))
    many = max(C.LARGE_ROWS, rows // C.LARGE_KEYS)  # no more than LARGE_KEYS groups have more rows than this
    groups = docs.groupBy(*GROUP).agg(F.count("*").alias("__n"), *[F.min(d).alias(f"__{d}") for d in DIMENSIONS], *[F.max(d).alias(f"__most_{d}") for d in DIMENSIONS]).where("__n > 1")
    groups = groups.withColumn("__pieces", F.least(F.lit(1 << PIECE_BITS), F.ceil(F.col("__n") * F.col("size") / piece)))
    differ = reduce(lambda x, y: x | y, [F.col(f"__{d}") != F.col(f"__most_{d}") for d in DIMENSIONS])
    return C.cut(groups.where(differ | (F.col("__pieces") > 1)).select(*GROUP, "__pieces", (F.col("__n") > many).alias("__many"), *[f"__{d}" for d in DIMENSIONS]), "kd-groups")


def _ordered(docs: DataFrame, groups: DataFrame, ends: dict | None) -> tuple[DataFrame, dict]:
    """docs with their order in each dimension, __k_<dimension>: its grid, then text hash, then piece."""
    # rows of large groups get what is known of them by broadcast; in the join of the others they are spread by their salt
    known = ["__pieces", *[f"__{d}" for d in DIMENSIONS]]
    large = groups.where("__many").select(*GROUP, F.struct(*known).alias("__large"))
    small = groups.where("NOT __many").select(*GROUP, F.lit(0).cast("long").alias("__s"), F.struct(*known).alias("__small"))
    rows = docs.join(F.broadcast(large), GROUP, "left").withColumn("__s", F.when(F.col("__large").isNotNull(), F.xxhash64("__salt")).otherwise(0))
    rows = rows.join(small, [*GROUP, "__s"], "left").withColumn("__known", F.coalesce("__large", "__small"))
    rows = rows.withColumns({"__pieces": F.col("__known.__pieces"), **{d: F.coalesce(F.col(f"__known.__{d}"), d) for d in DIMENSIONS}}).drop("__large", "__small", "__known", "__s")
    if ends is None:
        ends = rows.agg(*[F.min(d).alias(f"lo_{d}") for d in DIMENSIONS], *[F.max(d).alias(f"hi_{d}") for d in DIMENSIONS]).first().asDict()
    piece = F.when(F.col("__pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("__salt"), F.col("__pieces")))
    low = F.shiftrightunsigned("__h", 64 - HASH_BITS) * (1 << PIECE_BITS) + piece
    for d in DIMENSIONS:
        lo, hi = ends[f"lo_{d}"], ends[f"hi_{d}"]
        unit = (F.col(d) - lo) / (hi - lo) if lo is not None and hi > lo else F.lit(0.0)
        rows = rows.withColumn(f"__k_{d}", F.floor(unit * ((1 << GRID_BITS) - 1)) * (1 << (HASH_BITS + PIECE_BITS)) + low)
    return rows.drop("__pieces"), ends


def _descend(rows: DataFrame, levels: list[dict[int, tuple[str, int]]]) -> DataFrame:
    """rows with __node after the given levels; a node that a level doesn't split goes left."""
    node = F.lit(0).cast("long")
    for level in levels:
        rows = rows.withColumn("__node", node)
        side = F.lit(False)
        for d in DIMENSIONS:
            cuts = {n: at for n, (dim, at) in level.items() if dim == d}
            if cuts:
                at = F.try_element_at(F.create_map(*[F.lit(x).cast("long") for kv in cuts.items() for x in kv]), F.col("__node"))
                side = F.when(at.isNotNull(), F.col(f"__k_{d}") >= at).otherwise(side)
        rows = rows.withColumn("__node", F.col("__node") * 2 + side.cast("long"))
        node = F.col("__node")
    return rows.withColumn("__node", node)


def plan(docs: DataFrame, shards: int | None = SHARDS, pieces_per_leaf: int = PIECES_PER_LEAF, target_bytes: int | None = None) -> Tree:
    """The tree of docs: size (long), __h (text hash), __crc, __salt (row identity), x_size, x_source, x_lang (double); a cheap table, read several times a level.

    target_bytes: what a leaf may hold, instead of a number of shards.
    """
    if target_bytes is not None:
        total = docs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        shards = max(1, -(-total // target_bytes))
    groups = _groups(docs, shards, pieces_per_leaf)
    rows, ends = _ordered(docs, groups, None)
    rows = C.cut(rows.select("size", *[f"__k_{d}" for d in DIMENSIONS]), "kd-rows")
    leaves, levels = {0: (0, shards)}, []  # node: its first shard and how many it will have
    while any(n > 1 for _, n in leaves.values()):
        at = _descend(rows, levels)
        grid = [F.shiftright(f"__k_{d}", HASH_BITS + PIECE_BITS) for d in DIMENSIONS]
        stats = at.groupBy("__node").agg(F.sum("size").alias("w"), *[(F.max(g) - F.min(g)).alias(d) for g, d in zip(grid, DIMENSIONS, strict=True)]).collect()  # a row a node
        open_ = {r["__node"]: (max(DIMENSIONS, key=lambda d, r=r: r[d]), r["w"] * (leaves[r["__node"]][1] // 2) // leaves[r["__node"]][1]) for r in stats if leaves[r["__node"]][1] > 1}
        order = F.lit(None).cast("long")
        for d in DIMENSIONS:
            own = [n for n, (dim, _) in open_.items() if dim == d]
            order = F.when(F.col("__node").isin(own), F.col(f"__k_{d}")).otherwise(order) if own else order
        cuts = literal_cuts(at.select("__node", order.alias("__o"), "size").where("__o is not null"), "__node", "__o", "size", {n: r for n, (_, r) in open_.items()}, ORDER_BITS)
        # what stands at the cut goes left if that leaves the left side nearer to its share
        levels.append({n: (open_[n][0], c + 1 if before + here - open_[n][1] < open_[n][1] - before else c) for n, (c, before, here) in cuts.items()})
        leaves = {k: v for n, (a, m) in leaves.items() for k, v in (((2 * n, (a, m // 2)), (2 * n + 1, (a + m // 2, m - m // 2))) if m > 1 else ((2 * n, (a, m)),))}
    return Tree(ends, groups, levels, {n: a for n, (a, _) in leaves.items()})


def place(docs: DataFrame, tree: Tree) -> DataFrame:
    """docs with `shard`, without a shuffle of them unless the groups that need one are many."""
    rows, _ = _ordered(docs, tree.groups, tree.ends)
    shard = F.element_at(F.create_map(*[x for n, a in tree.names.items() for x in (F.lit(n).cast("long"), F.lit(a))]), F.col("__node"))
    return _descend(rows, tree.levels).withColumn("shard", shard).drop("__node", *[f"__k_{d}" for d in DIMENSIONS])


def kd_shards(docs: DataFrame, shards: int = SHARDS, pieces_per_leaf: int = PIECES_PER_LEAF) -> DataFrame:
    """docs (as plan reads them) with `shard`."""
    return place(docs, plan(docs, shards, pieces_per_leaf))


def described(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """docs with the columns that kd_shards reads."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    df = docs.withColumns({"size": size, "__h": F.xxhash64(text), "__crc": F.crc32(text), "__salt": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "x_size": F.log2(size)})
    for d, c in (("x_source", source_col), ("x_lang", lang_col)):
        # as many rows as there are values: broadcast if they are few, else a join that can be split at a frequent value
        ranks = dense_ranks(docs.select(F.col(c).cast("string").alias("__v")), "__v", f"kd-{d}").withColumnRenamed("rank", d)
        df = df.join(ranks, F.col(c).cast("string") == F.col("__v"), "left").drop("__v").withColumn(d, F.coalesce(F.col(d).cast("double"), F.lit(0.0)))
    return df


def op4(spark, sf_dir: str) -> DataFrame:
    docs = described(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "__h", "__crc", "__salt", *DIMENSIONS)
    placed = C.cut(kd_shards(C.cut(docs, "kd-docs")).select("doc_id", "size", F.col("__crc").alias("text_crc32"), "shard"), "kd-shards")
    out = numbered(placed, "shard", F.col("doc_id"), [F.col("doc_id"), F.col("text_crc32")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
