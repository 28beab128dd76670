"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): comp is the least node that can be reached.

    Each round takes the least label of all neighbours and then the label of that
    label; sums are combined before the shuffle, so a hub costs no task more than
    others. Rounds end when no label changes, after about the logarithm of the longest path. A round's table is
    deleted once the next one stands.

    Defined cases: loops (a = b) and repeated edges count for nothing, so a node with loops only has no row; edges with a
    null end join nothing; equal labels can't be; an empty table gives no rows; other columns are passed over.
    """
    both = C.cut(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), f"{name}-edges")
    labels = C.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), f"{name}-labels")
    table = None  # the one that labels are read from, where that isn't labels itself
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = step.join(labels.select(F.col("node").alias("low"), F.col("comp").alias("far")), "low", "left")
        new = C.cut(jump.select("node", F.least("low", F.coalesce("far", "low")).alias("comp"), (F.least("low", F.coalesce("far", "low")) < F.col("comp")).alias("moved")), f"{name}-labels")
        done = new.where("moved").isEmpty()
        C.free(labels if table is None else table)
        labels, table = new.select("node", "comp"), new
        if done:
            C.free(both)
            return labels
