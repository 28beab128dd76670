"""Distributed weighted cuts and gapless numbering, without a task that sees a whole group.

A cut point is found from the most significant bits down: weights are summed by
(group, next bits), the prefix sums over these few sums tell in which bin the
cut lies, and only that bin's rows are looked at again. Sums are combined
before they are shuffled, so that a group of any size costs each task no more
than the bins.

Defined cases, in all functions: rows with a null group, order or weight take no part in a cut; groups without rows, or lighter than
what is asked of them, have no cut; equal orders stand together at a cut (`here` says how much weight they have); repeated rows weigh
each; an empty table gives no cuts and no numbers; columns other than those named are passed over or carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

STEP_BITS = 10


def weighted_cuts(rows: DataFrame, group: str, order: str, weight: str, rest: DataFrame, bits: int, name: str) -> DataFrame:
    """For each row (group, rest) of `rest`, the value of `order` at which the running weight passes rest.

    rows: group, order (an integer of `bits` bits), weight (long). Returns group,
    rest, at, before (weight below `at`) and here (weight at `at`): before <= rest < before + here.
    A group whose whole weight is no more than rest has no row.
    """
    found = rest.select(group, "rest", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before"))
    done = 0
    while done < bits:
        step = min(STEP_BITS, bits - done)
        done += step
        down = bits - done
        part = rows.select(group, F.col(order).alias("__k"), F.col(weight).alias("__w")).join(found.select(group, "at"), group)
        sums = part.where(F.shiftright("__k", down + step) == F.col("at")).groupBy(group, F.shiftright("__k", down).alias("bin")).agg(F.sum("__w").alias("here"))
        run = F.sum("here").over(Window.partitionBy(group).orderBy("bin"))
        ranked = sums.withColumn("upto", run).join(found.drop("at", "here"), group)
        found = C.cut(
            ranked.where((F.col("before") + F.col("upto") > F.col("rest")) & (F.col("before") + F.col("upto") - F.col("here") <= F.col("rest"))).select(
                group, "rest", F.col("bin").alias("at"), (F.col("before") + F.col("upto") - F.col("here")).alias("before"), "here"
            ),
            name,
        )
    return found


def literal_cuts(rows: DataFrame, group: str, order: str, weight: str, rest: dict[int, int], bits: int, step_bits: int = 14) -> dict[int, tuple[int, int, int]]:
    """weighted_cuts for few groups: {group: (at, before, here)}, with what is known of a group as literals, so no row is shuffled by its group.

    A step sums weights by (group, next bits) of all groups in one pass; combined before the shuffle, they are 2^step_bits rows a group at most.
    """
    found = {g: (0, 0, 0) for g in rest}
    done = 0
    while done < bits and found:
        step = min(step_bits, bits - done)
        done += step
        down = bits - done
        known = lambda i, found=found: F.element_at(F.create_map(*[F.lit(x).cast("long") for g, v in found.items() for x in (g, v[i])]), F.col(group))
        wanted = F.element_at(F.create_map(*[F.lit(x).cast("long") for g, n in rest.items() for x in (g, n)]), F.col(group))
        open_ = rows.where(F.col(group).isin(list(found)))
        sums = open_.where(F.shiftright(order, down + step) == known(0)).groupBy(group, F.shiftright(order, down).alias("bin")).agg(F.sum(weight).alias("here"))
        upto = F.sum("here").over(Window.partitionBy(group).orderBy("bin")) + known(1)
        hit = sums.withColumn("upto", upto).withColumn("rest", wanted).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("here") <= F.col("rest")))
        found = {r[group]: (r["bin"], r["upto"] - r["here"], r["here"]) for r in hit.collect()}  # a row a group
    return found


def dense_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, rank): 1, 2, 3 ... over the distinct values that aren't null, in their order, without a task that sees them all."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    dealt = C.cut(values.repartitionByRange(column).withColumn("__part", F.spark_partition_id()), name)
    offsets = dealt.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__from", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")  # a row a partition
    place = F.row_number().over(Window.partitionBy("__part").orderBy(column))
    return C.cut(dealt.withColumn("__place", place).join(F.broadcast(offsets), "__part").select(column, (F.col("__place") + F.col("__from")).alias("rank")), name)


def numbered(df: DataFrame, group: str, key: Column, order: list[Column], out: str, per_bin: int = 50_000) -> DataFrame:
    """df with `out`: 0, 1, 2 ... within each group, by bins of a hash of `key`, then by `order`.

    df must be cheap to read twice and give the same rows (a table).
    """
    n = df.count()
    bins = max(1, -(-n // per_bin))
    binned = df.withColumn("__bin", F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(bins)))
    counts = binned.groupBy(group, "__bin").agg(F.count("*").alias("__n"))
    offsets = C.cut(counts.withColumn("__from", F.sum("__n").over(Window.partitionBy(group).orderBy("__bin")) - F.col("__n")).drop("__n"), "slot-offsets")
    place = F.row_number().over(Window.partitionBy(group, "__bin").orderBy(*order)) - 1
    return binned.withColumn("__place", place).join(offsets, [group, "__bin"]).withColumn(out, F.col("__place") + F.col("__from")).drop("__bin", "__place", "__from")
