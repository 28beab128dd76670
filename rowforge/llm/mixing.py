"""Mixing sources to target weights, in DataFrame functions only.

Each document gets a hash-random key; within each source, documents stand in
the order of their keys. A source's budget in words is spent on whole passes
over it (epochs) and then on documents in that order up to the exact budget:
the cut point is found by distributed prefix sums of word counts (see prefix),
so a source that holds most rows costs no task more than any other.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; documents of size 0 give 0 words; sources of size 0 have target 0;
documents with equal keys stand by doc_id, then size; equal rows are
interchangeable; very long texts count as any other, and a document never gives more than max_epochs times its words;
an empty table gives an empty mix; mixed_documents carries a row as one value, so its columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .prefix import weighted_cuts

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
KEY_BITS = 30


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size) with weight and target, for a total of share x all sizes.

    No target is above max_epochs x its source's size; what others leave is shared by
    weight. With sources by max_epochs * size / weight, the first that isn't full gives the level.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("double"))
    most = F.col("source_size") * F.lit(max_epochs).cast("long")
    order = Window.orderBy(most / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share))).withColumn(
        "__level", (F.col("total") - F.coalesce(F.sum(most).over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    open_ = level.withColumn("__level", F.first(F.when(most >= F.col("__level") * F.col("weight"), F.col("__level")), ignorenulls=True).over(whole))
    return open_.withColumn("target", F.coalesce(F.least(most.cast("double"), F.col("__level") * F.col("weight")), most.cast("double"))).select("source", "source_size", "weight", "target")


def keyed(docs: DataFrame, id_col: str, source_col: str, size: Column, seed: str = SEED) -> DataFrame:
    """docs with __source (never null), __size and the hash-random __key and its first bits __k."""
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    return docs.withColumns({"__source": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")), "__size": size, "__key": key, "__k": F.shiftrightunsigned(key, 64 - KEY_BITS)})


def cut_points(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """For each __source: source_size, target, epochs taken whole, words left for the last one, and where it ends."""
    sizes = rows.groupBy("__source").agg(F.sum("__size").alias("source_size")).select(F.when(F.col("__source") != "n", F.substring("__source", 2, 1 << 30)).alias("source"), "source_size")
    plan = targets(sizes, weights, share, max_epochs).select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__source"), "source_size", "target")
    words = F.round("target").cast("long")
    plan = C.cut(plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", words - F.col("epochs") * F.col("source_size")), "mix-plan")
    cuts = weighted_cuts(rows, "__source", "__k", "__size", plan.where("rest > 0").select("__source", "rest"), KEY_BITS, "mix-cut")
    return C.cut(plan.join(cuts.select("__source", "at", "before"), "__source", "left"), "mix-cuts")


def mix(rows: DataFrame, cuts: DataFrame, id_col: str) -> DataFrame:
    """rows with source_size, target and taken: the words that the mix takes of each, repeats counted."""
    both = rows.join(cuts, "__source", "left")
    at_cut = F.coalesce(F.col("__k") == F.col("at"), F.lit(False))
    part = F.when(F.col("__k") < F.col("at"), F.col("__size")).otherwise(F.lit(0).cast("long"))
    easy = both.where(~at_cut).withColumn("__part", part)
    # the few rows whose key bits are those of the cut stand in their full order
    run = F.sum("__size").over(Window.partitionBy("__source").orderBy("__key", id_col, "__size").rowsBetween(Window.unboundedPreceding, 0))
    hard = both.where(at_cut).withColumn("__run", run).withColumn("__part", F.greatest(F.lit(0).cast("long"), F.least(F.col("__size"), F.col("rest") - F.col("before") - (F.col("__run") - F.col("__size"))))).drop("__run")
    return easy.unionByName(hard).withColumn("taken", F.col("epochs") * F.col("__size") + F.col("__part"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole; the one at a source's cut comes if at least half of it is within the budget."""
    whole = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = keyed(whole, "id", "source", F.col("size")).drop("source", "size")
    narrow = C.cut(rows.select("__source", "__size", "__k"), "mix-sizes")
    taken = mix(rows, cut_points(narrow, weights, share, max_epochs), "id")
    copies = F.col("epochs") + F.when(F.col("__part") * 2 >= F.greatest(F.col("__size"), F.lit(1)), 1).otherwise(0)
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("__row.*")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = C.cut(keyed(docs, "doc_id", "source", F.col("size")).select("doc_id", "__source", "__size", "__key", "__k"), "mix-rows")
    return mix(rows, cut_points(rows), "doc_id").select("doc_id", F.col("__size").alias("size"), "source_size", "target", "taken")
