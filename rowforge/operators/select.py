"""Deduplication, attempt selection, sampling and splits.

Orders are total: ties end in an id, so results don't depend on partitioning. Ranks run
over hashes of ids, so samples can be repeated anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.functions.hashing import namespaced_key, rank_key


def _w(*by: str):
    return Window.partitionBy(*by)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(_w(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def keep_best(df: DataFrame, key: str, line: str, is_error: Column) -> DataFrame:
    """An answer beats an error, a later row beats an equal one; first_line tells where the key was first seen."""
    w = _w(key)
    return (
        df.withColumn("first_line", F.min(line).over(w))
        .withColumn("__r", F.row_number().over(w.orderBy(is_error.cast("int"), F.col(line).desc())))
        .where("__r = 1").drop("__r")
    )


def latest_success(df: DataFrame, key: str, attempt: str, success: Column) -> DataFrame:
    """The last successful attempt, else the last one."""
    return df.withColumn("__r", F.row_number().over(_w(key).orderBy(success.cast("int").desc(), F.col(attempt).desc()))).where("__r = 1").drop("__r")


def explicit_attempt(df: DataFrame, key: str, attempt: str, wanted: int) -> DataFrame:
    """Exactly the wanted attempt of each key; a key with none or several is an error."""
    counted = df.withColumn("__n", F.count_if(F.col(attempt) == wanted).over(_w(key)))
    error = F.raise_error(F.concat(F.lit("attempts of "), F.col(key).cast("string"), F.lit(": "), F.col("__n").cast("string"))).cast("boolean")
    return counted.where(F.when(F.col("__n") != 1, error).otherwise(F.col(attempt) == wanted)).drop("__n")


def drifted(df: DataFrame, key: str, fingerprint: Column) -> DataFrame:
    """Keys whose definition differs between rows."""
    return df.groupBy(key).agg(F.count_distinct(fingerprint).alias("definitions")).where("definitions > 1")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def first_shard_wins(df: DataFrame, keys: list[str], shard: str) -> DataFrame:
    """Of each key, all rows of its first shard."""
    return df.withColumn("__s", F.min(shard).over(_w(*keys))).where(F.col(shard) == F.col("__s")).drop("__s")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, above: Column | None = None) -> DataFrame:
    """The first k rows of each key, with their rank."""
    src = df if above is None else df.where(above)
    return src.withColumn("rank", F.row_number().over(_w(*keys).orderBy(*order))).where(F.col("rank") <= k)


def coverage_sample(df: DataFrame, identity: str, group: str, rate: float, seed: int) -> DataFrame:
    """ceil(rate x size) rows of each group by hash rank, one at least."""
    if not 0 < rate <= 1:
        raise ValueError(f"rate must be in (0, 1]: {rate}")
    w = _w(group)
    n = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * F.lit(rate)))
    return df.withColumn("__n", n).withColumn("__r", F.row_number().over(w.orderBy(rank_key(seed, identity), identity))).where("__r <= __n").drop("__r", "__n")


def exact_stratified(df: DataFrame, identity: str, group: str, size: int, seed: int) -> DataFrame:
    """One row of each group, then others by a second hash until there are `size` (A19). Ids are distinct; no task holds a group or the sample."""
    least = F.min(F.struct(rank_key(seed, identity).alias("k"), F.col(identity).alias("i")))
    first = df.groupBy(group).agg(least.alias("m")).select(F.col("m.i").alias(identity), F.lit("0").alias("__one"))
    marked = df.join(first, identity, "left").select(*df.columns, F.coalesce("__one", F.lit("1")).alias("__one"))
    digest = F.concat("__one", namespaced_key(seed, "fill", identity))
    return global_rank(marked, digest, [identity], "__rank").where(F.col("__rank") <= size).select(*df.columns)


def group_fraction(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """All rows of the first round-half-up(fraction x keys) keys by hash."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    wanted = math.floor(keys.count() * fraction + 0.5)
    return df.join(global_rank(keys, namespaced_key(seed, "group", key), [key]).where(F.col("rank") <= wanted), key, "left_semi")


def group_split(df: DataFrame, key: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """Keys in hash order are dealt to splits of given numbers of keys; rows of later keys get no split."""
    # ranks come from counts by hash prefix, so no task sorts all keys
    ranked = global_rank(df.select(key).where(F.col(key).isNotNull()).distinct(), namespaced_key(seed, "split", key), [key])
    split, lo = F.lit(None).cast("string"), 0
    for name, n in sizes.items():
        split = F.when((F.col("rank") > lo) & (F.col("rank") <= lo + n), F.lit(name)).otherwise(split)
        lo += n
    return df.join(ranked.select(key, split.alias("split")), key, "left")


def global_rank(df: DataFrame, digest: Column, ties: list[str], out: str = "rank") -> DataFrame:
    """1, 2, 3 ... in the order of a hex digest: offsets of 4096 prefixes, then ranks within each."""
    rows = df.withColumn("__d", digest).withColumn("__p", F.substring("__d", 1, 3))
    counts = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    offsets = counts.withColumn("__from", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n"))  # 4096 rows at most
    inside = F.row_number().over(_w("__p").orderBy("__d", *ties))
    return rows.withColumn("__i", inside).join(F.broadcast(offsets), "__p").withColumn(out, F.col("__from") + F.col("__i")).drop("__d", "__p", "__n", "__from", "__i")


def ordered_rank(df: DataFrame, order: list[str], out: str = "rank", bins: int | None = None) -> DataFrame:
    """1, 2, 3 ... in the order of columns, nulls first: ranges between `bins` rows chosen by hash, their offsets, then ranks within each.

    Any bounds give the same ranks; they only decide how evenly tasks share the rows. By default there is one for a million rows, 64 at least and 1,024 at most.
    """
    bins = max(64, min(1024, df.count() // 1_000_000)) if bins is None else bins
    few = df.select(*order).distinct().orderBy(F.xxhash64(*order), *order).limit(bins).collect()
    types = {f.name: f.dataType for f in df.schema.fields}
    row = F.struct(*order)
    bound = [F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in order]) for r in few]
    rows = df.withColumn("__p", F.size(F.filter(F.array(*bound), lambda b: b <= row)) if bound else F.lit(0))
    counts = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    offsets = counts.withColumn("__from", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n"))  # a row a range
    inside = F.row_number().over(_w("__p").orderBy(*order))
    return rows.withColumn("__i", inside).join(F.broadcast(offsets), "__p").withColumn(out, F.col("__from") + F.col("__i")).drop("__p", "__n", "__from", "__i")


def stratified_split(df: DataFrame, identity: str, stratum: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """Rows in the order of a hash over seed, stratum and id are dealt to splits of exact sizes."""
    digest = F.sha2(F.concat(F.lit(f"split:{seed}:"), F.col(stratum).cast("string"), F.lit(":"), F.col(identity).cast("string")), 256)
    ranked = global_rank(df, digest, [identity])
    split, lo = F.lit(None).cast("string"), 0
    for name, n in sizes.items():
        split = F.when((F.col("rank") > lo) & (F.col("rank") <= lo + n), F.lit(name)).otherwise(split)
        lo += n
    return ranked.withColumn("split", split)


def frozen_split(df: DataFrame, identity: str, lists: DataFrame) -> DataFrame:
    """df with the split that lists (identity, split) give; repeated, unknown or uncovered ids are an error."""
    bad = lists.groupBy(identity).count().where("count > 1").limit(1).count()
    missing = lists.join(df, identity, "left_anti").limit(1).count()
    open_ = df.join(lists, identity, "left_anti").limit(1).count()
    if bad or missing or open_:
        raise ValueError(f"split lists: repeated {bad}, unknown {missing}, uncovered {open_}")
    return df.join(lists, identity)


def split_summary(df: DataFrame, split: str, family: Column, flags: list[str]) -> DataFrame:
    """Rows, families and whether all flags hold, by split."""
    return df.groupBy(split).agg(F.count("*").alias("n"), F.count_distinct(family).alias("families"), *[F.bool_and(f).alias(f"all_{f}") for f in flags])


def seeded_sample(df: DataFrame, identity: str, k: int, seed: int, offset: int = 0) -> DataFrame:
    """k rows in hash order, from an offset on (A25); ranks by hash prefix, so no task holds the sample."""
    ranked = global_rank(df, rank_key(seed, identity), [identity], "__rank")
    return ranked.where((F.col("__rank") > offset) & (F.col("__rank") <= offset + k)).select(*df.columns)


def ratio_mix(parts: dict[str, DataFrame], anchor: str, ratios: dict[str, float], identity: str, seed: int) -> DataFrame:
    """All of the anchor, and of each other part ratio x its rows, by hash; ranks by hash prefix, so no task holds a part."""
    n = parts[anchor].count()
    out = parts[anchor].withColumn("part", F.lit(anchor))
    for name, df in parts.items():
        if name != anchor:
            ranked = global_rank(df, rank_key(seed, identity), [identity], "__rank")
            kept = ranked.where(F.col("__rank") <= math.floor(n * ratios[name] + 0.5)).drop("__rank")
            out = out.unionByName(kept.withColumn("part", F.lit(name)), allowMissingColumns=True)
    return out


def quota_per_image(df: DataFrame, image: str, kind: str, identity: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """One row an image: of kinds in the order of their quotas, then by hash; no more than the quota of each kind."""
    order = F.array_position(F.array(*[F.lit(k) for k in quotas]), F.col(kind))
    one = keep_first(df.where(F.col(kind).isin(*quotas)), [image], [order, rank_key(seed, identity), F.col(identity)])
    most = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(kind))
    return top_per_key(one.withColumn("__most", most), [kind], [rank_key(seed, identity), F.col(identity)], max(quotas.values())).where(F.col("rank") <= F.col("__most")).drop("rank", "__most")


def balanced_fold(df: DataFrame, image: str, kind: str, most_rows: int = 100_000) -> DataFrame:
    """One row an image, of the kind used least so far, images in order; ties rotate by image.

    The choice depends on all before it, so this runs in one task and refuses more rows than `most_rows`.
    """
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"a sequential fold takes no more than {most_rows} rows; use quota_per_image")
    schema = df.schema

    def fold(rows):
        used: dict = {}
        keep = []
        for i, (_, part) in enumerate(rows.sort_values([image, kind]).groupby(image, sort=True)):
            kinds = sorted(part[kind].unique())
            kinds = kinds[i % len(kinds) :] + kinds[: i % len(kinds)]
            best = min(kinds, key=lambda k: used.get(k, 0))
            used[best] = used.get(best, 0) + 1
            keep.append(part[part[kind] == best].index[0])
        return rows.loc[keep]

    return df.groupBy(F.lit(0).alias("__all")).applyInPandas(fold, schema)
