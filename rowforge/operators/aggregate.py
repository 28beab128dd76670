"""Grouped summaries, ranking and agreement statistics, advantages, gates."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.tables import written

ratio = F.try_divide
#: Share of a group on either side of a percentile that is put in order.
NEAR = 0.005


#: Rows up to which what is known of groups is sent to all tasks.
FEW_GROUPS = 100_000


def few(groups: DataFrame) -> DataFrame:
    """A table of groups, to be joined to many rows: broadcast if it is short, so that rows of a large group stay where they are."""
    return F.broadcast(groups) if groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else groups


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def grouped_accuracy(df: DataFrame, by: list[str], correct: Column | str, scoreable: Column | None = None) -> DataFrame:
    """n, scoreable, correct and accuracy (null over nothing) (A1)."""
    c = _c(correct)
    s = c.isNotNull() if scoreable is None else scoreable
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(s).alias("scoreable"), F.count_if(s & c.cast("boolean")).alias("correct"), ratio(F.count_if(s & c.cast("boolean")), F.count_if(s)).alias("accuracy"))


def roll_up(groups: DataFrame, by: list[str]) -> DataFrame:
    """Micro accuracy, and macro over the groups that have one (A2)."""
    return groups.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("scoreable").alias("scoreable"), F.sum("correct").alias("correct"), ratio(F.sum("correct"), F.sum("scoreable")).alias("micro"), F.avg("accuracy").alias("macro"), F.count("accuracy").alias("groups"))


def box_metrics(df: DataFrame, by: list[str], iou: str, valid: str) -> DataFrame:
    """Mean IoU, shares at .5 and .7, and format validity."""
    share = lambda cond: F.avg(cond.cast("double"))
    return df.where(F.col(iou).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(iou).alias("mean_iou"), share(F.col(iou) >= 0.25).alias("acc_25"), share(F.col(iou) >= 0.5).alias("acc_50"), share(F.col(iou) >= 0.7).alias("acc_70"), share(F.col(valid)).alias("format_validity"))


def letter_distribution(df: DataFrame, labels: str) -> DataFrame:
    return df.select(F.explode(labels).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))


def count_table(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """Rows, and rows that meet each condition."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def efficiency(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Mean, interpolated median, nearest-rank 95th percentile, sum, maximum (A8); null without values.

    Percentiles are exact: approximate ones beside them cut a group into five ranges, all are counted, and only a range that
    holds a wanted rank is put in order, as counts of its values. So no task holds a group, whatever its size.
    """
    key = F.struct(*[F.col(c) for c in by], F.lit(0).alias("__")).alias("__g")  # null groups meet as structs
    cuts = F.percentile_approx(x, [0.5 - NEAR, 0.5 + NEAR, 0.95 - NEAR, 0.95 + NEAR], 1000)
    whole = written(df.groupBy(key).agg(F.avg(x).alias("mean"), F.sum(x).alias("total"), F.max(x).alias("most"), F.count(x).alias("__n"), cuts.alias("__cuts")), "efficiency")
    middle = (F.col("__n") - 1) * 0.5
    ranks = {"__lo": F.floor(middle) + 1, "__hi": F.ceil(middle) + 1, "__r95": F.ceil(F.col("__n") * F.lit(0.95))}
    bounds = whole.select("__g", *[F.col("__cuts")[i].alias(f"__e{i}") for i in range(4)], *[r.cast("long").alias(k) for k, r in ranks.items()])
    v = F.col("__x")
    at = reduce(lambda a, b: a + b, [c.cast("int") for c in (v >= F.col("__e0"), v > F.col("__e1"), v >= F.col("__e2"), v > F.col("__e3"))])
    rows = df.where(F.col(x).isNotNull()).select(key, F.col(x).alias("__x")).join(few(bounds), "__g").withColumn("__bin", at)
    bins = rows.groupBy("__g", "__bin", *ranks).agg(F.count("*").alias("__size"))
    bins = bins.withColumn("__from", F.sum("__size").over(Window.partitionBy("__g").orderBy("__bin")) - F.col("__size"))  # five rows a group
    wanted = reduce(lambda a, b: a | b, [(F.col(r) > F.col("__from")) & (F.col(r) <= F.col("__from") + F.col("__size")) for r in ranks])
    held = rows.select("__g", "__bin", "__x").join(few(written(bins.where(wanted), "efficiency-bins")), ["__g", "__bin"]).groupBy("__g", "__bin", "__from", "__x", *ranks).agg(F.count("*").alias("__c"))
    upto = F.col("__from") + F.sum("__c").over(Window.partitionBy("__g", "__bin").orderBy("__x"))
    found = held.withColumn("__upto", upto).groupBy("__g").agg(*[F.min(F.when(F.col("__upto") >= F.col(r), F.col("__x"))).alias(r) for r in ranks])
    lo, hi = F.col("__lo").cast("double"), F.col("__hi").cast("double")
    share = middle - F.floor(middle)
    p50 = F.when(F.col("__lo") == F.col("__hi"), lo).otherwise((1 - share) * lo + share * hi)
    return whole.join(found, "__g", "left").select(*[F.col("__g")[c].alias(c) for c in by], "mean", p50.alias("p50"), F.col("__r95").alias("p95"), "total", "most")


def category_accuracy(df: DataFrame, category: str, correct: str) -> DataFrame:
    """By category and by what stands before its slash."""
    one = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    top = df.groupBy(F.substring_index(category, "/", 1).alias("category")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return one.withColumn("level", F.lit("category")).unionByName(top.withColumn("level", F.lit("super")))


def yes_no_confusion(df: DataFrame, by: list[str], truth: str, answer: str) -> DataFrame:
    """TP, FP, FN, TN, precision, recall, F1, and the share of yes in the truth (A10)."""
    t, a = F.col(truth) == "yes", F.col(answer) == "yes"
    n = df.groupBy(*by).agg(F.count_if(t & a).alias("tp"), F.count_if(~t & a).alias("fp"), F.count_if(t & ~a).alias("fn"), F.count_if(~t & ~a).alias("tn"), F.avg(t.cast("double")).alias("yes_ratio"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)})


def fixed_category_mean(df: DataFrame, category: str, correct: str, categories: list[str]) -> DataFrame:
    """Mean accuracy over a fixed list of categories, 0 for one without rows."""
    acc = [F.coalesce(F.avg(F.when(F.col(category) == c, F.col(correct).cast("double"))), F.lit(0.0)) for c in categories]
    return df.agg(*[a.alias(c) for a, c in zip(acc, categories, strict=True)], (sum(acc[1:], acc[0]) / len(acc)).alias("mean"))


def average_precision(df: DataFrame, by: list[str], score: str, hit: str, truths: Column, ties: list[str], bins: int = 64) -> DataFrame:
    """Single-class AP: precision at each hit by falling score, over the number of truths.

    A group's rows are ranked in ranges of its scores, after counts of the ranges before them, so no task ranks a group; equal scores share a range.
    Null scores come last.
    """
    key = F.struct(*[F.col(c) for c in by], F.lit(0).alias("__")).alias("__g")  # null groups meet as structs
    whole = written(df.groupBy(key).agg(F.percentile_approx(score, [i / bins for i in range(1, bins)], 1000).alias("__cuts"), F.count_if(F.col(hit)).alias("hits"), truths.alias("truths")), "precision")
    below = F.when(F.col(score).isNull(), bins).otherwise(F.size(F.filter(F.array_distinct("__cuts"), lambda e: e > F.col(score))))
    rows = df.select(key, score, F.col(hit).alias("__h"), *ties).join(few(whole.select("__g", "__cuts")), "__g").withColumn("__bin", below).drop("__cuts")
    counts = rows.groupBy("__g", "__bin").agg(F.count("*").alias("__n"), F.count_if(F.col("__h")).alias("__k"))
    before = Window.partitionBy("__g").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = counts.select("__g", "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__k0"))
    w = Window.partitionBy("__g", "__bin").orderBy(F.col(score).desc(), *ties)
    at = rows.withColumns({"__n": F.row_number().over(w), "__k": F.sum(F.col("__h").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))}).where(F.col("__h"))
    sums = at.join(few(written(offsets, "precision-ranges")), ["__g", "__bin"]).groupBy("__g").agg(F.sum((F.col("__k0") + F.col("__k")) / (F.col("__n0") + F.col("__n"))).alias("precision_sum"))
    out = whole.join(sums, "__g", "left").select(*[F.col("__g")[c].alias(c) for c in by], F.coalesce("precision_sum", F.lit(0.0)).alias("precision_sum"), "hits", "truths")
    return out.withColumn("ap", ratio(F.col("precision_sum"), F.col("truths")))


#: Chances that a row counts at most 0, 1, ... 7 times in a repeat (Poisson with mean 1).
_POISSON = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(8)]


def bootstrap_ci(df: DataFrame, by: list[str], value: str, identity: str, repeats: int = 1000, linear: bool = False, seed: int = 7) -> DataFrame:
    """Mean with a 95 % interval by Poisson bootstrap: each row's weight in each repeat is a hash of its id and the repeat.

    Each task adds up its rows' weights and weighted values of all repeats in arrays, some rows at a time, and passes on one array a group, so
    what is shuffled grows with tasks and groups and not with rows times repeats.
    """
    import numpy as np
    import pyarrow as pa

    edges, step = np.array(_POISSON), max(1, 2_000_000 // repeats)
    key = F.struct(*[F.col(c) for c in by], F.lit(0).alias("__")).alias("__g")
    rows = df.where(F.col(value).isNotNull()).select(F.to_json(key).alias("__k"), F.xxhash64(F.lit(seed), identity).alias("__h"), F.col(value).cast("double").alias("__v"))

    def sums(batches):
        turn = (np.arange(repeats, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        held: dict = {}
        for b in batches:
            coded = b.column(0).dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            h, v = b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            for k in range(len(names)):
                mine = np.flatnonzero(code == k)
                for lo in range(0, len(mine), step):
                    at = mine[lo : lo + step]
                    x = h[at, None] ^ turn[None, :]
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    w = np.searchsorted(edges, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), "right").astype(float)
                    total = held.setdefault(names[k], np.zeros((2, repeats)))
                    total += np.stack([w.sum(0), v[at] @ w])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([t[0].tolist() for t in held.values()], pa.list_(pa.float64())), pa.array([t[1].tolist() for t in held.values()], pa.list_(pa.float64()))], names=["__k", "w", "wv"])

    parts = rows.mapInArrow(sums, "__k string, w array<double>, wv array<double>").select("__k", F.posexplode(F.arrays_zip("w", "wv")).alias("repeat", "x"))
    means = parts.groupBy("__k", "repeat").agg(ratio(F.sum("x.wv"), F.sum("x.w")).alias("m"))
    sorted_ = F.array_sort(F.collect_list("m"))
    if linear:
        lo, hi = F.percentile("m", 0.025), F.percentile("m", 0.975)
    else:
        lo = F.element_at(sorted_, F.greatest(F.lit(1), F.floor(F.lit(0.025) * F.count("m")).cast("int") + 1))
        hi = F.element_at(sorted_, F.least(F.count("m").cast("int"), F.floor(F.lit(0.975) * F.count("m")).cast("int") + 1))
    ci = means.groupBy("__k").agg(lo.alias("low"), hi.alias("high"))
    mean = df.groupBy(*by, F.to_json(key).alias("__k")).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count(value).alias("n"))
    return mean.join(ci, "__k", "left" if by else "inner").drop("__k")


def chi2_tail(chi2: Column) -> Column:
    """The chance of a chi-squared value with one degree of freedom of that size or more, to the last digit; a row a group passes through Python."""
    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        return v.map(lambda x: math.erfc(math.sqrt(x / 2)) if x > 0 else 1.0)

    return tail(chi2)


def mcnemar(df: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """Pairs that changed, the statistic with continuity correction and its p-value."""
    b, a = F.col(before).cast("boolean"), F.col(after).cast("boolean")
    n = df.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if(~b & a).alias("gained"), F.count_if(b & ~a).alias("lost"), F.avg(a.cast("double") - b.cast("double")).alias("delta"))
    d = F.greatest(F.abs(F.col("gained") - F.col("lost")) - 1, F.lit(0))
    chi2 = F.coalesce(ratio(d * d, F.col("gained") + F.col("lost")), F.lit(0.0))
    return n.withColumn("chi2", chi2).withColumn("p", chi2_tail(F.col("chi2").cast("double")))


def majority_vote(df: DataFrame, by: list[str], key: str, value: str, pos: str) -> DataFrame:
    """The commonest key, ties by first seen, and the value where it first occurs."""
    counts = df.groupBy(*by, key).agg(F.count("*").alias("votes"), F.min(pos).alias("first"), F.min_by(value, pos).alias("value"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("first").alias("f"), F.col(key).alias("key"), F.col("value").alias("value"))).alias("m")).select(*by, F.col("m.key").alias("key"), F.col("m.value").alias("value"), (-F.col("m.v")).alias("votes"))


def group_mean_std(df: DataFrame, by: list[str], x: str, eps: float = 1e-8) -> DataFrame:
    """Mean, sample deviation with a floor, count; a single row counts as mean 0, deviation 1."""
    one = F.count(x) <= 1
    return df.groupBy(*by).agg(F.when(one, 0.0).otherwise(F.avg(x)).alias("mean"), F.when(one, 1.0).otherwise(F.sqrt(F.greatest(F.var_samp(x), F.lit(eps)))).alias("std"), F.count(x).alias("n"))


def group_normalised(df: DataFrame, by: list[str], x: str, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """(x - mean) / (std + eps) within groups."""
    w = Window.partitionBy(*by)
    n = F.count(x).over(w)
    mean, std = F.when(n <= 1, 0.0).otherwise(F.avg(x).over(w)), F.when(n <= 1, 1.0).otherwise(F.stddev_samp(x).over(w))
    return df.withColumn("advantage", (F.col(x) - mean) / (std + eps) if by_std else F.col(x) - mean)


def rloo(df: DataFrame, by: list[str], x: str, singleton_zero: bool = False) -> DataFrame:
    """Each score less the mean of the others; a single one stays, or becomes 0."""
    w = Window.partitionBy(*by)
    n, total = F.count(x).over(w), F.sum(x).over(w)
    alone = F.lit(0.0) if singleton_zero else F.col(x)
    return df.withColumn("advantage", F.when(n > 1, (F.col(x) * n - total) / (n - 1)).otherwise(alone))


def opo(df: DataFrame, by: list[str], x: str, length: str) -> DataFrame:
    """Each score less the length-weighted mean of its group."""
    w = Window.partitionBy(*by)
    base = F.sum(F.col(x) * F.col(length)).over(w) / F.sum(length).over(w)
    return df.withColumn("advantage", F.col(x) - F.when(F.count(x).over(w) > 1, base).otherwise(0.0))


def pass_at_k(df: DataFrame, by: list[str], x: str, pos: str, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """Only the best row gets a value: its lead over the second, over the group's deviation if asked."""
    w = Window.partitionBy(*by)
    o = w.orderBy(F.col(x).desc(), pos)
    lead = F.col(x) - F.lead(x).over(o)
    std = F.stddev_samp(x).over(w)
    value = lead / (std + eps) if by_std else lead
    return df.withColumn("advantage", F.when((F.row_number().over(o) == 1) & (F.count(x).over(w) > 1), value).otherwise(0.0))


def gpg(df: DataFrame, by: list[str], x: str, norm: float = 1.0) -> DataFrame:
    """(x - group mean) / norm, times rows over rows that are not 0."""
    w, every = Window.partitionBy(*by), df.agg(ratio(F.count(x), F.count_if(F.col(x) != 0)).alias("__a"))
    return df.crossJoin(F.broadcast(every)).withColumn("advantage", F.coalesce("__a", F.lit(1.0)) * (F.col(x) - F.avg(x).over(w)) / norm).drop("__a")


def reward_to_go(rewards: Column, gamma: float = 1.0) -> Column:
    """Discounted sums from each place to the end."""
    back = F.aggregate(F.reverse(rewards), F.array().cast("array<double>"), lambda a, r: F.concat(F.array(r.cast("double") + gamma * F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(0.0))), a))
    return back


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages along an array, from the end."""
    nxt = F.concat(F.slice(values, 2, F.size(values)), F.array(F.lit(0.0)))
    delta = F.zip_with(rewards, F.zip_with(values, nxt, lambda v, n: F.struct(v.alias("v"), n.alias("n"))), lambda r, vn: r + gamma * vn["n"] - vn["v"])
    return reward_to_go(delta, gamma * lam)


def loss_aggregate(df: DataFrame, loss: str, mask: str, mode: str) -> DataFrame:
    """One loss of arrays under masks."""
    kept = F.zip_with(loss, mask, lambda x, m: x * m.cast("double"))
    row = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    n = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double"))
    out = {"token-mean": ratio(F.sum(row), F.sum(n)), "seq-mean-token-sum": F.avg(row), "seq-mean-token-mean": F.avg(ratio(row, n)), "seq-mean-token-sum-norm": F.sum(row) / F.max(F.size(mask))}
    return df.agg(out[mode].alias("loss"))


def masked_stats(df: DataFrame, x: str, mask: str) -> DataFrame:
    """Sum, mean and unbiased variance of values under a mask."""
    v = F.when(F.col(mask), F.col(x))
    return df.agg(F.sum(v).alias("total"), (F.sum(v) / (F.count(v) + 1e-8)).alias("mean"), F.var_samp(v).alias("var"))


def masked_whiten(df: DataFrame, x: str, mask: str, shift_mean: bool = True) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8), with the mean added back if it isn't to be shifted."""
    s = df.agg(F.avg(F.when(F.col(mask), F.col(x))).alias("__m"), F.var_samp(F.when(F.col(mask), F.col(x))).alias("__v"))
    white = (F.col(x) - F.col("__m")) / F.sqrt(F.col("__v") + 1e-8)
    return df.crossJoin(F.broadcast(s)).withColumn("white", white if shift_mean else white + F.col("__m")).drop("__m", "__v")


def reduce_metrics(long: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """Names with max take the greatest value, with min the least, others the mean."""
    return long.groupBy(name).agg(F.when(F.contains(F.first(name), F.lit("max")), F.max(value)).when(F.contains(F.first(name), F.lit("min")), F.min(value)).otherwise(F.avg(value)).alias(value))


def score_lists(df: DataFrame, source: str, scores: str) -> DataFrame:
    """Mean over rows of each row's mean score, by source."""
    row = ratio(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), F.size(scores))
    return df.groupBy(source).agg(F.avg(row).alias("score"), F.count("*").alias("n"))


def batch_statistics(df: DataFrame, by: list[str], length: str, limit: int, *values: str) -> DataFrame:
    """Lengths, share at the limit, and least, greatest and mean of each value."""
    out = [F.avg(length).alias("length_mean"), F.max(length).alias("length_max"), F.min(length).alias("length_min"), F.avg((F.col(length) >= limit).cast("double")).alias("clip_ratio")]
    for v in values:
        out += [F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max"), F.min(v).alias(f"{v}_min")]
    return df.groupBy(*by).agg(*out)


def profile(df: DataFrame, by: list[str], text: str, flag: Column) -> DataFrame:
    """Rows, share of a flag, and least, mean and greatest number of words."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("flag_share"), F.min(n).alias("words_min"), F.avg(n).alias("words_mean"), F.max(n).alias("words_max"))


def sensitivity(df: DataFrame, source: str, ratio_col: str, metric: str, eps: float) -> DataFrame:
    """By source, the least ratio whose metric is at least (1 - eps) of the value at ratio 1."""
    base = df.where(F.col(ratio_col) == 1).groupBy(source).agg(F.max(metric).alias("base"))
    return df.join(base, source).where(F.col(metric) >= (1 - eps) * F.col("base")).groupBy(source).agg(F.min(ratio_col).alias("least_ratio"))


def trend_gate(df: DataFrame, key: str, initial: str = "initial", short: str = "short", final: str = "final", most_drop: float = 0.03, parseable: str | None = None) -> DataFrame:
    """By key: mean distances of the initial and short metrics to the final ones, the greatest drop from initial to short, and whether it passes.

    df: a row a metric. It passes if the short metrics are nearer to the final ones than the initial ones were, none
    dropped by more than the limit and, where such a column is given, all could be parsed.
    """
    out = df.groupBy(key).agg(
        F.avg(F.abs(F.col(initial) - F.col(final))).alias("initial_distance"), F.avg(F.abs(F.col(short) - F.col(final))).alias("short_distance"),
        F.max(F.col(initial) - F.col(short)).alias("most_drop"), F.count_if(F.col(initial) - F.col(short) > most_drop).alias("drops"), (F.lit(True) if parseable is None else F.min(parseable) == 1.0).alias("parses"),
    )
    return out.withColumn("passes", (F.col("short_distance") < F.col("initial_distance")) & (F.col("drops") == 0) & F.col("parses")).drop("parses")


def promotion_gate(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """candidates with four tests against the one-row baseline and whether all hold."""
    b = baseline.select(F.struct("*").alias("b"))
    tests = {
        "accuracy_ok": F.col("accuracy") >= F.col("b.accuracy"),
        "search_ok": F.col("mean_pop") <= F.col("b.mean_pop"),
        "coverage_ok": F.col("tree_search_samples") >= F.col("b.tree_search_samples"),
        "negatives_ok": F.col("negative_fpr") <= F.col("b.negative_fpr"),
    }
    out = candidates.crossJoin(F.broadcast(b)).withColumns(tests).drop("b")
    return out.withColumn("promoted", F.col("accuracy_ok") & F.col("search_ok") & F.col("coverage_ok") & F.col("negatives_ok"))


def route_counts(df: DataFrame, route: Column) -> DataFrame:
    """Rows by route, and whether there is one route only."""
    n = df.groupBy(route.alias("route")).agg(F.count("*").alias("n"))
    return n.withColumn("only", F.count("*").over(Window.partitionBy(F.lit(1))) == 1)  # a row a route


def validation_metrics(df: DataFrame, source: str, uid: str, value: str, answer: str, pos: str, repeats: int = 1000, seed: int = 42) -> DataFrame:
    """Per source: mean@N, std@N and bootstrapped best, worst and majority of n = 2, 4, ..., N, means over uids."""
    import numpy as np

    def one(key, rows):
        rows = rows.sort_values(pos)
        v, a = rows[value].to_numpy(float), rows[answer].to_numpy()
        n = len(v)
        out = [(f"mean@{n}", v.mean()), (f"std@{n}", v.std(ddof=1) if n > 1 else 0.0)]
        sizes, k = [], 2
        while k < n:
            sizes.append(k)
            k *= 2
        sizes += [n] if n > 1 else []
        rng = np.random.default_rng(seed)
        names, code = np.unique(a.astype(str), return_inverse=True)
        each_ = np.arange(repeats)
        for m in sizes:
            pick = rng.integers(0, n, (repeats, m))
            got, said = v[pick], code[pick]
            count = np.bincount((each_[:, None] * len(names) + said).ravel(), minlength=repeats * len(names)).reshape(repeats, len(names))
            first = np.full((repeats, len(names)), m)
            for j in range(m - 1, -1, -1):  # where each answer is first drawn
                first[each_, said[:, j]] = j
            # of the most frequent answers the one that is drawn first
            maj = got[each_, np.where(count == count.max(1, keepdims=True), first, m).min(1)]
            for name, x in (("best", got.max(1)), ("worst", got.min(1)), ("maj", maj)):
                out += [(f"{name}@{m}/mean", x.mean()), (f"{name}@{m}/std", x.std())]
        return pd.DataFrame([(key[0], str(key[1]), k_, float(x)) for k_, x in out], columns=["source", "uid", "metric", "value"])

    each = df.select(source, uid, value, answer, pos).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), source, uid).groupBy(source, uid).applyInPandas(one, "source string, uid string, metric string, value double")
    return each.groupBy("source", "metric").agg(F.avg("value").alias("value"), F.count("*").alias("uids"))


def trajectory_summary(rows: DataFrame, repeats: int = 1000, seed: int = 42) -> DataFrame:
    """One row over trajectories: accuracy with its interval, shares, routes, accuracy by family, recovered targets and instances by stage.

    A recovery is the first successful attempt after the initial one, by call, of a target that failed at first, with
    an instance that was retained, has a mask and a box; it counts for right answers that came by tree search.
    """
    mode, right = F.coalesce(F.col("search_mode"), F.lit(3)), F.coalesce(F.col("answer_correct"), F.lit(False))
    later = F.filter("t.sam_attempts", lambda a: (F.coalesce(a["stage"], F.lit("")) != "initial") & F.coalesce(a["sam_success"], F.lit(False)))
    first = F.array_min(F.transform(later, lambda a: F.struct(F.coalesce(a["call_index"], F.lit(0)).alias("c"), a["stage"].alias("stage"), a["instances"].alias("i"))))
    good = F.filter("r.i", lambda i: F.coalesce(i["retained_by_cvsearch"] & i["valid_mask"], F.lit(False)) & (F.size(i["pseudo_bbox_xyxy"]) > 0))
    found = rows.where((mode == 2) & right).select(F.explode("target_traces").alias("t")).where(~F.coalesce("t.initial_sam_success", F.lit(False))).select(first.alias("r")).where("r is not null").select("r.stage", F.size(good).alias("n")).where("n > 0")
    counts = lambda df, key, what, kind: df.groupBy(F.col(key).cast("string").alias("k")).agg(what.alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).cast(f"map<string,{kind}>").alias("m"))
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    taught = F.col("teacher_prediction").isNotNull()
    gain = F.col("teacher_gt_logprob") - F.col("student_gt_logprob")
    one = rows.agg(
        F.count("*").alias("samples"), F.count_if(right).alias("correct"), share(right).alias("accuracy"), share(F.col("normalized_prediction").isNull()).alias("illegal_rate"), share(F.coalesce("num_pop", F.lit(0.0))).alias("mean_pop"), F.count_if(mode == 2).alias("tree_search_samples"),
        share(F.when(taught, F.col("teacher_prediction").eqNullSafe(F.col("gt_answer")))).alias("teacher_crop_accuracy"), F.avg(F.when(taught, gain)).alias("teacher_logprob_gain_mean"), share(F.coalesce("accepted_for_opsd", F.lit(False))).alias("opsd_acceptance_rate"),
    )
    parts = [
        found.agg(F.count("*").alias("sam_recovered_target_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("sam_recovered_instance_count")),
        counts(rows.select(mode.alias("search_mode")), "search_mode", F.count("*"), "bigint").withColumnRenamed("m", "routes"),
        counts(rows.select(F.coalesce("question_family", F.lit("unknown")).alias("f"), right.alias("ok")), "f", F.avg(F.col("ok").cast("double")), "double").withColumnRenamed("m", "per_question_family_accuracy"),
        counts(found, "stage", F.count("*"), "bigint").withColumnRenamed("m", "sam_recovery_stages"),
        bootstrap_ci(rows.select("sample_id", right.cast("double").alias("ok")), [], "ok", "sample_id", repeats, seed=seed).select(F.struct("low", "high").alias("accuracy_ci95")),
    ]
    for p in parts:
        one = one.crossJoin(F.broadcast(p))  # one row each
    return one
