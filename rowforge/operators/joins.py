"""Joins and set checks. A side is broadcast only below a checked number of rows; beyond it the join shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.tables import written

from rowforge.functions import boxes

BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint, if it has fewer rows than `rows`."""
    return F.broadcast(df) if df.limit(rows).count() < rows else df


def lookup_join(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in the table, with its columns."""
    return df.join(table, on, "inner")


def unmatched(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    return df.join(table, on, "left_anti")


def require_match(df: DataFrame, table: DataFrame, on: list[str], column: str) -> DataFrame:
    """Left join; a row without a match is an error."""
    out = df.join(table, on, "left")
    checked = F.when(F.col(column).isNull(), F.raise_error(F.concat(F.lit("no match for "), F.concat_ws(",", *on)))).otherwise(F.col(column))
    return out.withColumn(column, checked)


def fallback_category(df: DataFrame, by_image: DataFrame, by_text: DataFrame, image: str, text: list[str]) -> DataFrame:
    """The category by image, else by text, else the row's own, else unknown (J3). Tables hold one row a key."""
    out = df.join(by_image.withColumnRenamed("category", "__a"), image, "left").join(by_text.withColumnRenamed("category", "__b"), text, "left")
    own = [F.col("category")] if "category" in df.columns else []
    return out.withColumn("category", F.coalesce("__a", "__b", *own, F.lit("unknown"))).drop("__a", "__b")


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, as a dictionary that is filled in order would hold."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("__r = 1").drop("__r")


def long_for_short(short: DataFrame, long: DataFrame, key: str, order: str) -> DataFrame:
    """Short rows whose key has a long row, with the last one."""
    return short.join(last_by_key(long, [key], order).select(key, F.struct("*").alias("long")), key)


def merge_shards(expected: DataFrame, found: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Every key of either side with its status: ok, missing, unexpected, duplicate or drift."""
    e = expected.select(key, F.col(fingerprint).alias("__e"))
    f = found.groupBy(key).agg(F.count("*").alias("__n"), F.min(fingerprint).alias("__lo"), F.max(fingerprint).alias("__hi"))
    status = F.when(F.col("__e").isNull(), "unexpected").when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "duplicate").when((F.col("__lo") != F.col("__e")) | (F.col("__hi") != F.col("__e")), "drift").otherwise("ok")
    return e.join(f, key, "full_outer").select(key, status.alias("status"))


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and which."""
    miss = expected.select(key).distinct().join(found, key, "left_anti").withColumn("side", F.lit("missing"))
    extra = found.select(key).distinct().join(expected, key, "left_anti").withColumn("side", F.lit("extra"))
    return miss.unionByName(extra)


def paired(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both sides by key; a key on one side only is an error."""
    l, r = (d.select(key, F.struct(*columns).alias(n)) for d, n in ((left, "a"), (right, "b")))  # noqa: E741
    both = l.join(r, key, "full_outer")
    ok = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.concat(F.lit("unpaired: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return both.where(ok)


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides: empty if the sides are disjoint."""
    return left.select(key).intersect(right.select(key))


def below_iou(detections: DataFrame, truths: DataFrame, on: list[str], identity: str, most: float) -> DataFrame:
    """Detections whose greatest IoU with a truth of the same image and class is under `most`."""
    pairs = detections.join(truths.select(*on, F.col("box").alias("__t")), on)
    best = pairs.groupBy(identity).agg(F.max(boxes.iou(F.col("box"), F.col("__t"))).alias("max_iou"))
    return detections.join(best, identity, "left").withColumn("max_iou", F.coalesce("max_iou", F.lit(0.0))).where(F.col("max_iou") < most)


def top_prediction(truths: DataFrame, predictions: DataFrame, image: str, score: str) -> DataFrame:
    """By image, the best-scored prediction and its greatest IoU over the truths."""
    top = predictions.groupBy(image).agg(F.max_by("box", F.struct(F.col(score), -F.col("prediction_id"))).alias("p"))
    return truths.join(top, image, "left").groupBy(image).agg(F.max(F.coalesce(boxes.iou(F.col("box"), F.col("p")), F.lit(0.0))).alias("best_iou"), F.max(F.coalesce((((F.col("p")[0] + F.col("p")[2]) / 2).between(F.col("box")[0], F.col("box")[2])) & (((F.col("p")[1] + F.col("p")[3]) / 2).between(F.col("box")[1], F.col("box")[3])), F.lit(False))).alias("centre_hit"))


def excluding(df: DataFrame, lists: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is on no list."""
    banned = reduce(lambda a, b: a.unionByName(b), [x.select(key) for x in lists]).distinct()
    return df.join(banned, key, "left_anti")


def lexical_candidates(df: DataFrame, identity: str, text: Column, most: float = 0.9) -> DataFrame:
    """Pairs with 0 < Jaccard < most of their token sets, through an inverted index.

    Shared tokens are counted from pairs of rows under one token, so its cost is the sum of squared
    token frequencies: exact, and meant for lexicons and names.
    """
    t = df.select(F.col(identity).alias("id"), F.array_distinct(text).alias("t")).where(F.size("t") > 0)
    long = t.select("id", F.size("t").alias("n"), F.explode("t").alias("token"))
    pairs = long.alias("a").join(long.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")))
    both = pairs.groupBy(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).agg(F.count("*").alias("shared"), F.first("a.n").alias("n1"), F.first("b.n").alias("n2"))
    return both.withColumn("jaccard", F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).where(F.col("jaccard") < most).select("left_id", "right_id", "jaccard")


#: Rows that are held against all others at once.
ROWS_AT_ONCE = 8_192


def _kept(df: DataFrame) -> DataFrame:
    """df computed once, as a table that lost executors can read again."""
    return written(df, "partners")


def disjoint_partner(df: DataFrame, identity: str, tokens: str, k: int = 1, tries: int = 16, seed: int = 5) -> DataFrame:
    """For each row, up to k others that share no token with it.

    Candidates are the rows of `tries` random bins, one row a bin and turn. Rows that so get fewer than k
    are held against all rows, in blocks of ROWS_AT_ONCE, and get the first ones in hash order: a row is short only
    if no further disjoint row exists. That costs the short rows times all rows. Identities are distinct.
    """
    n = 64
    bin_of = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(identity)), F.lit(n))
    pool = None
    for turn in range(tries):
        one = df.groupBy(bin_of(f"pool{turn}").alias("bin")).agg(F.min_by(F.struct(F.col(identity).alias("id"), F.col(tokens).alias("t")), F.xxhash64(F.lit(turn), F.col(identity))).alias("other")).withColumn("turn", F.lit(turn))
        pool = one if pool is None else pool.unionByName(one)
    asks = df.select(identity, tokens, F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), bin_of(f"ask{t}").alias("bin")) for t in range(tries)])).alias("x")).select(identity, tokens, "x.*")
    hit = asks.join(F.broadcast(pool), ["turn", "bin"]).where((F.col("other.id") != F.col(identity)) & ~F.arrays_overlap(F.col("other.t"), F.col(tokens)))
    once = hit.select(identity, "turn", F.col("other.id").alias("partner")).groupBy(identity, "partner").agg(F.min("turn").alias("turn"))
    drawn = _kept(once.withColumn("rank", F.row_number().over(Window.partitionBy(identity).orderBy("turn", "partner"))).where(F.col("rank") <= k).drop("turn"))
    full = drawn.where(F.col("rank") == k).select(identity)
    short = _kept(df.select(identity, tokens).join(full, identity, "left_anti").where(F.col(tokens).isNotNull()))
    blocks = -(-short.count() // ROWS_AT_ONCE)
    if not blocks:
        return drawn
    order = F.xxhash64(F.lit(seed), F.col("q"), F.col("id"))
    asked = short.select(F.col(identity).alias("q"), F.col(tokens).alias("qt"))
    rows = df.select(F.col(identity).alias("id"), F.col(tokens).alias("t"))
    out = drawn.join(short.select(identity), identity, "left_anti")
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64(F.lit("block"), "q"), F.lit(blocks)) == b)
        last, made = some.withColumn("after", F.lit(None).cast("struct<h:bigint,id:" + rows.schema["id"].dataType.simpleString() + ">")), []
        for rank in range(1, k + 1):  # one partner a pass, so a task keeps one row a query
            at = F.struct(order.alias("h"), "id")
            pairs = rows.join(F.broadcast(last), (F.col("id") != F.col("q")) & ~F.arrays_overlap("t", "qt") & (F.col("after").isNull() | (at > F.col("after"))))
            found = _kept(pairs.groupBy("q").agg(F.min(at).alias("after"), F.first("qt").alias("qt")))
            if found.isEmpty():
                break
            made.append(found.select(F.col("q").alias(identity), F.col("after.id").alias("partner"), F.lit(rank).alias("rank")))
            last = found.select("q", "qt", "after")
        for m in made:
            out = out.unionByName(m)
    return out


def coco_join(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with their image and category."""
    return annotations.join(images.withColumnRenamed("id", "image_id"), "image_id").join(categories.select(F.col("id").alias("category_id"), "name"), "category_id")


def union_columns(left: DataFrame, right: DataFrame, row: str) -> DataFrame:
    """Columns of both by row id; shared columns must be equal."""
    shared = [c for c in left.columns if c in right.columns and c != row]
    r = right.select(row, *[F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in right.columns if c != row])
    both = left.join(r, row, "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in shared], F.lit(True))
    ok = F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("conflict in row "), F.col(row).cast("string"))).cast("boolean"))
    return both.where(ok).drop(*[f"__{c}" for c in shared])


def result_diff(before: DataFrame, after: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Values before and after, the change and its percentage."""
    a, b = before.select(*on, F.col(value).alias("before")), after.select(*on, F.col(value).alias("after"))
    return a.join(b, on).withColumn("change", F.col("after") - F.col("before")).withColumn("percent", 100 * F.try_divide(F.col("change"), F.col("before")))


def verified_blobs(records: DataFrame, blobs: DataFrame, on: list[str], content: str) -> DataFrame:
    """Records with the blob of their key, if its bytes have the recorded length and SHA-256."""
    both = records.join(blobs, on)
    return both.where((F.octet_length(content) == F.col("n_bytes")) & (F.sha2(F.col(content).cast("binary"), 256) == F.col("sha256")))
