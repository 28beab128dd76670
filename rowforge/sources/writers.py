"""Writers. A write is a job's commit: readers see all of it or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, order: str | None = None, mode: str = "errorifexists") -> None:
    """JSONL in the order of a column: range-partitioned, so part files in name order hold the rows in order (K1)."""
    out = df if order is None else df.repartitionByRange(order).sortWithinPartitions(order)
    out.write.mode(mode).option("ignoreNullFields", "false").json(path)


def replace(df: DataFrame, path: str, fmt: str = "parquet", empty_is_error: bool = True) -> int:
    """Write beside the target, then take its place; an empty result leaves the old one (K2, K3)."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target, staged, old = fs_path(path), fs_path(f"{path}.staged"), fs_path(f"{path}.old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.mode("overwrite").format(fmt).save(staged.toString())
        n = spark.read.format(fmt).schema(df.schema).load(staged.toString()).count()
        if not n and empty_is_error:
            raise ValueError(f"nothing to write to {path}")
        if fs.exists(target):
            fs.delete(old, True)
            fs.rename(target, old)
        fs.rename(staged, target)
        fs.delete(old, True)
        return n
    finally:
        fs.delete(staged, True)


def parquet(df: DataFrame, path: str, schema: str | None = None, mode: str = "errorifexists", repeat: int = 1) -> None:
    """Zstandard Parquet, cast to a declared nested schema if given, each row `repeat` times (K4, K5)."""
    from pyspark.sql import types as T

    if repeat != 1:
        df = df.select("*", F.explode(F.array_repeat(F.lit(0), repeat)).alias("__again")).drop("__again")

    if schema is not None:
        want = T.StructType.fromDDL(schema)
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want.fields])
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def report(long: DataFrame, path: str) -> None:
    """A long metric table (metric, value, ...) as JSON, CSV and Markdown rows; an existing report is kept."""
    long.coalesce(1).write.mode("errorifexists").json(f"{path}/json")
    long.coalesce(1).write.mode("errorifexists").option("header", True).csv(f"{path}/csv")
    markdown(long).coalesce(1).write.mode("errorifexists").text(f"{path}/markdown")


def markdown(df: DataFrame) -> DataFrame:
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def accept_reject(df: DataFrame, good: Column, path: str, mode: str = "errorifexists") -> dict[str, int]:
    """Two sinks and their counts (K9)."""
    tagged = df.withColumn("accepted", F.coalesce(good, F.lit(False)))
    tagged.write.mode(mode).partitionBy("accepted").parquet(path)
    n = {str(r["accepted"]).lower(): r["count"] for r in df.sparkSession.read.parquet(path).groupBy("accepted").count().collect()}  # a folder's name is read as text
    return {"accepted": n.get("true", 0), "rejected": n.get("false", 0)}


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row with a COCO document as JSON; documents are made per shard of images by the caller if they grow."""
    part = lambda d, n: d.agg(F.array_sort(F.collect_list(F.struct(*d.columns))).alias(n))
    doc = part(images, "images").crossJoin(part(annotations, "annotations")).crossJoin(part(categories, "categories"))  # one row each
    return doc.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value"))


def coco_shard_lines(images: DataFrame, annotations: DataFrame, categories: DataFrame, shards: int) -> DataFrame:
    """(shard, section, value): the objects of a COCO document for each of `shards` parts of the images, dealt by id, a row each.

    section: images, annotations or categories; value: the object as JSON. Each shard that has images has all categories; annotations of no image go. No row
    holds a document, so a shard may be of any size.
    """
    shard = lambda c: F.pmod(F.col(c), F.lit(shards)).cast("int").alias("shard")
    line = lambda d, of, n: d.select(of, F.lit(n).alias("section"), F.to_json(F.struct(*[c for c in d.columns if c != "__shard"])).alias("value"))
    known = annotations.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi").select(*annotations.columns)
    seen = images.select(shard("id").alias("__shard")).distinct().crossJoin(F.broadcast(categories))
    return line(images, shard("id"), "images").unionByName(line(known, shard("image_id"), "annotations")).unionByName(line(seen, F.col("__shard").alias("shard"), "categories"))


def coco_shards(images: DataFrame, annotations: DataFrame, categories: DataFrame, shards: int, folder: str | None = None) -> DataFrame:
    """(shard, value): a COCO document for each of `shards` parts of the images, dealt by id, with their annotations and all categories.

    With a folder, each is also a text file of its own below it. One document is one row, so `shards` bounds what a task holds (coco_shard_lines has a row an object); annotations of no image go.
    """
    shard = lambda c: F.pmod(F.col(c), F.lit(shards)).cast("int").alias("shard")
    part = lambda d, key, n: d.groupBy(shard(key)).agg(F.array_sort(F.collect_list(F.struct(*d.columns))).alias(n))
    known = annotations.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi").select(*annotations.columns)
    all_ = categories.agg(F.array_sort(F.collect_list(F.struct(*categories.columns))).alias("categories"))  # one row
    none = F.array().cast(f"array<{known.select(F.struct(*known.columns).alias('x')).schema['x'].dataType.simpleString()}>")
    doc = part(images, "id", "images").join(part(known, "image_id", "annotations"), "shard", "left").crossJoin(F.broadcast(all_))
    out = doc.select("shard", F.to_json(F.struct("images", F.coalesce("annotations", none).alias("annotations"), "categories")).alias("value"))
    if folder is not None:
        out.write.mode("errorifexists").partitionBy("shard").text(folder)
    return out


def append_attempts(df: DataFrame, path: str) -> None:
    """Rows added to an attempts log."""
    df.write.mode("append").json(path)


def frozen(df: DataFrame, path: str, digest: Column) -> DataFrame:
    """Write once, and return counts and an order-free digest to check against later (K8)."""
    df.write.mode("errorifexists").parquet(path)
    spark: SparkSession = df.sparkSession
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(digest)).alias("digest"))


def run_outputs(scored: DataFrame, path: str, settings: dict[str, str], identity: str = "id") -> None:
    """A finished run's outputs below a folder that must not have them yet (K7).

    scored: samples with prediction, elapsed_seconds, issues and the columns of scoring.score_predictions. Written are
    predictions and unit scores (JSON, in the order of ids), official and clean summaries by data set and subtask, issues (CSV), efficiency and
    the run manifest (settings, number of samples, samples by group).
    """
    from rowforge.operators import aggregate, scoring

    scored = scored.persist()  # read by every output
    by = ["dataset", "subtask"]
    jsonl(scored, f"{path}/predictions", identity)
    unit = scored.select(identity, *by, "task_type", "clean_status", F.struct(*scoring.SCORES).alias("score"))
    jsonl(unit, f"{path}/unit_scores", identity)
    for name in ("official", "clean"):
        jsonl(aggregate.grouped_accuracy(scored, by, f"{name}_correct").coalesce(1).sortWithinPartitions(*by), f"{path}/{name}_summary")
    issues = scored.select(F.col(identity).alias("sample_id"), *by, "clean_status", F.explode("issues").alias("issue"))
    issues.write.mode("errorifexists").option("header", True).csv(f"{path}/issues")
    jsonl(aggregate.efficiency(scored, [], "elapsed_seconds"), f"{path}/efficiency")
    groups = scored.groupBy(F.concat_ws("/", *by).alias("k")).agg(F.count("*").alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("group_counts"), F.sum("v").alias("sample_count"))  # a row a group
    jsonl(groups.withColumns({k: F.lit(v) for k, v in settings.items()}), f"{path}/run_manifest")
    scored.unpersist()
