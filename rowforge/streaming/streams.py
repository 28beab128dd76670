"""Streams: bounded queues, resumed runs, growing tables; and event-time windows as an extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bounded_source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    """A file stream that takes no more than so many files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def bounded_queue(stream: DataFrame, key: str, item: str, order: str, capacity: int) -> DataFrame:
    """Per key, a queue that drops its oldest item when full: (key, produced, dropped, held) after each trigger."""
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, produced bigint, dropped bigint, held array<string>"

    def push(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        produced, dropped, held = state.get if state.exists else (0, 0, [])
        held = list(held)
        for part in parts:
            for v in part.sort_values(order)[item].astype(str):
                produced += 1
                held.append(v)
                if len(held) > capacity:
                    held.pop(0)
                    dropped += 1
        state.update((produced, dropped, held))
        yield pd.DataFrame({key: [k[0]], "produced": [produced], "dropped": [dropped], "held": [held]})

    return stream.groupBy(key).applyInPandasWithState(push, schema, "produced bigint, dropped bigint, held array<string>", "update", GroupStateTimeout.NoTimeout)


def fresh(df: DataFrame, version: str, current: Column | int, threshold: int) -> DataFrame:
    """Items whose parameter version is within the staleness threshold."""
    return df.where((current if isinstance(current, Column) else F.lit(current)) - F.col(version) <= threshold)


def pending(jobs: DataFrame, log: DataFrame, key: str, attempts: int, success: Column) -> DataFrame:
    """Jobs that have neither succeeded nor used up their attempts, with the next attempt's number (R2)."""
    seen = log.groupBy(key).agg(F.max(success.cast("int")).alias("__ok"), F.count("*").alias("__n"))
    left = jobs.join(seen, key, "left").where((F.coalesce("__ok", F.lit(0)) == 0) & (F.coalesce("__n", F.lit(0)) < attempts))
    return left.withColumn("attempt", F.coalesce("__n", F.lit(0)) + 1).drop("__ok", "__n")


def grow(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """The table at path with a batch added."""
    batch.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start a query that appends to Parquet and stops when its input is used up; a rerun goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def tumbling(df: DataFrame, ts: str, size: str, by: list[str], late: str = "10 minutes", *aggs: Column) -> DataFrame:
    """Counts and further aggregates of event-time windows, late rows up to a watermark (an extension)."""
    src = df.withWatermark(ts, late) if df.isStreaming else df
    return src.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n"), *aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", *[a for a in _names(aggs)])


def _names(aggs: tuple[Column, ...]) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggs]


def sliding(df: DataFrame, ts: str, size: str, step: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    src = df.withWatermark(ts, late) if df.isStreaming else df
    return src.groupBy(F.window(ts, size, step).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    src = df.withWatermark(ts, late) if df.isStreaming else df
    return src.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
