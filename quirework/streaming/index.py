"""Incremental behaviour as Structured Streaming: page index, duplicates in flight, windowed telemetry, breakers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirework.operators.telemetry import breaker_step


def write_pages(pages: DataFrame, target: str, checkpoint: str) -> None:
    """Takes in what is there of a stream of pages and stops. Each batch is a part of the log under target.

    A batch that is done again after a failure replaces its part, so the log stays right.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/part={number:09d}")

    query = pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current_pages(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    """Of each key the newest row of the log; blank text becomes a placeholder."""
    rows = spark.read.parquet(target).drop("part")
    names = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct("batch", order)).alias("row")).select(*keys, "row.*")
    if "text" in names:
        newest = newest.withColumn("text", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "(blank page)").otherwise(F.col("text")))
    return newest


def once(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """The first of the rows with equal keys within the delay; state older than that is forgotten."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, window: str, delay: str, *groups: str) -> DataFrame:
    """Counts by window of event time; rows later than the delay are left out."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(F.window(time, window), *groups).agg(F.count("*").alias("rows"), F.avg("value").alias("mean"))


def breaker_stream(calls: DataFrame, key: str) -> DataFrame:
    """(key, at, state, allowed) of calls (key, at in seconds, ok); each key's breaker is kept between batches."""

    def step(keys: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("closed", 0, 0.0)
        rows = pd.concat(batches).sort_values("at", kind="stable")
        out = []
        for at, ok in zip(rows["at"], rows["ok"], strict=True):
            now, allowed = breaker_step(now, float(at), bool(ok))
            out.append((keys[0], float(at), now[0], allowed))
        state.update(now)
        yield pd.DataFrame(out, columns=[key, "at", "state", "allowed"])

    kind = calls.schema[key].dataType.simpleString()
    grouped = calls.select(key, F.col("at").cast("double").alias("at"), "ok").groupBy(key)
    return grouped.applyInPandasWithState(step, f"{key} {kind}, at double, state string, allowed boolean", "name string, failures int, opened double", "append", GroupStateTimeout.NoTimeout)
