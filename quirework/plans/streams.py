"""Queries that run as streams over what is there, and stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.plans.registry import query, table
from quirework.session import shared_folder
from quirework.streaming import control as C
from quirework.streaming.index import current_pages, once, windowed_counts, write_pages


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a pattern, since a stream's source may be one file only then."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def written(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """A stream's rows after it has taken in everything, in append mode."""
    folder = shared_folder(spark, name)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("select user_id, event_id % 50 as page, max_by(event_type, event_id) as text, max(event_id) as event_id from events group by 1, 2")
def stream_page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "page-index")
    pages = events(spark, sf_dir).select("user_id", (F.col("event_id") % 50).alias("page"), F.col("event_type").alias("text"), "event_id")
    write_pages(pages, f"{folder}/log", f"{folder}/state")
    return current_pages(spark, f"{folder}/log", ["user_id", "page"], "event_id").select("user_id", "page", "text", "event_id")


@query("select distinct user_id, event_type from events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates in flight: one row for each user and type, as the delay covers the whole table."""
    return written(once(events(spark, sf_dir), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), spark, "once")


@query("select time_bucket(interval 1 day, ts) as day, count(*) as events from events group by 1 having time_bucket(interval 1 day, ts) + interval 1 day <= (select max(ts) - interval 1 hour from events)")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that are over, an hour for late rows included."""
    days = windowed_counts(events(spark, sf_dir), "ts", "1 day", "1 hour")
    return written(days.select(F.col("window.start").cast("timestamp_ntz").alias("day"), F.col("rows").alias("events")), spark, "daily")


@query("select user_id, event_id % 50 as page, max_by(event_type, event_id) as text, max(event_id) as event_id, true as was_stopped from events group by 1, 2")
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page index of a stream that was told to stop before it began, and then to go on."""
    folder = shared_folder(spark, "resumed-index")
    pages = events(spark, sf_dir).select("user_id", (F.col("event_id") % 50).alias("page"), F.col("event_type").alias("text"), "event_id")
    run = lambda: C.index_pages(pages, f"{folder}/log", f"{folder}/state", f"{folder}/control", "resumed-index")
    C.command(spark, f"{folder}/control", C.STOP)
    stopped = run().stopped
    C.command(spark, f"{folder}/control", C.RUN)
    run()
    return current_pages(spark, f"{folder}/log", ["user_id", "page"], "event_id").select("user_id", "page", "text", "event_id", F.lit(stopped).alias("was_stopped"))
