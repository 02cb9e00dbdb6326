"""Stopping and resuming an index that a stream keeps, and its progress while it runs.

Commands are rows of a control table that anyone may append to. A running index looks at the last one before each batch: told
to stop it leaves that batch undone, and told to run again it goes on from its checkpoint with the same batch, whose part of the
log is written anew. So an index that was stopped any number of times holds what an uninterrupted one does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

RUN, STOP = "run", "stop"
COMMAND = "command string, given timestamp"


class Stopped(Exception):
    """A stop command was found before a batch."""


@dataclass
class Progress:
    """Batches that are done, their rows, and whether the index ended because it was told to."""

    batches: int = 0
    rows: int = 0
    stopped: bool = False


class _Listener(StreamingQueryListener):
    def __init__(self, name: str, progress: Progress):
        self.name, self.progress = name, progress

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name and event.progress.numInputRows:
            self.progress.batches += 1
            self.progress.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def command(spark: SparkSession, control: str, word: str) -> None:
    """Appends a command to the control table."""
    if word not in (RUN, STOP):
        raise ValueError(f"no such command: {word}")
    spark.range(1).select(F.lit(word).alias("command"), F.current_timestamp().alias("given")).write.mode("append").parquet(control)


def last_command(spark: SparkSession, control: str) -> str:
    """The last command given; to run, if there is none."""
    try:
        rows = spark.read.schema(COMMAND).parquet(control)
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return RUN
        raise
    return rows.agg(F.max_by("command", "given")).first()[0] or RUN


def index_pages(pages: DataFrame, target: str, checkpoint: str, control: str, name: str, seen: Callable[[Progress], None] | None = None) -> Progress:
    """Takes in what is there of a stream of pages, batch by batch, until all is taken or a stop command is found.

    Batches are parts of the log under target, as write_pages makes them. seen is called after each batch with the progress so
    far. A batch that fails for any other reason raises.
    """
    spark, progress, told = pages.sparkSession, Progress(), Progress()
    listener = _Listener(name, progress)

    def put(batch: DataFrame, number: int) -> None:
        if last_command(spark, control) == STOP:
            told.stopped = True
            raise Stopped
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/part={number:09d}")
        told.batches += 1
        if seen:
            seen(told)

    spark.streams.addListener(listener)
    try:
        query = pages.writeStream.queryName(name).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if not told.stopped:
                raise
        progress.rows = max(progress.rows, sum(p.numInputRows for p in query.recentProgress))
    finally:
        spark.streams.removeListener(listener)
    progress.stopped = told.stopped
    progress.batches = told.batches
    return progress
