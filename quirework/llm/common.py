"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.session import shared_top

#: Rows and bytes in one Arrow batch. Texts may be long, and a worker holds a few batches at once.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20

#: Ids that are broadcast at most (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

#: Rows of two or three numbers that one task takes. Tables of few such rows have few partitions, not one small file each for every key.
NARROW_ROWS = 50_000

#: Columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps Arrow batches small enough for tables of long texts; a single longer text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the reliable checkpoint folder and read from there.

    The folder is the one that the cluster names in spark.checkpoint.dir. Where nothing names
    one, as in tests, a temporary folder of this machine serves, if it is the only one. Estimates of
    size are not carried over: each join multiplies those of its sides, and rounds of joins would
    make numbers of them that take the planner longer than the work itself.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_top(df.sparkSession, "checkpoint"))
    kept = df.checkpoint(eager=True)
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), df.sparkSession)


def looked_up(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most so many ids and numbers for a join: broadcast if they are few, so that the other side stays where it is."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def small(ids: DataFrame) -> DataFrame:
    """Ids for a join: broadcast if they are few, so that texts stay where they are; else joined by a shuffle."""
    ids = checkpointed(ids)
    return looked_up(ids, ids.count())


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most so many short rows in no more partitions than they need."""
    return df.coalesce(max(1, -(-rows // NARROW_ROWS)))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """One output batch for each input batch, in Arrow form; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    tune(df.sparkSession, rows)
    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts; a null counts as an empty text."""
    return [t or "" for t in column.to_pylist()]


def id_and_text(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


_HELD: dict[str, Callable[[], None]] = {}


def only_cache(name: str, clear: Callable[[], None]) -> None:
    """Frees what other operators keep in this worker, so that a worker that serves several holds one's memory.

    clear empties the cache of this name when its turn comes.
    """
    if len(_HELD) != 1 or name not in _HELD:
        for other in [n for n in _HELD if n != name]:
            _HELD.pop(other)()
        _HELD[name] = clear


def quiet_threads() -> None:
    """Native libraries use one thread in each worker; Spark's tasks are the parallelism."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
