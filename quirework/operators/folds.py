"""Steps that depend on the one before: rows of a key in order, through a state that batches hand on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Short rows that one task sorts or sums together, on average.
TASK_ROWS = 250_000


def parts_for(spark: SparkSession, rows: int, of_task: int | None = None) -> int | None:
    """How many partitions keep a task at TASK_ROWS rows, or so many; None if the session's partitions do, joined to one for each core."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-rows // (of_task or TASK_ROWS))
    # Spark deals both sides of a join anew where one has fewer partitions than the session's, and joins those again.
    return max(parts, own) if parts > min(spark.sparkContext.defaultParallelism, own) else None


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """The rows dealt by keys over so many partitions, which stay that many; as they are for None.

    Adaptive execution joins partitions until there is one for each core or they hold 64 MB packed, so without this a task's rows
    grow with the table. Joins and groups by these keys, or by more, need no further shuffle.
    """
    return rows.repartition(parts, *keys) if parts else rows


def folded(rows: DataFrame, key: str, order: str, start: Callable[[], Any], step: Callable[[Any, dict], dict], schema: str, parts: int | None = None) -> DataFrame:
    """key, order and what step gives for each row of a key in order; start makes the state that step changes.

    Rows are dealt by key and sorted within the tasks, so a task holds a batch and one state, however many rows a key has. Rows of
    a null key are one key. Give only the columns that step reads. parts is a number of tasks, else the session's.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {schema}"
    arrow = to_arrow_schema(T._parse_datatype_string(out))
    names = arrow.names[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            found: dict[str, list] = {name: [] for name in names}
            for row in batch.to_pylist():
                if row[key] != current:
                    current, state = row[key], start()
                result = step(state, row)
                for name in names:
                    found[name].append(result[name])
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(order), *(pa.array(found[n], arrow.field(n).type) for n in names)], schema=arrow)

    return (dealt(rows, parts, key) if parts else rows.repartition(key)).sortWithinPartitions(key, order).mapInArrow(run, out)
