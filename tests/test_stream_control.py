"""An index that is stopped and resumed."""

import pytest

from quirework.streaming import control as C
from quirework.streaming.index import current_pages, write_pages


def test_a_stopped_and_resumed_index_is_the_uninterrupted_one(spark, tmp_path):
    rows = [(k % 7, k % 3, f"text {k}" if k % 5 else " ", k) for k in range(60)]
    for n in range(6):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], "doc long, page long, text string, at long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
    read = lambda: spark.readStream.schema("doc long, page long, text string, at long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/pages")
    write_pages(read(), f"{tmp_path}/whole", f"{tmp_path}/whole-state")
    expected = sorted(map(tuple, current_pages(spark, f"{tmp_path}/whole", ["doc", "page"], "at").collect()))

    control = f"{tmp_path}/control"
    assert C.last_command(spark, control) == C.RUN
    at_two = lambda p: C.command(spark, control, C.STOP) if p.batches == 2 else None
    run = lambda seen=None: C.index_pages(read(), f"{tmp_path}/log", f"{tmp_path}/state", control, "test-index", seen)
    first = run(at_two)
    assert first.stopped and first.batches == 2 and first.rows >= 20
    assert run().stopped and run().batches == 0
    C.command(spark, control, C.RUN)
    second = run(at_two)
    C.command(spark, control, C.RUN)
    third = run()
    assert second.stopped and second.batches == 2 and not third.stopped and third.batches == 2 and third.rows == 20
    assert sorted(map(tuple, current_pages(spark, f"{tmp_path}/log", ["doc", "page"], "at").collect())) == expected
    assert spark.read.parquet(f"{tmp_path}/log").count() == 60
    with pytest.raises(ValueError, match="no such command"):
        C.command(spark, control, "halt")


def test_other_failures_raise(spark, tmp_path):
    spark.createDataFrame([(1, 1, "x", 1)], "doc long, page long, text string, at long").write.parquet(f"{tmp_path}/pages")
    pages = spark.readStream.schema("doc long, page long, text string, at long").parquet(f"{tmp_path}/pages")

    def fail(progress):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        C.index_pages(pages, f"{tmp_path}/log", f"{tmp_path}/state", f"{tmp_path}/control", "failing-index", fail)
