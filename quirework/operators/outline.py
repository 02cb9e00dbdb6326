"""Section trees and intervals from headings in line order, without a stack."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = 6
SEPARATOR = "\x1f"
#: Lines of one document that a task sorts together; what the blocks before or after hold is carried to a block from their sums.
BLOCK_LINES = 65_536


def section_index(headings: DataFrame, last_lines: DataFrame, doc: str = "doc_id", kept: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> DataFrame:
    """Adds parent_line, line_end, direct_line_end, context and id to headings of (doc, line, level, title).

    The parent is the nearest earlier heading of a smaller level; a section ends before the next
    heading of its level or a smaller one, and its own text before its first child. last_lines has (doc, last_line).
    An id is a hash of the titles from the root down and of the occurrence among equal paths. kept writes rows that several joins
    read, and reads them again.
    """
    levels = range(1, LEVELS + 1)
    at_level = {k: F.when(F.col("level") == k, F.col("line")) for k in levels}
    rows = headings.join(last_lines, doc)
    rows = kept(nearest(rows, doc, "line", {f"_a{k}": v for k, v in at_level.items()}), "above")
    rows = nearest(rows, doc, "line", {f"_z{k}": v for k, v in at_level.items()}, later=True)
    next_line = reduce(lambda a, b: F.least(a, b), (F.col(f"_z{k}") for k in levels))
    # least and greatest pass over nulls
    parent = _by_level(lambda k: F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *(F.col(f"_a{j}") for j in range(1, k))))
    until = _by_level(lambda k: F.least(F.lit(None).cast("long"), F.lit(None).cast("long"), *(F.col(f"_z{j}") for j in range(1, k + 1))))
    rows = rows.withColumn("parent_line", parent).withColumn("line_end", F.coalesce(until - 1, F.col("last_line")))
    rows = rows.withColumn("direct_line_end", F.least(next_line - 1, F.col("line_end"))).drop(*(f"_{s}{k}" for s in "az" for k in levels), "last_line")
    return _with_paths(kept(rows, "intervals"), doc)


def nearest(rows: DataFrame, doc: str, at: str, values: dict[str, Column], later: bool = False, tie: str | None = None) -> DataFrame:
    """Adds under each name the last value that isn't null before each row's place in its document, or with later the first one after it.

    With tie, a column that orders rows of equal places, the row's own value counts as well. Places are numbers. A document is
    sorted in blocks of places; of each block only its nearest values go on to the others, so a task holds blocks, however long
    a document is.
    """
    side = (lambda c: F.desc(c)) if later else (lambda c: F.asc(c))
    rows = rows.withColumn("_block", F.floor(F.col(at) / BLOCK_LINES))
    order = [side(at), *([side(tie)] if tie else [])]
    # Later rows as a growing frame in the other direction: a shrinking one would be summed anew for each row.
    own = Window.partitionBy(doc, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if tie else -1)
    place = F.struct(at, *([tie] if tie else []))
    edge = F.min_by if later else F.max_by
    ends = rows.groupBy(doc, "_block").agg(*(edge(v, F.when(v.isNotNull(), place)).alias(n) for n, v in values.items()))
    others = Window.partitionBy(doc).orderBy(side("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(doc).alias("_d"), F.col("_block").alias("_b"), *(F.last(n, ignorenulls=True).over(others).alias(f"_carried{n}") for n in values))
    found = rows.select("*", *(F.last(v, ignorenulls=True).over(own).alias(n) for n, v in values.items()))
    found = found.join(carried, found[doc].eqNullSafe(carried["_d"]) & found["_block"].eqNullSafe(carried["_b"]))
    return found.select(*rows.drop("_block").columns, *(F.coalesce(n, f"_carried{n}").alias(n) for n in values))


def _by_level(value) -> Column:
    out = F.lit(None).cast("long")
    for k in range(1, LEVELS + 1):
        out = F.when(F.col("level") == k, value(k)).otherwise(out)
    return out


def _with_paths(rows: DataFrame, doc: str) -> DataFrame:
    """Ancestors by one join a level, as a tree has six levels at most."""
    nodes = rows.select(F.col(doc).alias("_doc"), F.col("line").alias("_line"), F.col("title").alias("_title"), F.col("parent_line").alias("_parent"))
    out = rows.withColumn("context", F.array().cast("array<string>")).withColumn("_up", F.col("parent_line"))
    for _ in range(LEVELS - 1):
        out = out.join(nodes, (F.col(doc) == F.col("_doc")) & (F.col("_up") == F.col("_line")), "left")
        out = out.withColumn("context", F.when(F.col("_title").isNotNull(), F.concat(F.array("_title"), F.col("context"))).otherwise(F.col("context"))).withColumn("_up", F.col("_parent")).drop("_doc", "_line", "_title", "_parent")
    path = F.array_join(F.concat("context", F.array("title")), SEPARATOR)
    out = out.drop("_up").withColumn("_path", path)
    out = out.withColumn("occurrence", F.row_number().over(Window.partitionBy(doc, "_path").orderBy("line")))
    return out.withColumn("id", F.concat(F.lit("section-"), F.left(F.sha2(F.concat_ws(SEPARATOR, "_path", F.col("occurrence").cast("string")), 256), F.lit(20)))).drop("_path")


def tree_problems(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, code, line) of each broken invariant: repeated ids, parents, intervals, overlapping siblings."""
    parents = sections.select(F.col(doc).alias("_doc"), F.col("line").alias("_line"), F.col("level").alias("_level"), F.col("line_end").alias("_end"))
    joined = sections.join(parents, (F.col(doc) == F.col("_doc")) & (F.col("parent_line") == F.col("_line")), "left")
    bad_parent = F.col("parent_line").isNotNull() & (F.col("_line").isNull() | (F.col("_level") >= F.col("level")) | (F.col("_line") >= F.col("line")) | (F.col("_end") < F.col("line_end")))
    sibling = Window.partitionBy(doc, "parent_line").orderBy("line")
    checks = [
        (joined.where(bad_parent), "invalid_parent_or_interval"),
        (sections.where(~F.col("direct_line_end").between(F.col("line"), F.col("line_end"))), "invalid_direct_interval"),
        (sections.withColumn("_last", F.lag("line_end").over(sibling)).where(F.col("_last") >= F.col("line")), "section_sibling_overlap"),
    ]
    found = [rows.select(doc, F.lit(code).alias("code"), "line") for rows, code in checks]
    repeated = sections.groupBy(doc, "id").agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n > 1")
    return reduce(DataFrame.unionByName, [*found, repeated.select(doc, F.lit("duplicate_id").alias("code"), "line")])


def as_of(rows: DataFrame, marks: DataFrame, doc: str, at: str, value: str) -> DataFrame:
    """Adds the value of the last mark at or before each row's place in its document; one sort of both sides, no pairs."""
    both = rows.withColumn("_mark", F.lit(None).cast(marks.schema[value].dataType)).withColumn("_is_row", F.lit(1))
    other = marks.select(doc, at, F.col(value).alias("_mark"), F.lit(0).alias("_is_row"))
    both = both.unionByName(other, allowMissingColumns=True)
    return nearest(both, doc, at, {value: F.col("_mark")}, tie="_is_row").where("_is_row = 1").drop("_mark", "_is_row")


def inside(points: DataFrame, intervals: DataFrame, doc: str, at: str, start: str, end: str, value: str) -> DataFrame:
    """Adds the value of the first interval of the document that holds each row's place; null outside.

    Places are whole numbers. Each interval is cut to what no earlier one holds, so at most one is left for any place, and
    one sort of places and intervals finds it; no pairs are made.
    """
    blocks = intervals.withColumn("_block", F.floor(F.col(start) / BLOCK_LINES))
    earlier = Window.partitionBy(doc, "_block").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    ends = blocks.groupBy(doc, "_block").agg(F.max(end).alias("_end"))
    reached = F.max("_end").over(Window.partitionBy(doc).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(F.col(doc).alias("_d"), F.col("_block").alias("_b"), reached.alias("_reached"))
    blocks = blocks.withColumn("_last", F.max(end).over(earlier))
    blocks = blocks.join(carried, blocks[doc].eqNullSafe(carried["_d"]) & blocks["_block"].eqNullSafe(carried["_b"]))
    cut = blocks.withColumn("_from", F.greatest(F.col(start), F.col("_last") + 1, F.col("_reached") + 1)).where(F.col("_from") <= F.col(end))
    marks = cut.select(doc, F.col("_from").alias(at), F.struct(F.col(value).alias("value"), F.col(end).alias("end")).alias("_hit"))
    found = as_of(points, marks, doc, at, "_hit")
    return found.withColumn(value, F.when(F.col(at) <= F.col("_hit.end"), F.col("_hit.value"))).drop("_hit")


def unique_match(left: DataFrame, right: DataFrame, on: str, value: str) -> DataFrame:
    """Left rows with the right value of the same key where the key is unique on both sides; null elsewhere."""
    one = right.groupBy(on).agg(F.count("*").alias("_n"), F.first(value).alias("_value"))
    counts = left.groupBy(on).agg(F.count("*").alias("_m"))
    joined = left.join(counts, on).join(one, on, "left")
    return joined.withColumn(value, F.when((F.col("_m") == 1) & (F.col("_n") == 1), F.col("_value"))).drop("_m", "_n", "_value")


def islands(rows: DataFrame, partition: str, order: str, breaks: Column, name: str = "island") -> DataFrame:
    """Adds the number of the run that each row belongs to; a run begins where breaks holds."""
    w = Window.partitionBy(partition).orderBy(order)
    return rows.withColumn("_break", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")
