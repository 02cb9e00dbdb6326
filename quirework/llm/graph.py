"""Connected components of edge tables, by contraction; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import checkpointed, looked_up, narrow


def _follow(parent: DataFrame, rows: int) -> DataFrame:
    """(node, up) of at most so many rows with up replaced by the root that the chain of parents ends in. Each step halves the chains."""
    parent = checkpointed(narrow(parent, rows))
    while True:
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("above"))
        stepped = parent.join(looked_up(above, rows), "up", "left").select("node", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved"))
        parent = checkpointed(narrow(stepped, rows))
        moved = parent.where("moved").limit(1).count()
        parent = parent.select("node", "up")
        if not moved:
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of the edges (a, b) that isn't the smallest of its component.

    a and b are longs; component is the smallest node that is reachable. Edges in either direction,
    repeated ones and loops count alike; an edge with a null end counts for nothing. A node without
    a row is its own component. Every round joins each root with its smallest neighbour among the
    smaller ones and contracts the edges, so the number of roots with edges at least halves. No table
    on the way has more rows than there are edges, by which their partitions and joins are chosen.
    """
    edges = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo and a is not null and b is not null").distinct()
    edges = checkpointed(edges)
    rows = edges.count()
    edges = narrow(edges, rows)
    found = None
    while edges.limit(1).count():
        parent = _follow(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")), rows)
        if found is None:
            found = parent
        else:
            next_up = parent.select(F.col("node").alias("up"), F.col("up").alias("above"))
            moved = found.join(looked_up(next_up, rows), "up", "left").select("node", F.coalesce("above", "up").alias("up"))
            new = parent.join(looked_up(found.select("node"), rows), "node", "left_anti")
            found = checkpointed(narrow(moved.unionByName(new), rows))
        of_hi, of_lo = parent.select(F.col("node").alias("hi"), F.col("up").alias("a")), parent.select(F.col("node").alias("lo"), F.col("up").alias("b"))
        joined = edges.join(looked_up(of_hi, rows), "hi").join(looked_up(of_lo, rows), "lo", "left").select("a", F.coalesce("b", "lo").alias("b")).where("a <> b")
        edges = checkpointed(narrow(joined.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), rows))
    if found is None:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return found.select("node", F.col("up").alias("component"))
