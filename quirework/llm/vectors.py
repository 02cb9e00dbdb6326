"""Near-duplicate vectors by quantised tile products with error bounds.

Vectors are dealt into groups, and each pair of groups is a cell with its own task. In a cell, tiles
of int8 vectors are multiplied; the bound on each vector's quantisation error says which pairs may
reach the threshold, and only those are computed again in double precision. A cell gives each
vector's number of links and the smallest vector linked with it there, never a list of pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm.common import checkpointed, map_batches
from quirework.llm.graph import components

#: Vectors in a group at most, on average, and their bytes in double precision, of which a task holds two groups
#: some three times over; and the least number of groups, for parallelism in small inputs.
GROUP_ROWS, GROUP_BYTES, LEAST_GROUPS = 65_536, 64 << 20, 6
TILE = 2048
#: Room for rounding in single precision, beside the quantisation bounds.
SLACK = 1e-5


@dataclass
class Quantised:
    """units: the vectors at length 1. codes times scale are near them; error bounds the distance."""

    units: np.ndarray
    codes: np.ndarray
    scale: np.ndarray
    error: np.ndarray


def quantise(vectors: np.ndarray) -> Quantised:
    units = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(units - codes * scale[:, None], axis=1) * (1 + 1e-9)
    return Quantised(units, codes, scale.astype(np.float32), error.astype(np.float32))


def possible(a: Quantised, b: Quantised, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold: the product of the codes plus the bound on its error does.

    For units u, v and their approximations p, q: |uv - pq| <= |u - p| + |p| |v - q|.
    """
    # Integers in single precision are exact up to 2^24, which products of up to 1040 codes stay below.
    kind = np.float32 if a.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = a.codes.astype(kind) @ b.codes.astype(kind).T
    product *= b.scale
    product *= a.scale[:, None]
    product += b.error * (1 + a.error.max(initial=0))
    return product >= (threshold - SLACK - a.error)[:, None]


def linked(a: Quantised, b: Quantised, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b whose cosine in double precision reaches the threshold."""
    maybe = possible(a, b, threshold)
    if np.count_nonzero(maybe) * 8 > maybe.size:
        return np.nonzero(maybe & (a.units @ b.units.T >= threshold))
    i, j = np.nonzero(maybe)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 50_000):
        part = slice(k, k + 50_000)
        keep[part] = np.einsum("ij,ij->i", a.units[i[part]], b.units[j[part]]) >= threshold
    return i[keep], j[keep]


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of the rows i with those of the rows j; root gives each row's smallest member."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (above := root[root])).any():
            root[:] = above


def _part(q: Quantised, rows: slice) -> Quantised:
    return Quantised(q.units[rows], q.codes[rows], q.scale[rows], q.error[rows])


def links_in_cell(ids: np.ndarray, first: np.ndarray, vectors: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, numbers of links, and smallest linked ids of the vectors that have links.

    first marks the vectors of the first group; same says that the cell has one group only.
    """
    order = np.argsort(ids, kind="stable")
    ids, first, q = ids[order], first[order], quantise(vectors[order])
    count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    left = np.arange(len(ids)) if same else np.flatnonzero(first)
    right = left if same else np.flatnonzero(~first)
    for x in range(0, len(left), TILE):
        rows_x = left[x : x + TILE]
        a = _part(q, rows_x)
        for y in range(x if same else 0, len(right), TILE):
            rows_y = right[y : y + TILE]
            i, j = linked(a, _part(q, rows_y), threshold)
            if same and x == y:
                i, j = i[i < j], j[i < j]
            if len(i):
                i, j = rows_x[i], rows_y[j]
                count += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                unite(root, i, j)
    has = count > 0
    return ids[has], count[has], ids[root[has]]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vec_id.

    Links are pairs of different ids with a cosine of at least threshold; component_id is the smallest
    id reachable over links, and kept says that it is the vector's own. Vectors that are null, zero or
    hold null or non-finite components have no links, and vectors of different length never link. An
    id that is repeated counts once, with the first of its usable vectors in byte order; rows without
    an id are left out. Other columns are not read.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector")).where("vec_id is not null")
    kind = np.dtype("<f4" if isinstance(vectors.schema[vector_column].dataType.elementType, T.FloatType) else "<f8")

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = []
        for v in batch.column(1):
            values = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(kind)
            packed.append(values.tobytes() if values is not None and np.isfinite(values).all() and values.any() else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["vec_id", "vector"])

    usable = map_batches(rows, pack, "vec_id long, vector binary").where("vector is not null")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.greatest(F.size("vector"), F.lit(0)).cast("long")).alias("components")).first()
    groups = max(LEAST_GROUPS, -(-size.n // GROUP_ROWS), -(-(size.components or 0) * 8 // GROUP_BYTES))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    dealt = usable.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).withColumn("width", F.octet_length("vector"))

    def cell(table: pa.Table) -> pa.Table:
        ids, raw = table["vec_id"].to_numpy(), table["vector"].to_pylist()
        a, b, own = table["a"][0].as_py(), table["b"][0].as_py(), table["own"].to_numpy()
        order = sorted(range(len(raw)), key=lambda k: (ids[k], raw[k]))
        order = [k for p, k in enumerate(order) if not p or ids[order[p - 1]] != ids[k]]
        matrix = np.frombuffer(b"".join(raw[k] for k in order), kind).reshape(len(order), -1).astype(np.float64)
        found = links_in_cell(ids[order], own[order] == a, matrix, a == b, threshold)
        return pa.table(dict(zip(("vec_id", "n", "low"), (pa.array(x, pa.int64()) for x in found), strict=True)))

    found = checkpointed(dealt.select("vec_id", "vector", "own", "a", "b", "width").groupBy("width", "a", "b").applyInArrow(cell, "vec_id long, n long, low long"))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    parts = components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "vec_id")
    out = rows.select("vec_id").distinct().join(counts, "vec_id", "left").join(parts, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
