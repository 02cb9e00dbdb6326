"""How filters of a corpus act on each other, from one sort of the texts.

Texts are sorted by range of their fingerprint and id, within a task by fingerprint, whole text and
id, and each is compared with the one before it. A task whose first texts may have begun in the task
before marks them with a digest of the text, and every task states at its end where its last texts
began; the marks meet in a join of a few rows a task. What is left of a document is a mask of the
filters that it fails. Counts by part and mask are sums, and all orders of the filters follow from them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import checkpointed, looked_up, tune

#: Filters in the order of their bits.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, b"#$%&*|"
CAPITALS = bytes(range(65, 91))


def own_mask(text: bytes, points: int) -> int:
    """The filters A to D that a text of so many code points fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * points) << 2
        | (len(text.translate(None, SIGNS)) < len(text)) << 3
    )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of a task's sorted rows. An edge is the digest of a text that may have begun in the task before.

    Rows at the end have no mask of their own (-1): each gives the smallest id here of a text of the last fingerprint.
    """
    fingerprint, text, first, digest, opened = None, None, None, None, True
    ends: dict[bytes, int] = {}
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("edge", pa.binary())])
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        points = pc.utf8_length(texts.cast(pa.string())).to_pylist()
        masks, edges = [], []
        for x, t, n, doc in zip(batch.column("fingerprint").to_pylist(), texts.to_pylist(), points, ids, strict=True):
            if x != fingerprint:
                opened = fingerprint is None
                fingerprint, text, ends = x, None, {}
            if t != text:
                text, first, digest = t, None, hashlib.sha256(t).digest() if opened else None
                mask = own_mask(t, n)
            if first is None and doc is not None:
                first = ends[t] = doc
            masks.append(mask | (COPY if first is not None and doc is not None and doc > first else 0))
            edges.append(digest)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(edges, pa.binary())], schema=schema)
    if ends:
        digests = [hashlib.sha256(t).digest() for t in ends]
        yield pa.RecordBatch.from_pylist([{"doc_id": doc, "part": None, "mask": -1, "edge": d} for d, doc in zip(digests, ends.values(), strict=True)], schema=schema)


def masks(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(doc_id, part, mask) of each row: the filters that it fails, as bits in the order of FILTERS.

    A null text or part counts as empty. A row fails E if a smaller id has the same text, so rows that repeat
    both id and text don't fail by each other, and rows without an id never do. Other columns are not read.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        text.cast("binary").alias("text"),
        F.xxhash64(text).alias("fingerprint"),
    )
    tune(documents.sparkSession)
    # Bounds of the ranges come from a sample of fingerprints and ids, never of texts.
    ordered = rows.repartitionByRange("fingerprint", "doc_id").sortWithinPartitions("fingerprint", "text", "doc_id")
    found = checkpointed(ordered.mapInArrow(_compared, "doc_id long, part string, mask int, edge binary"))
    started = found.where("mask < 0").groupBy("edge").agg(F.min("doc_id").alias("started"))
    closed = found.where("mask >= 0 and edge is null").select("doc_id", "part", "mask")
    opened = found.where("mask >= 0 and edge is not null").join(looked_up(started, found.where("mask < 0").count()), "edge", "left")
    later = F.coalesce(F.col("doc_id") > F.col("started"), F.lit(False))
    return closed.unionByName(opened.select("doc_id", "part", F.when(later, F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")).alias("mask")))


def counts(masked: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those with a label of good quality and of toxicity.

    An id with several labels is good, or toxic, if any of them says so; rows without an id have no label.
    """
    marks = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    joined = masked.join(marks, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")))


def interactions(counted: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order and step.

    Counts of the 32 masks are summed to those of the 32 sets of filters that a document may have to pass.
    """
    sets, bits = range(1 << len(FILTERS)), [1 << k for k in range(len(FILTERS))]
    passed = lambda column: F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(column)).otherwise(0)) for s in sets))
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    parts = counted.groupBy("part").agg(
        *(passed(c).alias(c) for c in ("n", "good", "toxic")),
        F.array(*(F.sum(F.when(F.col("mask") == b, F.col("n")).otherwise(0)) for b in bits)).alias("only"),
        # Each of the filters that a document fails removes it in the same share of all orders.
        F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(b) != 0, F.col("n") * (F.lit(len(orders)) / F.bit_count("mask")).cast("long")).otherwise(0)) for b in bits)).alias("shares"),
    )
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    taken = lambda n: sum((F.when(F.substring("filter_order", F.lit(1), n).contains(f), b).otherwise(0) for f, b in zip(FILTERS, bits, strict=True)), F.lit(0))
    steps = steps.withColumn("before", taken(F.col("step") - 1)).withColumn("after", taken(F.col("step")))
    steps = steps.withColumn("place", F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))))
    at = lambda c, s: F.get(F.col(c), F.col(s))
    fails = F.get("n", F.lit(0)) - F.get("n", F.call_function("shiftleft", F.lit(1), F.col("place") - 1))
    removed = at("n", "before") - at("n", "after")
    return steps.select(
        "part",
        "filter_order",
        "step",
        at("n", "after").alias("kept"),
        removed.alias("removed"),
        (fails - removed).alias("redundant"),
        F.element_at("only", F.col("place")).alias("unique_fails"),
        (at("good", "before") - at("good", "after")).alias("good_lost"),
        (at("toxic", "before") - at("toxic", "after")).alias("toxic_lost"),
        F.element_at("shares", F.col("place")).alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The filters' interactions for each source of the documents; an empty table has no parts and no rows."""
    return interactions(counts(masks(documents), labels))


def oracle_sql() -> str:
    space = r"[^\x20\x09-\x0D]+"
    orders = ", ".join(f"'{''.join(p)}'" for p in itertools.permutations(FILTERS))
    return rf"""
    with texts as (
        select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{space}') as words, min(doc_id) over (partition by coalesce(text, '')) as first_id from documents
    ), failed as (
        select part, doc_id, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
            regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] as f from texts
    ), marks as (
        select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id
    ), rows as (
        select part, f, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic, len(list_filter(f, lambda x: x)) as fails from failed left join marks using (doc_id) group by part, f
    ), steps as (
        select o as filter_order, s::int as step, instr('ABCDE', o[s]) as own, list_transform(range(1, s), lambda k: instr('ABCDE', o[k])) as earlier from (select unnest([{orders}]) as o), range(1, 6) r(s)
    ), judged as (
        select part, filter_order, step, n, good, toxic, fails, f[own] as fails_own, len(list_filter(earlier, lambda k: f[k])) > 0 as gone from rows, steps
    )
    select part, filter_order, step,
        coalesce(sum(n) filter (where not gone and not fails_own), 0)::bigint as kept,
        coalesce(sum(n) filter (where not gone and fails_own), 0)::bigint as removed,
        coalesce(sum(n) filter (where gone and fails_own), 0)::bigint as redundant,
        coalesce(sum(n) filter (where fails_own and fails = 1), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (where not gone and fails_own), 0)::bigint as good_lost,
        coalesce(sum(toxic) filter (where not gone and fails_own), 0)::bigint as toxic_lost,
        coalesce(sum(n * 120 // greatest(fails, 1)) filter (where fails_own), 0)::bigint as shapley
    from judged group by all"""
