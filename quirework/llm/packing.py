"""Best-fit packing of token sequences by bin completion.

Only lengths matter for a packing, so it is planned on their histogram: at most as many counts as
a sequence has tokens, however many pieces there are. Each step takes the largest length left and a
filling around it that no other dominates, and uses it as often as the counts allow. A best-fit
decreasing packing is the first incumbent; branches whose waste cannot lead below the incumbent are
cut. Pieces then find their places by their rank among those of the same length.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.llm.common import checkpointed, id_and_text, map_batches, texts_of
from quirework.llm.wordbpe import word_bpe

CAPACITY = 2048
END_ID = 0
#: Steps of the search at most: a length looked at for a filling is one, a part of a packing NODE_STEPS.
STEPS, NODE_STEPS = 5_000_000, 100
#: Pieces that get their rank in one task, on average.
RANK_ROWS = 200_000

Pattern = tuple[tuple[int, int], ...]  # (length, how often) in a sequence


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used, when each piece goes where it leaves the least room."""
    bins: dict[int, dict[Pattern, int]] = {}

    def put(pattern: Pattern, room: int, length: int, many: int, times: int) -> None:
        at = bins.setdefault(room - many * length, {})
        pattern = (*pattern, (length, many))
        at[pattern] = at.get(pattern, 0) + times

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            rooms = [r for r in bins if r >= length and bins[r]]
            if not rooms:
                many = capacity // length
                if times := left // many:
                    put((), capacity, length, many, times)
                if left % many:
                    put((), capacity, length, left % many, 1)
                break
            room = min(rooms)
            many = room // length
            pattern, available = next(iter(bins[room].items()))
            times = min(available, left // many)
            if not times:
                many, times = left, 1
            bins[room][pattern] -= times
            if not bins[room][pattern]:
                del bins[room][pattern]
            put(pattern, room, length, many, times)
            left -= many * times
    return [(p, n) for at in bins.values() for p, n in at.items()]


def bits_of(rows: np.ndarray) -> int:
    """The places of the rows that are true, as bits of a number."""
    return int.from_bytes(np.packbits(rows, bitorder="little").tobytes(), "little")


def smear(bits: int, width: int) -> int:
    """The places up to width above those of the bits."""
    out, have = bits << 1 if width else 0, 1
    while have < width:
        step = min(have, width - have)
        out |= out << step
        have += step
    return out


def fillings(counts: np.ndarray, room: int, budget: Budget) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of the room, one by one, the fullest and then those with larger pieces first.

    A piece that is left over dominates some of a filling's pieces if it could take their place and is
    longer than they are together, or as long as two or more of them. So every filling that another betters
    piece by piece is passed over, and what stays free is too little for any piece left. Sums of a
    filling's pieces are bits of a number, and so are the lengths left over.
    """
    left = counts[: room + 1].copy()
    left[0] = 0
    lengths = np.flatnonzero(left)[::-1].tolist()
    if not lengths:
        yield ()
        return
    available, reach = bits_of(left > 0), 0

    def extend(rest: int, at: int, taken: tuple[int, ...], sums: int, over: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
        """Ways to add pieces from lengths[at:] that sum to rest, with the sums of subsets and the lengths left over."""
        if rest == 0:
            yield taken, sums, over
            return
        for k in range(bisect.bisect_left(lengths, -rest, lo=at, key=lambda x: -x), len(lengths)):
            piece = lengths[k]
            budget.spend(1)
            if budget.left <= 0:
                return
            used = taken.count(piece)
            if used >= left[piece] or not reach >> (rest - piece) & 1:
                continue
            after = over & ~(1 << piece) if used + 1 == left[piece] else over
            added = sums << piece
            if added & after:
                continue
            yield from extend(rest - piece, k, (*taken, piece), sums | added | 1 << piece, after)

    for total in range(room, 0, -1):
        if available >> total & 1:
            after = available & ~(1 << total) if left[total] == 1 else available
            if not smear(1 | 1 << total, room - total) & after:
                yield (total,)
            if total == room:
                return
        if not reach:
            reach = 1
            budget.spend(len(lengths))
            for length in reversed(lengths):
                step = 0 if reach >> length & 1 else length
                while 0 < step <= room:
                    reach |= reach << step & (2 << room) - 1
                    step *= 2
        if reach >> total & 1:
            for taken, sums, over in extend(total, 0, (), 0, available):
                if len(taken) > 1 and not smear(sums | 1, room - total) & over:
                    yield taken
        if budget.left <= 0:
            return


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: for each k, pieces over half share theirs only with what fits, and pieces under k count for nothing."""
    lengths = np.arange(capacity + 1)
    many, size = np.cumsum(counts), np.cumsum(counts * lengths)
    half = capacity // 2
    k = np.arange(half + 1)
    large = many[-1] - many[half]
    # Pieces over capacity - k share with nothing of at least k; others over half do.
    sharing = many[capacity - k] - many[half]
    room = sharing * capacity - (size[capacity - k] - size[half])
    small = size[half] - np.where(k > 0, size[np.maximum(k - 1, 0)], 0)
    return int((large + np.maximum(0, -((room - small) // capacity))).max())


@dataclass
class Budget:
    """Steps that a search may still take."""

    left: int

    def spend(self, steps: int) -> None:
        self.left -= steps


@dataclass
class Node:
    """A part of a packing: sequences and waste so far, the uses that led here, their number, and how many uses were tried after them.

    What is left is worked out again from the uses when a node is returned to, so that an open one takes few bytes.
    """

    used: int
    waste: int
    path: tuple | None
    depth: int
    tried: int = 0


def without(counts: np.ndarray, path: tuple | None) -> np.ndarray:
    """The counts that are left after the uses of a path."""
    left = counts.copy()
    while path:
        path, (pattern, times) = path
        for length, many in pattern:
            left[length] -= many * times
    return left


def uses(left: np.ndarray, capacity: int, budget: Budget) -> Iterator[tuple[Pattern, int]]:
    """Undominated fillings around the largest piece, each as often as the counts allow; then each of them less often."""
    largest = int(np.flatnonzero(left)[-1])
    rest = left.copy()
    rest[largest] -= 1
    seen = []
    for filling in fillings(rest, capacity - largest, budget):
        values, many = np.unique((largest, *filling), return_counts=True)
        times = int((left[values] // many).min())
        seen.append((tuple(zip(values.tolist(), many.tolist(), strict=True)), times))
        yield seen[-1]
    for pattern, times in seen:
        for fewer in range(times - 1, 0, -1):
            yield pattern, fewer


def plan(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[Pattern, int]]:
    """A packing of counts[length] pieces of each length into few sequences.

    Branch and bound from the best-fit packing. Each descent takes the first use of every node; the next
    one starts with another use of a node on the way of earlier ones, in turns the one nearest the
    root and the one nearest the end. Branches whose waste can't lead below the incumbent are cut. The search
    ends when the incumbent meets the lower bound, when nothing is left to try, or after the given steps.
    """
    counts = counts.astype(np.int64)
    total = int((counts * np.arange(capacity + 1)).sum())
    bound, incumbent, budget = lower_bound(counts, capacity), best_fit_decreasing(counts, capacity), Budget(steps)
    fewest = sum(n for _, n in incumbent)
    if fewest <= bound:
        return incumbent
    open_nodes, order, turn, made = {0: Node(0, 0, None, 0)}, ([(0, 0)], [(0, 0)]), 0, 0
    while open_nodes and fewest > bound and budget.left > 0:
        turn += 1
        heap = order[turn % 2]
        key = heapq.heappop(heap)[1]
        if (node := open_nodes.get(key)) is None:
            continue
        heapq.heappush(heap, (node.depth if turn % 2 == 0 else -node.depth, key))
        left = without(counts, node.path)
        budget.spend(node.depth)
        while budget.left > 0:
            budget.spend(NODE_STEPS)
            use = next(itertools.islice(uses(left, capacity, budget), node.tried, None), None)
            node.tried += 1
            if use is None or node.waste > (fewest - 1) * capacity - total:
                open_nodes.pop(key, None)
                break
            pattern, times = use
            for length, many in pattern:
                left[length] -= many * times
            waste = node.waste + times * (capacity - sum(length * many for length, many in pattern))
            used, path = node.used + times, (node.path, use)
            if not left.any():
                if used < fewest:
                    fewest, incumbent = used, []
                    while path:
                        path, step = path
                        incumbent.append(step)
                break
            if waste > (fewest - 1) * capacity - total:
                break
            node = Node(used, waste, path, node.depth + 1)
            key = made = made + 1
            open_nodes[key] = node
            heapq.heappush(order[0], (node.depth, key))
            heapq.heappush(order[1], (-node.depth, key))
    return incumbent


@dataclass
class Places:
    """For each length, in the order of rank: where a range of ranks begins, its first sequence, pieces in each, and offset."""

    start: dict[int, np.ndarray]
    rows: dict[int, np.ndarray]


def places(patterns: list[tuple[Pattern, int]]) -> Places:
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        merged: dict[int, int] = {}
        for length, many in pattern:
            merged[length] = merged.get(length, 0) + many
        for length, many in merged.items():
            ranges.setdefault(length, []).append((taken.get(length, 0), sequence, many, offset))
            taken[length] = taken.get(length, 0) + many * times
            offset += length * many
        sequence += times
    return Places({k: np.array([r[0] for r in v]) for k, v in ranges.items()}, {k: np.array(v) for k, v in ranges.items()})


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and an end id, cut where they exceed the capacity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, out = batch.column(0).to_pylist(), []
        end = END_ID.to_bytes(4, "little")
        for doc, ids in zip(docs, word_bpe(path).encode(texts_of(batch.column(1))), strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(id_and_text(documents), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each row of (doc_id, text).

    path: a tokenizers file that every executor has. A null or empty text is the end id alone. Rows
    that repeat a doc_id, or have none, are packed like any others. Other columns are not read.
    """
    cut = checkpointed(pieces(documents, path, capacity))
    n = cut.count()
    salts = max(16, -(-n // RANK_ROWS))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = checkpointed(cut.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    found = places(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(firsts, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for value in np.unique(length).tolist():
            rows = length == value
            table = found.rows[value][np.searchsorted(found.start[value], rank[rows], "right") - 1]
            within = rank[rows] - table[:, 0]
            sequence[rows] = table[:, 1] + within // table[:, 2]
            offset[rows] = table[:, 3] + within % table[:, 2] * value
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_batches(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
