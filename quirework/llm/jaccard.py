"""N-gram Jaccard self-join of texts by parity sketches, and the classes of texts that it links.

Each shingle is XOR-ed into one of the segments of a text's sketch. Two sketches differ in at most as
many segments as the two sets have shingles in only one of them, so a pair that reaches the threshold
shares a known number of segments, and by the pigeonhole principle at least one. Segments are joined by
size band, the rarest of each text only. What comes together is first compared with the smallest text
of its segment; only where that leaves a segment's texts in several components are they compared with
each other. A second sketch, of parities by bit, comes before whole sets in every comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quirework.llm.common import checkpointed, id_and_text, looked_up, map_batches, narrow, small, texts_of, tune
from quirework.llm.graph import components
from quirework.llm.shingles import mixed, shingles

#: Segments beyond those that a pair at the threshold may differ in, as a share of these.
SPARE = 0.05
#: Sizes of one band differ by this factor at most.
GROWTH = 1.7
BANDS = 60
#: Low bits of a segment's key that hold its band.
BAND_BITS = 6
#: Keys that a map task holds before it writes them out, and those of one part of the join on average.
HELD_KEYS, PART_KEYS = 500_000, 4_000_000
#: Texts whose keys are looked at beforehand, and how many of them make a key a frequent one. Keys of that
#: kind are dealt over all parts and counted by partial sums; it decides the plan, never the result.
PROBED, FREQUENT = 8192, 8
#: Texts in one block of a segment's texts, and rows in a task that compares blocks, on average.
BLOCK_ROWS, TASK_ROWS = 8192, 50_000
#: Nearest partners of one text in one block that the first round chooses from; each further round has so many times more.
PARTNERS = 8

#: A column beside those of the documents, in between only.
_SET = "quirework: hash of the set"

#: A stretch of keys that belong to one text and band.
RUN = np.dtype([("class", "<i8"), ("n", "<i4"), ("spare", "<i4")])


def band_starts(growth: float = GROWTH) -> list[int]:
    """The smallest size of each band."""
    out = [1]
    while len(out) < BANDS:
        out.append(int(out[-1] * growth) + 1)
    return out


_STARTS = np.array(band_starts())


def differences(size_sum: int, percent: int) -> int:
    """How many shingles two sets of so many together may hold alone, if their Jaccard similarity is at least percent / 100."""
    return (100 - percent) * size_sum // (100 + percent)


def segments(band: int, percent: int) -> int:
    """How many segments the sketches of a band have: more than any two of its linked sets differ in."""
    most = differences(2 * (int(_STARTS[band + 1]) - 1), percent)
    return most + 1 - int(-(most + 1) * SPARE // 1)


def sketch_keys(shingle_set: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(band, keys of segments, spare) for each band whose larger sets this one may be linked with.

    The set shares more than spare of these keys with every linked set of the band. Segments without
    shingles, which most sets of a band have in common, are left out as far as the spare ones allow.
    """
    n = len(shingle_set)
    own = int(np.searchsorted(_STARTS, n, "right")) - 1
    for band in (own, own + 1):
        if band > own and 100 * n < percent * _STARTS[band]:
            continue
        largest = min(int(_STARTS[band + 1]) - 1, 100 * n // percent)
        most = differences(n + largest, percent)
        if not most:
            continue  # only equal sets are linked
        count = segments(band, percent)
        spare = count - most - 1
        seed = np.uint64(band * 0x51ED270B)
        place = (mixed(shingle_set + seed) % np.uint64(count)).astype(np.int64)
        parity = np.zeros(count, np.uint64)
        np.bitwise_xor.at(parity, place, mixed(shingle_set ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        key = mixed(mixed(parity) + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed)
        key = (key >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS)) | np.uint64(band)
        empty = np.flatnonzero(np.bincount(place, minlength=count) == 0)[:spare]
        yield band, np.delete(key, empty), spare - len(empty)


def set_hash(shingle_set: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, whatever the order."""
    a = np.add.reduce(mixed(shingle_set ^ np.uint64(0x0123456789ABCDEF)), dtype=np.uint64)
    b = np.bitwise_xor.reduce(mixed(shingle_set + np.uint64(0x6A09E667F3BCC909)), dtype=np.uint64) if len(shingle_set) else np.uint64(0)
    return int(a.view(np.int64)), int(b.view(np.int64))


def identity(shingle_set: np.ndarray, clashes: frozenset[int]) -> tuple[int, int]:
    """(class, more): the two halves of the set's hash; class alone tells sets apart.

    clashes are the first halves that several sets share; their class is made of both halves.
    """
    a, b = set_hash(shingle_set)
    if a in clashes:
        a = int(mixed(np.array([a, b], np.int64).view(np.uint64)).sum(dtype=np.uint64).view(np.int64))
    return a, b


def bits(shingle_set: np.ndarray) -> bytes:
    """Parities of the shingles by bit, two bits or more for each shingle. Two sets differ in at least as many shingles as bits."""
    size = 32
    while size < 2 * len(shingle_set):
        size *= 2
    parity = (np.bincount((shingle_set % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(parity).tobytes()


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes as those that a sketch of so many bytes has."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def may_link(a: bytes, b: bytes, size_sum: int, percent: int) -> bool:
    """Whether two sets of so many shingles together may be linked, by their parities."""
    width = min(len(a), len(b))
    x, y = (folded(np.frombuffer(s, np.uint8)[None, :], width) for s in (a, b))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= differences(size_sum, percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _describe(docs: DataFrame, width: int, percent: int, rate: float, clashes: frozenset[int]) -> DataFrame:
    """(doc_id, n_shingles, class, more, sketch, probe) of each row; probe has the keys of a share of the classes."""
    most = int(rate * 2**64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, width) for t in texts_of(batch.column(1))]
        found = [identity(s, clashes) for s in sets]
        probes = [np.concatenate([k for _, k, _ in sketch_keys(s, percent)] or [s[:0]]).view(np.int64) if len(s) and f[1] % 2**64 < most else None for s, f in zip(sets, found, strict=True)]
        columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([bits(s) for s in sets], pa.binary()), pa.array(probes, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "class", "more", "sketch", "probe"])

    return map_batches(docs, run, "doc_id long, n_shingles long, class long, more long, sketch binary, probe array<long>")


def _keys(docs: DataFrame, width: int, percent: int, parts: int, frequent: np.ndarray, clashes: frozenset[int]) -> DataFrame:
    """(part, keys, runs): the keys of all texts, dealt over parts by key, many to a row.

    Frequent keys are dealt by class over as many further parts.
    """

    def pack(keys: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
        run = np.repeat(np.arange(len(runs)), runs["n"])
        part = ((keys >> np.uint64(BAND_BITS)) % np.uint64(parts)).astype(np.int64)
        if len(frequent):
            often = frequent[np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)] == keys
            part[often] = parts + runs["class"][run[often]] % parts
        order = np.argsort(part, kind="stable")
        keys, part, run = keys[order], part[order], run[order]
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (run[1:] != run[:-1])]))
        stretches = runs[run[first]]
        stretches["n"] = np.diff(np.append(first, len(keys)))
        names, start = np.unique(part, return_index=True)
        at = np.searchsorted(first, start)
        ends, at_ends = [*start[1:].tolist(), len(keys)], [*at[1:].tolist(), len(first)]
        packed = [[keys[s:e].tobytes() for s, e in zip(start.tolist(), ends, strict=True)], [stretches[s:e].tobytes() for s, e in zip(at.tolist(), at_ends, strict=True)]]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], ["part", "keys", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        keys: list[np.ndarray] = []
        runs: list[tuple[int, int, int]] = []
        held = 0
        for batch in batches:
            for text in texts_of(batch.column(1)):
                s = shingles(text, width)
                own = identity(s, clashes)
                if not len(s) or own in seen:
                    continue
                if len(seen) >= HELD_KEYS:
                    seen.clear()
                seen.add(own)
                for _, key, spare in sketch_keys(s, percent):
                    keys.append(key)
                    runs.append((own[0], len(key), spare))
                    held += len(key)
                if held >= HELD_KEYS:
                    yield pack(np.concatenate(keys), np.array(runs, RUN))
                    keys, runs, held = [], [], 0
        if held:
            yield pack(np.concatenate(keys), np.array(runs, RUN))

    tune(docs.sparkSession)
    return docs.mapInArrow(run, "part long, keys binary, runs binary")


def _shared(packed: DataFrame, parts: int) -> DataFrame:
    """(key, class, spare, freq) of the keys that several classes have; freq is null for the frequent keys."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
        runs = np.frombuffer(b"".join(table["runs"].to_pylist()), RUN)
        order = np.argsort(keys)
        twice = keys[order[1:]] == keys[order[:-1]]
        often = table["part"][0].as_py() >= parts
        some = order if often else order[np.concatenate([[False], twice]) | np.concatenate([twice, [False]])] if len(order) else order
        own = np.repeat(np.arange(len(runs)), runs["n"])[some]
        keys, classes, spare = keys[some], runs["class"][own], runs["spare"][own]
        order = np.lexsort((classes, keys))
        keys, classes, spare = keys[order], classes[order], spare[order]
        once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])])[: len(keys)]
        keys, classes, spare = keys[once], classes[once], spare[once]
        _, at, freq = np.unique(keys, return_inverse=True, return_counts=True)
        freq = freq[at] if len(keys) else np.zeros(0, np.int64)
        if not often:
            several = freq > 1
            keys, classes, spare, freq = keys[several], classes[several], spare[several], freq[several]
        counts = pa.nulls(len(keys), pa.int64()) if often else pa.array(freq, pa.int64())
        return pa.table({"key": pa.array(keys.view(np.int64)), "class": pa.array(classes), "spare": pa.array(spare), "freq": counts})

    return packed.groupBy("part").applyInArrow(run, "key long, class long, spare int, freq long")


def candidates(docs: DataFrame, width: int, percent: int, parts: int, frequent: np.ndarray, clashes: frozenset[int]) -> DataFrame:
    """(key, class): the segments of which every linked pair of different sets shares one.

    Such a pair shares more segments than either class has to spare. With a class's segments ordered
    by frequency, the rarest shared one is therefore among all but the last spare ones of both.
    """
    found = checkpointed(_shared(_keys(docs, width, percent, parts, frequent, clashes), parts))
    if len(frequent):
        often = found.where("freq is null").drop("freq")
        # One row for each frequent key, of which there are at most PROBED / FREQUENT times a text's keys.
        counts = often.groupBy("key").agg(F.count("*").alias("freq")).where("freq > 1")
        found = found.where("freq is not null").unionByName(often.join(F.broadcast(counts), "key"))
    own = Window.partitionBy("class", "band")
    ranked = found.withColumn("band", F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1)))
    ranked = ranked.withColumn("rank", F.row_number().over(own.orderBy("freq", "key"))).withColumn("n", F.count("*").over(own))
    return checkpointed(ranked.where(F.col("rank") <= F.col("n") - F.col("spare")).select("key", "class"))


def _several(rare: DataFrame) -> DataFrame:
    """(key, class, least, n) of the segments of several classes, with the smallest of these and how many there are."""
    of_key = rare.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("high"), F.count("*").alias("n")).where("least <> high").drop("high")
    return checkpointed(rare.join(of_key, "key").select("key", "class", "least", "n"))


def _stars(several: DataFrame) -> DataFrame:
    """(a, b): each class of a segment with the segment's smallest one."""
    return several.where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b")).distinct()


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that the parities let through."""
    of = lambda end: sketches.select(F.col("class").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}"))
    both = pairs.join(of("a"), "a").where(F.col("n_a") > 0).join(of("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, n, x, y = (c.to_pylist() for c in batch.columns)
        keep = [may_link(s, t, total, percent) for total, s, t in zip(n, x, y, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (a, b)], ["a", "b"])

    return map_batches(both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "s_a", "s_b"), run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, width: int, percent: int, clashes: frozenset[int]) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are linked. Only the texts of these classes are read again."""
    pairs = checkpointed(pairs)
    n = pairs.count()
    pairs = narrow(pairs, n)
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = small(texts.join(looked_up(ends, 2 * n), "class").select("class", "doc_id"))

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        # An id may stand for several texts; only the class that was asked for counts.
        found = [(c, s.tobytes()) for c, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True) if identity(s := shingles(t, width), clashes)[0] == c]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["class", "shingles"])

    sets = map_batches(docs.join(wanted, "doc_id").select("class", "text"), sets_of, "class long, shingles binary").groupBy("class").agg(F.first("shingles").alias("shingles"))
    of = lambda end: sets.select(F.col("class").alias(end), F.col("shingles").alias(f"s_{end}"))

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (a, b)], ["a", "b"])

    return checkpointed(map_batches(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "s_a", "s_b"), check, "a long, b long"))


def near_in_block(classes: np.ndarray, parts: np.ndarray, sizes: np.ndarray, sketches: list[bytes], first: np.ndarray, same: bool, percent: int, partners: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(a, b) of two blocks' classes in different parts that the parities let through, and which classes have pairs left out.

    first marks the classes of the first block; same says that there is one block only. Of the nearest
    partners of each class only those are given that connect parts, nearest first: one forest over the
    parts, and further ones as partners grows. Both ends of a pair that was left out are marked, for a later round.
    """
    order = np.argsort(sizes, kind="stable")
    width = np.array([len(s) for s in sketches])
    by_width = {w: folded(np.frombuffer(b"".join(sketches[k] for k in np.flatnonzero(width == w)), np.uint8).reshape(-1, w), w) for w in np.unique(width).tolist()}
    at_width = {w: np.flatnonzero(width == w) for w in by_width}
    row = np.zeros(len(sizes), np.int64)
    for rows in at_width.values():
        row[rows] = np.arange(len(rows))
    pairs: list[tuple[float, int, int]] = []
    left_out = np.zeros(len(sizes), bool)
    right = order if same else order[~first[order]]
    of_width = {w: right[width[right] == w] for w in by_width}
    rows_of = {w: by_width[w][row[r]] for w, r in of_width.items()}
    for i in order if same else order[first[order]]:
        n, near, apart = sizes[i], [], []
        for w, others in of_width.items():
            # In one block each pair is looked at from its smaller set, or from either if they are equal.
            low = int(np.searchsorted(sizes[others] * 100, 100 * n if same else percent * n, "left"))
            high = int(np.searchsorted(sizes[others] * percent, 100 * n, "right"))
            if low >= high:
                continue
            narrow = min(w, width[i])
            own = folded(by_width[width[i]][row[i]][None, :], narrow)
            some = others[low:high]
            difference = np.bitwise_count(folded(rows_of[w][low:high], narrow) ^ own).sum(axis=1, dtype=np.int64)
            may = (difference <= (100 - percent) * (sizes[some] + n) // (100 + percent)) & (parts[some] != parts[i])
            near.append(some[may])
            apart.append(difference[may] / (sizes[some[may]] + n))
        if near and len(found := np.concatenate(near)):
            distance = np.concatenate(apart)
            nearest = np.argsort(distance, kind="stable")
            if len(found) > partners:
                left_out[i] = left_out[found[nearest[partners:]]] = True
            pairs += [(float(distance[k]), int(i), int(found[k])) for k in nearest[:partners]]
    pairs.sort()
    out, forests = [], max(1, partners // PARTNERS)
    while pairs and forests:
        forests -= 1
        root: dict[int, int] = {}
        rest = []
        for pair in pairs:
            x, y = (_root(root, int(parts[k])) for k in pair[1:])
            if x == y:
                rest.append(pair)
            else:
                root[max(x, y)] = min(x, y)
                out.append(pair)
        pairs = rest
    for _, i, j in pairs:
        left_out[i] = left_out[j] = True
    return [(int(classes[i]), int(classes[j])) for _, i, j in out], left_out


def _root(root: dict[int, int], x: int) -> int:
    while (up := root.get(x, x)) != x:
        root[x] = root.get(up, up)
        x = up
    return x


def _residual(several: DataFrame, member: DataFrame, members: int, sketches: DataFrame, percent: int, partners: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs that may be linked, of the segments whose classes are in several components; and the rows that left pairs out.

    Components only grow and the parities stay, so a later round finds its pairs between such rows of a segment: of all others every
    pair that the parities let through was given.

    several is (key, class); segments of two classes were compared as stars and aren't among it. Of segments
    with the same classes one stands for all. A segment of many classes is compared block by block; no pair is written that the parities exclude.
    """
    of_class = looked_up(member.select(F.col("node").alias("class"), "component"), members)
    rows = several.join(of_class, "class", "left").withColumn("part", F.coalesce("component", "class")).drop("component")
    alike = [F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("y")]
    apart = rows.groupBy("key").agg(*alike, F.count("*").alias("left"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    apart = apart.groupBy("x", "y", "left").agg(F.min("key").alias("key")).select("key", "left")
    # One row a key, so this join only keeps or leaves rows; nothing is made by it.
    rows = checkpointed(rows.join(apart, "key").withColumn("blocks", F.ceil(F.col("left") / BLOCK_ROWS).cast("int")))
    tasks = max(12, -(-(rows.agg(F.sum("blocks")).first()[0] or 0) // TASK_ROWS))
    rows = rows.join(sketches, "class").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).withColumn("task", F.pmod(F.xxhash64("key", "x", "y"), F.lit(tasks)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("x", "ascending"), ("y", "ascending")])
        key, x, y, block, classes, parts, sizes = (table[c].to_numpy() for c in ("key", "x", "y", "block", "class", "part", "n_shingles"))
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        sketches = table["sketch"].to_pylist()
        pairs: list[tuple[int, int]] = []
        left: list[tuple[int, list[int]]] = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
            own = slice(s, e)
            found, left_out = near_in_block(classes[own], parts[own], sizes[own], sketches[own], block[own] == x[s], x[s] == y[s], percent, partners)
            pairs += found
            if left_out.any():
                left.append((int(key[s]), classes[own][left_out].tolist()))
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        segment, again = zip(*left, strict=True) if left else ((), ())
        ends = [pa.array([*a, *[None] * len(left)], pa.int64()), pa.array([*b, *[None] * len(left)], pa.int64())]
        return pa.table([*ends, pa.array([*[None] * len(a), *segment], pa.int64()), pa.array([*[None] * len(a), *again], pa.list_(pa.int64()))], names=["a", "b", "key", "again"])

    # A row is a pair, or a segment with the classes of two of its blocks that left pairs out.
    found = checkpointed(dealt.select("task", "key", "x", "y", "block", "class", "part", "n_shingles", "sketch").groupBy("task").applyInArrow(run, "a long, b long, key long, again array<long>"))
    again = found.where("key is not null").select("key", F.explode("again").alias("class"))
    return found.where("key is null").select("a", "b"), checkpointed(again.distinct())


def _grouped(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, class, more, component_id) of each row of (doc_id, text), as classes() says."""
    docs = id_and_text(documents)
    n = docs.count()
    rate, clashes = min(1.0, PROBED / max(1, n)), frozenset()
    while True:
        rows = checkpointed(_describe(docs, width, percent, rate, clashes))
        texts = rows.where("doc_id is not null and n_shingles > 0").groupBy("class", "more").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
        # Two of n sets share a first half once in 2^64 / n^2 cases: none to a few, whatever the corpus.
        more = texts.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class").collect()
        if not more:
            break
        clashes |= {r["class"] for r in more}
    texts = checkpointed(texts.select("class", "doc_id", "n_shingles", "sketch"))
    probed = rows.where("probe is not null and doc_id is not null").dropDuplicates(["class"]).select(F.explode("probe").alias("key"))
    frequent = np.array(sorted(r.key % 2**64 for r in probed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).select("key").collect()), np.uint64)
    total = texts.agg(F.sum("n_shingles")).first()[0] or 0
    keys = total * 4 * (100 - percent) // (100 + percent)
    parts = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys // PART_KEYS))
    rare = candidates(docs.where("doc_id is not null"), width, percent, parts, frequent, clashes)
    sketches = texts.select("class", "n_shingles", "sketch")
    of_class = texts.select("class", "doc_id")
    several = _several(rare)
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    tried = checkpointed(_sketched(_stars(several), sketches, percent).select(*ordered).distinct())
    links = _verified(tried, of_class, docs, width, percent, clashes)
    member = components(links)
    partners = PARTNERS
    several = several.where("n > 2").select("key", "class")
    while True:
        near, several = _residual(several, member, member.count(), sketches, percent, partners)
        pairs = checkpointed(near.select(*ordered).distinct().join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(pairs)
        if pairs.limit(1).count():
            more_links = _verified(pairs, of_class, docs, width, percent, clashes)
            if more_links.limit(1).count():
                links = links.unionByName(more_links)
                member = components(links)
        if not several.limit(1).count():
            break
        partners *= PARTNERS
    placed = of_class.join(member.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("least"))
    placed = placed.join(least, "component").select("class", "least")
    out = rows.select("doc_id", "n_shingles", "class", "more").join(placed, "class", "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "class", "more", component.alias("component_id"))


def classes(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text).

    n_shingles is the size of the set of word shingles; texts link when the Jaccard similarity of
    their sets is at least percent / 100, and component_id is the smallest doc_id reachable over
    links. A null or wordless text has no shingles and is linked with nothing; a text with fewer words than a
    shingle has its whole sequence as one. Rows that repeat a doc_id stay, and are linked like any
    others, each by its own text. A row without an id keeps its size, has a null component and links with
    nothing. An empty table gives no rows. Other columns are not read.
    """
    return _grouped(documents, width, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id stays.

    Where rows repeat a doc_id, each is judged by its own text; of those that repeat a doc_id and its
    text one stays. Rows without an id and rows without words stay. All columns pass through, whatever
    their names; an empty table gives no rows.
    """
    found = checkpointed(_grouped(documents, width, percent))
    counted = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("component_id") != F.col("doc_id")).alias("goes"))
    gone = small(counted.where("n = 1 and goes").select("doc_id"))
    repeated = small(counted.where("n > 1").select("doc_id"))
    names = documents.columns
    own_id = documents["doc_id"].cast("long")
    left = documents.join(gone, own_id == gone["doc_id"], "left_anti").join(repeated, own_id == repeated["doc_id"], "left_anti")
    if not repeated.limit(1).count():
        return left.select(*names)
    at_text = names.index("text")
    several = documents.join(repeated, own_id == repeated["doc_id"], "left_semi").dropDuplicates(["doc_id", "text"])

    def tell(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [set_hash(shingles(t, width))[1] for t in texts_of(batch.column(at_text))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, _SET])

    told = map_batches(several, tell, T.StructType([*several.schema.fields, T.StructField(_SET, T.LongType())]))
    stay = found.join(repeated.select("doc_id"), "doc_id", "left_semi").where("component_id = doc_id").select("doc_id", "more").distinct()
    mine = told.join(stay, (told["doc_id"].cast("long") == stay["doc_id"]) & (told[_SET] == stay["more"]), "left_semi")
    return left.select(*names).unionByName(mine.select(*names))
