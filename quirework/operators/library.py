"""The document library: ranked prefix search with snippets, catalogue upserts, recents, bookmarks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions.text import html_escaped, tokens

#: BM25's parameters.
K1, B = 1.2, 0.75
SNIPPET_TOKENS = 22

AVAILABLE, UNAVAILABLE, REMOVED, MOVED = "available", "temporarily_unavailable", "user_removed", "moved"


def search_words(text: str) -> list[str]:
    """The words of a search, each a prefix that every hit must have; none for an empty search."""
    return [w for part in re.findall(r"\w+", text.strip()) for w in re.findall(r"[^\W_]+", part.lower())]


def postings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, size, token, tf): an inverted index of the documents, partial counts first."""
    words = documents.select(key, tokens(F.col(text)).alias("words"))
    return words.select(key, F.size("words").alias("size"), F.explode("words").alias("token")).groupBy(key, "size", "token").agg(F.count("*").alias("tf"))


def bm25(documents: DataFrame, key: str, text: str, search: str) -> DataFrame:
    """(key, rank) of the documents that have every word as a prefix; smaller ranks are better.

    A scan keeps the documents that hold each prefix at the start of a word, so only their counts are
    made. The two statistics of the corpus that the formula needs come from one pass over the texts.
    """
    words = search_words(search)
    if not words:
        return documents.select(key, F.lit(0.0).alias("rank")).where("false")
    listed = documents.select(key, tokens(F.col(text)).alias("words"))
    tf = map(_prefix_count, words)
    counted = listed.select(key, F.size("words").alias("size"), *(c.alias(f"tf{k}") for k, c in enumerate(tf)))
    totals = counted.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(words)))).first()
    hits = counted
    rank = F.lit(0.0)
    for k in range(len(words)):
        df = totals[f"df{k}"]
        idf = F.greatest(F.log((F.lit(float(totals.n)) - df + 0.5) / (F.lit(float(df)) + 0.5)), F.lit(1e-6))
        f = F.col(f"tf{k}")
        hits = hits.where(f > 0)
        rank = rank - idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("size") / F.lit(totals.mean)))
    return hits.select(key, rank.alias("rank"))


def _prefix_count(prefix: str) -> Column:
    return F.size(F.filter("words", lambda x: x.startswith(prefix)))


def snippet(text: Column, words: list[str], length: int = SNIPPET_TOKENS) -> Column:
    """So many words around the first hit, HTML escaped, with the hits marked and dots where text is left out."""
    parts = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    pattern = rf"(?i)^[^\p{{L}}\p{{N}}]*(?:{'|'.join(map(re.escape, words))})"
    at = F.coalesce(F.array_position(F.transform(parts, lambda x: x.rlike(pattern)), F.lit(True)), F.lit(0))
    first = F.greatest(F.lit(1), at - length // 2).cast("int")
    marked = F.transform(F.slice(parts, first, F.lit(length)), lambda x: F.when(x.rlike(pattern), F.concat(F.lit("<mark>"), html_escaped(x), F.lit("</mark>"))).otherwise(html_escaped(x)))
    before = F.when(first > 1, "...").otherwise("")
    after = F.when(F.size(parts) >= first + length, "...").otherwise("")
    return F.concat(before, F.array_join(marked, " "), after)


def shown(status: Column) -> Column:
    """The soft-delete filter: a null status counts as present."""
    return status.isNull() | (status != REMOVED)


def availability(status: Column, exists: Column) -> Column:
    """What a status is after a look for the file: only "available" gives way to a missing file."""
    status = F.coalesce(status, F.when(exists, AVAILABLE).otherwise(UNAVAILABLE))
    return F.when(~exists & (status == AVAILABLE), UNAVAILABLE).otherwise(status)


# Which columns each kind of write changes where the key is there already.
ON_CONFLICT = {
    "metadata": ("file_name", "file_size", "page_count", "last_accessed", "availability_status"),
    "full": ("file_name", "file_size", "page_count", "last_accessed", "availability_status"),
    "markdown": ("markdown_path", "is_converted", "last_accessed", "availability_status", "index_status"),
    "failure": ("markdown_path", "is_converted", "last_accessed", "index_status"),
    "session": ("last_page_read", "preferred_zoom", "last_accessed"),
}


def upsert(catalogue: DataFrame, changes: DataFrame, kind: str, key: str = "file_path") -> DataFrame:
    """The catalogue after writes of one kind; of writes to one key that with the largest seq holds.

    A new key takes the whole row. "metadata" keeps a known size where the new one isn't positive.
    """
    names = [c for c in catalogue.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*names), "seq").alias("new"))
    merged = catalogue.select(key, F.struct(*names).alias("old")).join(last, key, "full_outer")

    def value(name: str) -> Column:
        old, new = F.col(f"old.{name}"), F.col(f"new.{name}")
        taken = new if name in ON_CONFLICT[kind] else old
        if kind == "metadata" and name == "file_size":
            taken = F.when(new > 0, new).otherwise(old)
        return F.when(F.col("old").isNull(), new).when(F.col("new").isNull(), old).otherwise(taken).alias(name)

    return merged.select(key, *map(value, names))


def latest_pages(pages: DataFrame, counts: DataFrame, *keys: str) -> DataFrame:
    """Of each page the write with the largest seq, without pages from the document's page count on."""
    document, page = keys
    names = [c for c in pages.columns if c not in keys]
    last = pages.groupBy(*keys).agg(F.max_by(F.struct(*names), "seq").alias("row")).select(*keys, "row.*")
    return last.join(counts, document).where(F.col(page) < F.col("page_count")).drop("page_count")


def reserve_names(batch: DataFrame, stem: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """Adds reserved: the stem, or the stem with the first number from 2 on that keeps it apart.

    Names that differ in case only are equal. taken holds lower-case names that are in use.
    """
    own = Window.partitionBy("_lower")
    rows = batch.withColumn("_lower", F.lower(stem)).withColumn("_place", F.row_number().over(Window.partitionBy("_lower").orderBy(order)))
    if taken is not None:
        parts = r"^(.*?)(?: \(([0-9]+)\))?$"
        number = F.when(F.regexp_extract("name", parts, 2) == "", 1).otherwise(F.regexp_extract("name", parts, 2).try_cast("int"))
        used = taken.select(F.lower(F.regexp_extract("name", parts, 1)).alias("_lower"), number.alias("_n"), F.regexp_extract("name", parts, 2).alias("_shown")).where("_n > 1 or _shown = ''").select("_lower", "_n").distinct()
        # A number in use is passed over by every name from the place on that the free numbers before it give.
        used = used.select("_lower", (F.col("_n") - F.row_number().over(own.orderBy("_n")) + 1).alias("_at"), F.lit(0).alias("_new"))
        both = rows.withColumn("_at", F.col("_place")).withColumn("_new", F.lit(1)).unionByName(used, allowMissingColumns=True)
        passed = F.count_if(F.col("_new") == 0).over(own.orderBy("_at", "_new").rowsBetween(Window.unboundedPreceding, 0))
        rows = both.withColumn("_place", F.col("_place") + passed).where("_new = 1").drop("_at", "_new")
    name = F.when(F.col("_place") == 1, F.col(stem)).otherwise(F.format_string("%s (%d)", F.col(stem), F.col("_place")))
    return rows.withColumn("reserved", name).drop("_place", "_lower")


def kept_copies(copies: DataFrame, key: str, order: str, keep: int = 5) -> DataFrame:
    """The newest copies of each key."""
    return copies.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= keep).drop("_n")


def removed(catalogue: DataFrame, keys: DataFrame, key: str = "file_path") -> DataFrame:
    """The catalogue after a soft delete of some keys; the rows stay."""
    gone = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    status = F.when(F.col("_gone"), REMOVED).otherwise(F.col("availability_status"))
    return catalogue.join(gone, key, "left").withColumn("availability_status", status).drop("_gone")


def relocated(catalogue: DataFrame, moves: DataFrame, key: str = "file_path") -> DataFrame:
    """The catalogue with keys changed as moves of (key, target) say; a target that is taken already is refused.

    Of several moves of a key, or to a target, the one with the smallest other end holds.
    """
    taken = catalogue.select(F.col(key).alias("target"))
    wanted = moves.groupBy(key).agg(F.min("target").alias("target")).groupBy("target").agg(F.min(key).alias(key)).join(taken, "target", "left_anti")
    return catalogue.join(wanted, key, "left").withColumn(key, F.coalesce("target", key)).drop("target")
