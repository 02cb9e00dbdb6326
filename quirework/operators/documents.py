"""Pages, lines, blocks, chunks, tables and fidelity of documents."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quirework.functions.markup import let
from quirework.functions.text import canonical, suspicious, tokens


def filled(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def extracted(scanned: Column, native: Column, direct: Column, ocr: Column, failed: Column) -> tuple[Column, Column]:
    """(text, status) of a page from its candidates: scanned pages prefer OCR, others their own text."""
    a, b, c = filled(ocr), filled(direct), filled(native)
    text = F.when(scanned, F.coalesce(a, b, c)).otherwise(F.coalesce(c, b, a))
    first = F.when(scanned, F.when(a.isNotNull(), "ocr").when(b.isNotNull(), "fallback").when(c.isNotNull(), "native"))
    other = F.when(c.isNotNull(), "native").when(b.isNotNull(), "fallback").when(a.isNotNull(), "ocr")
    status = F.coalesce(F.when(scanned, first).otherwise(other), F.when(failed, "failed").otherwise("empty"))
    return text, status


def scanned(chars: Column, images: Column) -> Column:
    return F.when(chars >= 40, False).when(images, True).otherwise(chars == 0)


def content_kind(status: Column, images: Column) -> Column:
    return F.when(status.isin("native", "fallback"), "text").when(status == "ocr", "recognised_text").when(images, "visual").otherwise("none")


def blank(samples: Column) -> Column:
    """An array of grey values that is nearly even, and nearly white or black; fewer than eight values count as blank."""
    first = F.get(samples, F.lit(0))
    even = F.forall(samples, lambda x: F.abs(x - first) <= 3)
    return (F.size(samples) < 8) | (even & ((first > 245) | (first < 10)))


def with_marker(page: Column, status: Column, text: Column) -> Column:
    """A page's text under its marker, with a warning where it couldn't be read."""
    warning = F.when(status.isin("failed", "empty"), F.concat(F.lit("> [!WARNING]\n> page "), page.cast("string"), F.lit(": "), status, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("<!-- PAGE page="), page.cast("string"), F.lit(" status="), status, F.lit(" -->\n\n"), warning, F.coalesce(text, F.lit("")))


def lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def line_kind(line: Column) -> Column:
    """The kind of block that a line begins, by the first that fits. The signs of the kinds are fixed values."""
    return (
        F.when(line.rlike(r"^#{1,6}[ \t]+.+"), "heading")
        .when(line.startswith("|"), "table")
        .when(line.rlike(r"^>\s*\[!\w+\]"), "note")
        .when(line.startswith(">"), "quotation")
        .when(line.rlike(r"^(?:§\s*\d|[Aa]rt\.\s*\d)"), "legal_transcription")
        .when(line.rlike(r"^\[\^[^\]]+\]:"), "footnote")
        .when(line.rlike(r"^!\["), "visual")
        .when(line.rlike(r"^(?:[-*+]\s|\d+[.)]\s|\(?[A-Za-z][.)]\s)"), "list_item")
        .otherwise("paragraph")
    )


def blocks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, kind, line_start, line_end, text): runs of lines up to an empty line, a heading, a list sign or a page marker."""
    rows = lines(documents, key, text).withColumn("empty", F.trim("line") == "")
    w = Window.partitionBy(key).orderBy("pos")
    opens = F.col("line").rlike(r"^#{1,6}[ \t]+.+|^[-*+]\s|^<!-- PAGE page=")
    begins = ~F.col("empty") & (F.coalesce(F.lag("empty").over(w), F.lit(True)) | opens | F.coalesce(F.lag("line").over(w).rlike(r"^#{1,6}[ \t]+.+"), F.lit(False)))
    rows = rows.withColumn("block", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("empty") & (F.trim("line") != "---"))
    grouped = rows.groupBy(key, "block").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min_by("line", "pos").alias("head"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x.line), "\n")
    return grouped.select(key, F.col("block").cast("int").alias("block"), line_kind(F.col("head")).alias("kind"), (F.col("first") + 1).alias("line_start"), (F.col("last") + 1).alias("line_end"), body.alias("text"))


def packed(units: Column, most: int, joiner: int = 2) -> Column:
    """The chunk number of each unit, units being lengths in order: a unit that doesn't fit opens a chunk, an oversized one has its own."""
    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["size"] > 0) & (acc["size"] + joiner + n > most)
        chunk = F.when(full, acc["chunk"] + 1).otherwise(acc["chunk"])
        size = F.when(full | (acc["size"] == 0), n).otherwise(acc["size"] + joiner + n)
        return F.struct(size.cast("long").alias("size"), chunk.alias("chunk"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    return F.aggregate(units, start, step, lambda acc: acc["out"])


def chunks(documents: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, chunk, text): paragraphs packed in order into chunks of at most so many characters; none for a text that fits whole.

    The fold over a document's paragraphs runs on one row of sorted pieces per document.
    """

    def split(batches):
        for batch in batches:
            out = [(k, n, c) for k, t in zip(batch["k"], batch["t"], strict=True) for n, c in enumerate(_chunks(t or "", most))]
            yield pd.DataFrame(out, columns=["k", "chunk", "text"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(split, f"k {kind}, chunk int, text string").withColumnRenamed("k", key)


def _chunks(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return []
    out: list[list[str]] = []
    size = 0
    for unit in (u.strip() for u in text.split("\n")):
        if not unit:
            continue
        if out and size + 2 + len(unit) <= most:
            out[-1].append(unit)
            size += 2 + len(unit)
        else:
            out.append([unit])
            size = len(unit)
    return ["\n\n".join(units) for units in out]


def token_recall(pairs: DataFrame, key: str, reference: str, extracted_text: str) -> DataFrame:
    """(key, n_reference, recall, suspicious): the share of the reference's tokens, as a multiset, that the extract has.

    Null with fewer than twenty reference tokens, or without any extracted ones. Rows that repeat a key count together and have one
    reference. Only tokens that the reference has leave the extract's row, and of texts only their numbers of tokens.
    """
    rows = pairs.select(key, tokens(F.col(reference)).alias("r"), tokens(F.col(extracted_text)).alias("x"), suspicious(F.col(extracted_text)).alias("suspicious"))
    known = rows.withColumn("shared", F.array_intersect("x", "r")).select(key, F.explode(F.filter("x", lambda t: F.array_contains("shared", t))).alias("t"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    words = rows.select(key, F.explode("r").alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(known)
    counts = words.groupBy(key, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).groupBy(key).agg(F.sum(F.least("a", "b")).alias("matched"))
    sizes = rows.select(key, F.size("r").alias("n_reference"), F.size("x").alias("n"), "suspicious")
    measured = (F.col("n_reference") >= 20) & (F.col("n") > 0)
    return sizes.join(counts, key, "left").select(key, "n_reference", F.when(measured, F.round(F.col("matched") / F.col("n_reference"), 4)).alias("recall"), "suspicious")


@F.arrow_udf(T.DoubleType())
def order_score(reference: pa.Array, extract: pa.Array) -> pa.Array:
    """How far two token arrays run in one order, 0 to 1; null where nothing can be said.

    All tokens of both count, those of the extract that the reference has. Tokens stay in Arrow form; of one row at a time they are
    compared by their numbers in the reference.
    """

    def one(r: pa.Array | None, x: pa.Array | None) -> float | None:
        if r is None or x is None or len(r) < 20 or not len(x):
            return None
        known = r.unique()
        a, b = (pc.index_in(tokens_of, value_set=known).drop_null().to_pylist() for tokens_of in (r, x))
        return 2.0 * matched(a, b) / (len(a) + len(b))

    return pa.array([one(r.values, x.values) for r, x in zip(reference, extract, strict=True)], pa.float64())


def matched(a: list[int], b: list[int]) -> int:
    """How many tokens the longest common run of two arrays has, with those before it and behind it in turn; the first of several counts.

    That is what difflib's matching blocks sum up to, but only places between the bounds are looked at, and a run's lengths are kept for one
    place of a at a time.
    """
    where: dict[int, list[int]] = {}
    for j, token in enumerate(b):
        where.setdefault(token, []).append(j)
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a_from, a_to, b_from, b_to = todo.pop()
        size, a_end, b_end, runs = 0, a_from, b_from, {}
        for i in range(a_from, a_to):
            places, longer = where.get(a[i], ()), {}
            for at in range(bisect_left(places, b_from), len(places)):
                j = places[at]
                if j >= b_to:
                    break
                longer[j] = k = runs.get(j - 1, 0) + 1
                if k > size:
                    size, a_end, b_end = k, i + 1, j + 1
            runs = longer
        if size:
            total += size
            if a_from < a_end - size and b_from < b_end - size:
                todo.append((a_from, a_end - size, b_from, b_end - size))
            if a_end < a_to and b_end < b_to:
                todo.append((a_end, a_to, b_end, b_to))
    return total


def fidelity(recall: Column, order: Column, suspicious_chars: Column) -> Column:
    return F.bround(recall * 0.65 + order * 0.30 + F.when(suspicious_chars > 0, 0.0).otherwise(0.05), 4)


def anchors_in_order(anchors: Column, text: Column) -> Column:
    """Whether the anchors stand in the text one after the other."""
    found = lambda at, a: F.call_function("locate", a, text, at)
    end = F.aggregate(anchors, F.lit(1), lambda at, a: F.when((at == 0) | (found(at, a) == 0), 0).otherwise(found(at, a) + F.length(a)))
    return end > 0


def nearly_equal(a: Column, b: Column) -> Column:
    """Arrays of tokens of one length that differ in one token at most, by one letter, the token having five or more."""
    off = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] != p["y"])
    fits = F.forall(off, lambda p: (F.length(p["x"]) == F.length(p["y"])) & (F.length(p["x"]) >= 5) & (F.levenshtein(p["x"], p["y"]) == 1))
    return (F.size(a) == F.size(b)) & (F.size(off) <= 1) & fits


# How an alternative is marked.
ALTERNATIVE = r"(?<!\S)(?:\(([A-Za-z])\)|([A-Za-z])\))"


def alternatives(text: Column) -> tuple[Column, Column]:
    """(labels, problem): the letters of a question's alternatives, or why they can't be told apart."""
    marks = F.regexp_extract_all(text, F.lit(ALTERNATIVE), F.lit(0))
    labels_of = lambda signs: F.transform(signs, lambda m: F.upper(F.regexp_extract(m, "[A-Za-z]", 0)))

    def judged(signs: Column, labels: Column) -> Column:
        starts = F.size(F.filter(labels, lambda x: x == "A"))
        last = (F.size(labels) - F.array_position(F.reverse(labels), F.lit("A")) + 1).cast("int")
        return let(last, lambda at: of_last(signs, labels, starts, at))

    def of_last(signs: Column, labels: Column, starts: Column, last: Column) -> Column:
        first = F.greatest(last, F.lit(1))
        chosen = F.slice(labels, first, F.size(labels) + 1)
        kept, before = F.slice(signs, first, F.size(signs) + 1), F.slice(signs, 1, F.greatest(last - 1, F.lit(0)))
        told_apart = F.forall(before, lambda m: m.rlike(r"^[a-z]\)$")) & F.forall(kept, lambda m: m.rlike(r"^\([A-Z]\)$"))
        right = F.forall(F.transform(chosen, lambda x, k: F.ascii(x) == k + 65), lambda ok: ok)
        problem = (
            F.when(starts == 0, "alternative_boundaries_uncertain")
            .when((starts > 1) & ~told_apart, "multiple_alternative_sequences")
            .when((F.size(chosen) < 2) | ~right, "alternative_sequence_inconsistent")
        )
        return let(problem, lambda p: F.struct(F.when(p.isNull(), chosen).alias("labels"), p.alias("problem")))

    found = let(marks, lambda signs: let(labels_of(signs), lambda labels: judged(signs, labels)))
    return found["labels"], found["problem"]


def match_contents(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds section_id, actual_page and status to entries of (doc_id, title, toc_page, announced_page).

    A title matches sections of the same canonical title that don't begin on the page of the contents
    itself. One match is a match, or a discrepancy if its page is another; several are ambiguous.
    """
    near = sections.select(F.col("doc_id").alias("_doc"), canonical(F.col("title")).alias("_title"), F.col("id").alias("_id"), F.col("page_start").alias("_page"))
    keyed = entries.withColumn("_key", canonical(F.col("title")))
    joined = keyed.join(near, (F.col("doc_id") == F.col("_doc")) & (F.col("_key") == F.col("_title")) & (F.col("_page") != F.col("toc_page")), "left")
    grouped = joined.groupBy(*entries.columns).agg(F.count("_id").alias("n"), F.max("_id").alias("_id"), F.max("_page").alias("_page"))
    one = F.col("n") == 1
    status = F.when(F.col("n") == 0, "unresolved").when(~one, "ambiguous").when(F.col("_page") != F.col("announced_page"), "source_discrepancy").otherwise("matched")
    return grouped.select(*entries.columns, F.when(one, F.col("_id")).alias("section_id"), F.when(one, F.col("_page")).alias("actual_page"), status.alias("status"))


def repeated_marks(lines_of_margins: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, value, n_pages) of personal values in margins on two or more pages, or in a document of one page."""
    found = lines_of_margins.groupBy("doc_id", "value").agg(F.count_distinct("page").alias("n_pages"))
    return found.join(pages, "doc_id").where((F.col("n_pages") >= 2) | (F.col("pages") == 1)).select("doc_id", "value", "n_pages")
