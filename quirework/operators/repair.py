"""Repairs of extracted text by evidence, and masking of known values."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import markup as M


def hyphenations(lines: DataFrame, vocabulary: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, first, second, joined) of words that a line end cut: joined without the hyphen if the vocabulary has that, with it if it has the other.

    lines has (doc, pos, line) and vocabulary (word). Without evidence for one form alone there is no row; of
    repeated pairs the last counts.
    """
    w = Window.partitionBy(doc).orderBy("pos")
    cut = lines.withColumn("next", F.lead("line").over(w)).select(doc, "pos", F.regexp_extract("line", r"([\p{L}]+)-\s*$", 1).alias("first"), F.regexp_extract("next", r"^\s*([\p{Ll}]+)", 1).alias("second")).where("first <> '' and second <> ''")
    known = vocabulary.select(F.lower("word").alias("word")).distinct()
    forms = cut.withColumn("whole", F.lower(F.concat("first", "second"))).withColumn("kept", F.lower(F.concat("first", F.lit("-"), "second")))
    forms = forms.join(known.select(F.col("word").alias("whole"), F.lit(True).alias("_a")), "whole", "left").join(known.select(F.col("word").alias("kept"), F.lit(True).alias("_b")), "kept", "left")
    one = forms.where(F.col("_a").isNotNull() != F.col("_b").isNotNull()).withColumn("joined", F.concat("first", F.when(F.col("_b"), "-").otherwise(""), "second"))
    return one.groupBy(doc, "first", "second").agg(F.max_by("joined", "pos").alias("joined"))


def joined_pages(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, page, last_page, text) of pages of (doc, page, status, text), where a paragraph that goes on is one row.

    A page goes on with the one before if both were read, the number follows, the text before has no
    closing sign at its end, and this one begins in lower case.
    """
    w = Window.partitionBy(doc).orderBy("page")
    read = F.col("status").isin("native", "fallback", "ocr")
    before = F.lag("text").over(w)
    goes_on = (F.col("page") == F.lag("page").over(w) + 1) & read & F.lag(read).over(w) & before.rlike(r"[\p{L},;]\s*$") & F.col("text").rlike(r"^\s*\p{Ll}")
    rows = pages.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("page", F.trim("text").alias("text"))))
    grouped = rows.groupBy(doc, "_run").agg(F.min("page").alias("page"), F.max("page").alias("last_page"), parts.alias("parts"))
    return grouped.select(doc, "page", "last_page", F.array_join(F.transform("parts", lambda p: p.text), " ").alias("text"))


def _spelled(value: str) -> str:
    """A pattern for the letters and digits of a value, with signs and accents between them free."""
    plain = [c for c in unicodedata.normalize("NFC", value) if c.isalnum()]
    return r"[\W_]{0,3}".join(re.escape(c) for c in plain)


def masked(documents: DataFrame, values: DataFrame, key: str = "doc_id", mark: str = "[REDACTED]") -> DataFrame:
    """(key, text, n_masked) of documents whose known values, from (key, value), are masked; longer values first.

    A value counts where no letter or digit stands on either side of it; a mail address not as a part of a longer one.
    """
    listed = values.groupBy(key).agg(F.collect_set("value").alias("values"))

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for text, known in zip(batch["text"], batch["values"], strict=True):
                known = sorted((v for v in (known if known is not None else ()) if sum(c.isalnum() for c in v) >= 4), key=lambda v: (-len(v), v))
                n = 0
                if known and text:
                    pattern = re.compile(rf"(?<![^\W_])(?<![^\W_][.@])(?:{'|'.join(map(_spelled, known))})(?![^\W_])(?!\.[^\W_]|@)", re.I)
                    text, n = pattern.subn(mark, text)
                texts.append(text)
                counts.append(n)
            yield pd.DataFrame({key: batch[key], "text": texts, "n_masked": counts})

    rows = documents.select(key, "text").join(listed, key, "left")
    return rows.mapInPandas(run, f"{key} {documents.schema[key].dataType.simpleString()}, text string, n_masked int")


def heading_levels(headings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds level to headings of (doc, line, title) of a course: nested numbers by depth plus one, six at most; letters and roman numerals under the number before them."""
    number = F.regexp_extract("title", r"^(\d+(?:\.\d+)*)\.?(?:\s|$)", 1)
    depth = F.when(number != "", F.least(F.lit(6), F.size(F.split(number, r"\.")) + 1))
    under = F.last(depth, ignorenulls=True).over(Window.partitionBy(doc).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    kind = F.when(F.col("title").rlike(r"^[IVXLC]+\s*[-–.)]"), 1).when(F.col("title").rlike(r"^[A-Za-z]\s*[-–.)]"), 2)
    return headings.withColumn("level", F.coalesce(depth, F.when(kind.isNotNull(), F.least(F.lit(6), F.coalesce(under, F.lit(1)) + kind)), F.lit(2)).cast("int"))


PARAGRAPH_END = r"\n[ \t]*\n"


def adjacencies(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, first, second), once each: the words on both sides of the line ends of (doc, pos, line)."""
    w = Window.partitionBy(doc).orderBy("pos")
    ends = lines.select(doc, F.regexp_extract("line", r"(\p{L}+)\s*$", 1).alias("first"), F.regexp_extract(F.lead("line").over(w), r"^\s*(\p{L}+)", 1).alias("second"))
    return ends.where("first <> '' and second <> ''").distinct()


def joined_tails(documents: DataFrame, pairs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_joined) of documents whose sentences get back the last word that stands as a paragraph of its own.

    A tail is one styled word in lower case with a closing sign. It joins the paragraph before, if that is running text that ends in a
    word and the two words stand at a line end of the source: pairs has (key, first, second). Without such evidence nothing is
    joined. Only tails meet the pairs, not paragraphs. A null text is empty; keys don't repeat.
    """
    rows = documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("parts", F.split("text", PARAGRAPH_END, -1)).withColumn("gaps", F.regexp_extract_all("text", F.lit(PARAGRAPH_END), F.lit(0)))

    def tail(part: Column, k: Column) -> Column:
        before = F.get("parts", k - 1)
        word = F.when(part.rlike(r"^(?:\*\*|__|<)"), F.regexp_extract(M.visible(part), r"^(\p{Ll}\p{L}*)[.!?]$", 1))
        running = ~F.regexp_replace(before, rf"^{M.SPACE}+", "").rlike(r"^(?:[#|>!]|<!--)")
        return F.struct(k.alias("k"), F.when((k > 0) & (word != "") & running, F.regexp_extract(M.visible(before), r"(\p{L}+)$", 1)).alias("first"), word.alias("second"))

    tails = rows.select(key, F.explode(F.filter(F.transform("parts", tail), lambda t: t["first"] != "")).alias("t")).select(F.col(key).alias("_key"), "t.*")
    known = pairs.select(F.col(key).alias("_key"), "first", "second")
    proved = tails.join(known, (tails["_key"].eqNullSafe(known["_key"])) & (tails["first"] == known["first"]) & (tails["second"] == known["second"]), "left_semi")
    by_text = proved.groupBy("_key").agg(F.collect_set("k").alias("tails"))
    joined = rows.join(by_text, rows[key].eqNullSafe(by_text["_key"]), "left").withColumn("tails", F.coalesce("tails", F.array().cast("array<int>")))
    is_tail = lambda k: F.array_contains("tails", k)

    def written(part: Column, k: Column) -> Column:
        whole = F.when(is_tail(k + 1), F.concat(M.right_stripped(part), F.lit(" "), M.stripped(F.get("parts", k + 1)))).otherwise(part)
        gap = F.coalesce(F.get("gaps", k + is_tail(k + 1).cast("int")), F.lit(""))
        return F.when(is_tail(k), "").otherwise(F.concat(whole, gap))

    text_of = F.when(F.size("tails") == 0, F.col("text")).otherwise(F.array_join(F.transform("parts", written), ""))
    return joined.select(key, text_of.alias("text"), F.size("tails").alias("n_joined"))
