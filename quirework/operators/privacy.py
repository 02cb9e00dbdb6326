"""Marks that name a person: which documents have them, how many, and what is left out for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels that name a person alone, the label of a name, and labels that do with a name.
STRONG, NAME, CONTACTS = ("cpf", "cnpj", "rg", "matricula"), "nome", ("email", "telefone", "celular")
#: Fewer visible characters than this make a page with images one of images.
SPARSE = 40


def accepted_marks(marks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The marks of (doc, page, label, value) whose value stands on two pages at least, or whose document has one page.

    Counts of pages are partial before they are shuffled; a value that many marks repeat is one row a page.
    """
    pages = marks.select(doc, "value", "page").distinct()
    repeated = pages.groupBy(doc, "value").agg(F.count("*").alias("_on")).where("_on >= 2").select(doc, "value")
    single = pages.groupBy(doc).agg(F.min("page").alias("_low"), F.max("page").alias("_high")).where("_low = _high").select(doc)
    often = marks.join(repeated, [doc, "value"], "left_semi")
    return often.unionByName(marks.join(single, doc, "left_semi").join(repeated, [doc, "value"], "left_anti").select(*often.columns))


def identity_statistics(marks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, identified, marks, pages) of each document with marks.

    A document is identified if an accepted mark names a person alone, or a name comes with a contact. A
    contact alone is none. The counts are of accepted marks and their pages, 0 where nobody is identified.
    """
    label = F.col("label")
    named = F.bool_or(label.isin(*STRONG)) | (F.bool_or(label == NAME) & F.bool_or(label.isin(*CONTACTS)))
    found = accepted_marks(marks, doc).groupBy(doc).agg(named.alias("identified"), F.count("*").alias("marks"), F.count_distinct("page").alias("pages")).where("identified")
    zero = F.lit(0).cast("long")
    return marks.select(doc).distinct().join(found, doc, "left").select(doc, F.coalesce("identified", F.lit(False)).alias("identified"), F.coalesce("marks", zero).alias("marks"), F.coalesce("pages", zero).alias("pages"))


def omitted_visual(text: Column, images: Column, identified: Column) -> Column:
    """Whether a page is left out: few characters, images, and a document that names a person."""
    return (F.length(F.trim(text)) < SPARSE) & images & identified
