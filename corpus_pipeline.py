"""A pipeline over the documents table: quality, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives documents that the next one works on; the last gives
packed pieces. Every stage reads all rows its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quirework.llm import jaccard, packing, pii, quality, toxicity
from quirework.llm.common import table
from quirework.session import shared_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from the labels of the documents given.

    Here as in every stage rows that repeat an id are judged each by itself, rows without an id stay, a null text
    counts as empty, columns of any further names pass through, and an empty table gives no rows.
    """
    labels = table(spark, sf_dir, "labels")
    return quality.keep_good(docs, labels, quality.fit(docs, labels), quality.sites_of(table(spark, sf_dir, "pages")))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as not toxic; the model learns from the labels of the documents given."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_one(docs, width=5, percent=80)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked in their texts."""
    return pii.redact(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("toxicity", harmless),
    ("near_duplicates", single),
    ("personal_data", masked),
    ("packing", packed),
]

#: Trained models and searches have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's rows are written as Parquet in the checkpoint folder and read again."""
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
