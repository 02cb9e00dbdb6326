"""The queries of this subpackage. Each takes (spark, sf_dir) and reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import audit, bpe, chat, jaccard, license_scan, mpeg, packing, pii, quality, toxicity, urls, variants, vectors
from quirework.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose id ends its path: bad if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(urls.path_of(F.col("url")), "([0-9]+)[^/0-9]*/?$", 1)
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document"), F.coalesce(bad, F.lit(0)).alias("bad"))
    labels = pages.select("page_id", number.try_cast("long").alias("document")).join(marks, "document").select("page_id", "bad")
    return urls.judge(pages, labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = pii.detect(documents, pii.fit(documents))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.base)
    of_kind = lambda kind: F.filter("spans", lambda s: s.base & (s.kind == kind))
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(documents, labels, quality.fit(documents, labels), quality.sites_of(table(spark, sf_dir, "pages")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mpeg.read(mpeg.store(table(spark, sf_dir, "documents")))
    seek = F.sha2(F.array_join(F.col("seek_offsets").cast("array<string>"), ","), 256)
    feature = F.format_string(
        "mpeg1-l3;frames=%d;samples=%d;rate=%d;table=%d;kbits=%s;crc=%d/%d;skipped=%d;seek=%s",
        "frames", "samples", "rate", "table_frames", "bitrates", F.col("crc_checked") - F.col("crc_failed"), F.col("crc_checked"), "skipped_bytes", seek,
    )
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -mpeg.UNIT, mpeg.UNIT)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), width=3, percent=90)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.vocabulary(table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("places", lambda p: p.base)
    words = F.transform(base, lambda p: p.word)
    return license_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p.label))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """Models, searches, tokenizers and stored media have no SQL form; their tests compare with brute force."""
    return {"op1_url_filters": urls.oracle_sql(), "op6_chat": chat.oracle_sql(), "op11_spelling_variants": variants.oracle_sql(), "op12_filter_audit": audit.oracle_sql()}
