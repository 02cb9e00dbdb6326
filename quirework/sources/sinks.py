"""Sinks: structure as JSON, HTML pages, chunks by document, and a manifest of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.text import html_escaped, json_for_html


def structure_json(documents: DataFrame, path: str, key: str) -> None:
    """One JSON object a document; the commit protocol makes all files visible at once."""
    documents.select(F.to_json(F.struct(*documents.columns)).alias("value")).write.mode("overwrite").text(path)


def html_page(title: Column, payload: Column, body: Column) -> Column:
    head = F.concat(F.lit("<!doctype html><title>"), html_escaped(title), F.lit('</title><script type="application/json">'), json_for_html(payload), F.lit("</script>"))
    return F.concat(head, F.lit("<main>"), body, F.lit("</main>"))


def html(documents: DataFrame, path: str) -> None:
    rows = documents.select(html_page(F.col("title"), F.col("payload"), html_escaped(F.col("text"))).alias("value"))
    rows.write.mode("overwrite").text(path)


def chunk_files(chunks: DataFrame, path: str, key: str) -> None:
    """Chunks in a folder for each document, with the paths of images one folder up."""
    text = F.replace("text", F.lit("](images/"), F.lit("](../images/"))
    name = F.concat(F.lit("part_"), F.lpad(F.col("chunk").cast("string"), 3, "0"))
    chunks.select(key, name.alias("name"), text.alias("text")).write.mode("overwrite").partitionBy(key).json(path)


def manifest(files: DataFrame) -> DataFrame:
    """(path, size, sha256, sha512) of files with content."""
    return files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), F.sha2("content", 512).alias("sha512"))
