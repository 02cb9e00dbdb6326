"""Scans of files: Markdown documents, logs, folder listings, strict and tolerant JSON, Markdown tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, markdown) of each file, read whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("markdown"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, modified) of the files under a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def usage(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def included(path: Column, excluded_folders: tuple[str, ...], endings: tuple[str, ...]) -> Column:
    """Whether a path belongs to a project: no hidden or excluded folder in it, and an ending that counts."""
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*excluded_folders))
    return ~hidden & F.lower(path).rlike(f"({'|'.join(e.replace('.', chr(92) + '.') for e in endings)})$")


def log_tail(lines: DataFrame, file: str, order: str, line: str, most: int = 256 * 1024) -> DataFrame:
    """The newest lines of rotated logs, in order of time, until so many bytes; newer files first."""
    # Whole files first, by their sizes; only the newest, as many as the bytes need, are sorted by line in one task.
    sizes = lines.groupBy(F.col(file).alias("_file")).agg(F.sum(F.octet_length(line) + 1).alias("_size"))
    newer = Window.orderBy(F.desc("_file")).rowsBetween(Window.unboundedPreceding, -1)
    needed = sizes.withColumn("_newer", F.coalesce(F.sum("_size").over(newer), F.lit(0))).where(F.col("_newer") <= most)
    rows = lines.join(needed, lines[file].eqNullSafe(needed["_file"]), "left_semi")
    newest = Window.orderBy(F.desc(file), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(F.octet_length(line) + 1).over(newest)).where(F.col("_sum") <= most).drop("_sum").orderBy(file, order)


def tolerant_json(text: Column, schema: str) -> Column:
    """A struct; nulls where the text isn't JSON or lacks a field."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def strict_json(rows: DataFrame, text: str, fields: list[str], most: int = 64 * 1024) -> DataFrame:
    """Adds problem: "size", "json", "duplicate_key", "fields" or null, for texts that must be one object with exactly these fields."""
    wanted = set(fields)

    def one(t: str | None) -> str | None:
        if t is None or len(t.encode()) > most:
            return "size"

        class Repeated(ValueError):
            pass

        def pairs(found: list[tuple]) -> dict:
            if len({k for k, _ in found}) != len(found):
                raise Repeated
            return dict(found)

        try:
            value = json.loads(t, object_pairs_hook=pairs)
        except Repeated:
            return "duplicate_key"
        except ValueError:
            return "json"
        return None if isinstance(value, dict) and set(value) == wanted else "fields"

    check = F.pandas_udf(lambda s: pd.Series([one(t) for t in s], dtype="object"), "string")
    return rows.withColumn("problem", check(F.col(text)))


def markdown_tables(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, rows) of the tables in Markdown: runs of lines with bars that have one separator line and equal widths."""

    def tables(batches):
        for batch in batches:
            out = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                out += [(k, n, rows) for n, rows in enumerate(tables_of(t or ""))]
            yield pd.DataFrame(out, columns=["k", "table", "rows"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(tables, f"k {kind}, table int, rows array<array<string>>").withColumnRenamed("k", key)


def tables_of(text: str) -> list[list[list[str]]]:
    out, run, fenced = [], [], False
    for line in [*text.split("\n"), ""]:
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        if not fenced and line.strip().startswith("|"):
            run.append(cells(line))
            continue
        rules = [k for k, row in enumerate(run) if all(c.strip() and set(c.strip()) <= set("-:") for c in row)]
        if rules == [1] and len(run[0]) >= 2 and len({len(row) for row in run}) == 1:
            out.append([run[0], *run[2:]])
        run = []
    return out


def cells(line: str) -> list[str]:
    """The cells of a table line; a bar behind a backslash belongs to its cell."""
    parts, cell, escaped = [], "", False
    for c in line.strip().strip("|") if not line.strip().endswith("\\|") else line.strip().lstrip("|"):
        if c == "|" and not escaped:
            parts.append(cell.strip())
            cell = ""
        else:
            cell += c
        escaped = c == "\\" and not escaped
    return [*parts, cell.strip()]
