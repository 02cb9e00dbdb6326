"""Questions, answers and tables of contents of course documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions.text import canonical, canonical_py
from quirework.operators.documents import alternatives

# Titles of collections, without accents and in lower case.
QUESTIONS = r"^(?:questoes(?: de (?:concurso|prova)s?)?|exercicios)(?:\s*\([^)]*\))?$"
ANSWERS = r"^(?:gabarito(?:s)?(?: comentado(?:s)?)?|respostas comentadas)$"


def collection_kind(title: Column) -> Column:
    """"questions" or "answers" for the title of a collection, whatever its number, case and accents; else null."""
    text = F.regexp_replace(canonical(title), r"^\d+(?:\.\d+)*\.?\s*", "")
    return F.when(text.rlike(QUESTIONS), "questions").when(text.rlike(ANSWERS), "answers")


_NUMBERED, _QUESTIONS, _ANSWERS = (re.compile(p, re.ASCII) for p in (r"\d+(?:\.\d+)*\.?\s*", QUESTIONS, ANSWERS))
#: How every title of a collection begins in letters without accents.
_BEGINS = re.compile(r"[\s\d.]*(?:quest|exerc|gabar|respo)", re.IGNORECASE)


def collection_kind_of(title: str) -> str | None:
    """collection_kind of one title."""
    if title.isascii() and not _BEGINS.match(title):
        return None
    text = canonical_py(title)
    text = text[m.end() :] if (m := _NUMBERED.match(text)) else text
    return "questions" if _QUESTIONS.search(text) else "answers" if _ANSWERS.search(text) else None


def exam_index(sections: DataFrame) -> DataFrame:
    """(doc_id, number, stem, labels, problem, answer) of sections of (doc_id, title, kind, body), kind being "questions", "answers" or null.

    A question takes the answer of its number if that number is unique on both sides.
    """
    number = F.regexp_extract("title", r"^(\d+)\.", 1).try_cast("int")
    labels, problem = alternatives(F.col("body"))
    asked = sections.where((F.col("kind") == "questions") & F.col("title").rlike(r"^\d+\.\s*\(")).select("doc_id", number.alias("number"), "body", labels.alias("labels"), problem.alias("problem"))
    stem = F.when(F.col("labels").isNull(), F.trim("body")).otherwise(F.trim(F.regexp_extract("body", r"(?s)^(.*?)(?<!\S)\(?A\)", 1)))
    given = sections.where((F.col("kind") == "answers") & F.col("title").rlike(r"^\d+\.\s*[A-Z]$")).select("doc_id", number.alias("number"), F.regexp_extract("title", r"([A-Z])$", 1).alias("answer"))
    one = given.groupBy("doc_id", "number").agg(F.count("*").alias("_n"), F.first("answer").alias("answer")).where("_n = 1").drop("_n")
    counted = asked.withColumn("_m", F.count("*").over(Window.partitionBy("doc_id", "number")))
    joined = counted.join(one, ["doc_id", "number"], "left")
    answer = F.when(F.col("_m") == 1, F.col("answer"))
    issue = F.when(answer.isNull(), "answer_missing_or_ambiguous").when(F.col("labels").isNotNull() & ~F.array_contains("labels", answer), "answer_not_in_observed_alternatives")
    return joined.select("doc_id", "number", stem.alias("stem"), "labels", F.coalesce("problem", issue).alias("problem"), answer.alias("answer"))


def contents_entries(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, title, announced_page) of lines of (doc_id, pos, line) with dot leaders in tables; a numbered cell without leaders is the beginning of the next title."""
    rows = lines.where(F.col("line").startswith("|")).withColumn("cell", F.trim(F.regexp_replace("line", r"^[| ]+|[| ]+$", "")))
    entry = F.regexp_extract("cell", r"^(.+?)\s*(?:\.\s*){3,}(\d+)$", 2) != ""
    pending = F.when(~entry & F.col("cell").rlike(r"^\d+(?:\.\d+)*\.") & ~F.col("cell").rlike(r"\.{3,}"), F.col("cell"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("entry", entry).withColumn("head", F.lag(pending).over(w))
    title = F.trim(F.concat(F.coalesce("head", F.lit("")), F.lit(" "), F.regexp_extract("cell", r"^(.+?)\s*(?:\.\s*){3,}(\d+)$", 1)))
    return rows.where("entry").select("doc_id", "pos", title.alias("title"), F.regexp_extract("cell", r"(\d+)$", 1).cast("int").alias("announced_page"))


def split_markdown(text: str, most: int, strict: bool = False) -> list[str]:
    """Chunks of at most so many characters; none if the text fits. Code, tables and images stay whole; strict also cuts long paragraphs."""
    if len(text) <= most:
        return []
    units: list[str] = []
    for block, whole in _units(text):
        units += [block] if whole or not strict or len(block) <= most else _cut(block, most)
    out: list[str] = []
    for unit in units:
        if out and len(out[-1]) + 2 + len(unit) <= most:
            out[-1] += "\n\n" + unit
        else:
            out.append(unit)
    return out


def _units(text: str) -> list[tuple[str, bool]]:
    """(text, whether it must stay whole) of fenced code, tables, images and paragraphs, in order."""
    out: list[tuple[str, bool]] = []
    lines, run, kind, fence = text.split("\n"), [], "", ""

    def close() -> None:
        if run:
            out.append(("\n".join(run).strip("\n"), kind in ("code", "table", "image")))
            run.clear()

    for line in lines:
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if fence:
            run.append(line)
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = ""
                close()
            continue
        now = "code" if mark else "" if not line.strip() else "table" if line.lstrip().startswith("|") else "image" if re.match(r"\s*!\[[^\]]*\]\(", line) else "text"
        if now != kind or now in ("", "image", "code"):
            close()
        kind = now
        if now:
            run.append(line)
        if now == "code":
            fence = mark[1]
    close()
    return out


def _cut(text: str, most: int) -> list[str]:
    """Pieces that together are the text, cut behind a line end or a space in the second half of each, or else at the limit."""
    out = []
    while len(text) > most:
        at = text.rfind("\n", most // 2, most) + 1 or text.rfind(" ", most // 2, most) + 1 or most
        out.append(text[:at])
        text = text[at:]
    return [*out, text] if text else out


def split_documents(documents: DataFrame, most: int, strict: bool = False) -> DataFrame:
    """(doc_id, chunk, text) of documents of (doc_id, text)."""

    def run(batches):
        for batch in batches:
            rows = [(d, k, c) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for k, c in enumerate(split_markdown(t or "", most, strict))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, chunk int, text string")


def corpus_gate(cases: DataFrame) -> DataFrame:
    """(id, status) of cases of (id, page, score, minimum, status_ok, anchors_ok): passed if every page is, inconclusive without scores."""
    fine = F.bool_and(F.col("status_ok") & F.col("anchors_ok") & (F.coalesce("score", "minimum") >= F.col("minimum")))
    return cases.groupBy("id").agg(F.when(~fine, "failed").when(F.count("score") == 0, "inconclusive").otherwise("passed").alias("status"), F.min("score").alias("lowest"))
