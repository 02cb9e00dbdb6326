"""Layout, repairs and exams on small tables with known results."""

import random

from pyspark.sql import functions as F

from quirework.operators import exams, layout, repair


def test_boxes_become_lines(spark):
    rows = [(1, "world", 0.9, 50.0, 10.0, 90.0, 20.0), (1, "hello", 0.9, 0.0, 11.0, 40.0, 21.0), (1, "below", 0.9, 0.0, 30.0, 40.0, 40.0), (1, "lost", 0.1, 0.0, 50.0, 9.0, 60.0), (2, "Title", 0.9, 0.0, 0.0, 90.0, 30.0), (2, "a", 0.9, 0.0, 40.0, 9.0, 50.0), (2, "b", 0.9, 0.0, 60.0, 9.0, 70.0)]
    boxes = spark.createDataFrame(rows, "page long, text string, score double, x_min double, y_min double, x_max double, y_max double")
    got = sorted(map(tuple, layout.text_lines(boxes, "page").collect()))
    assert got == [(1, 0, "hello world", False), (1, 1, "below", False), (2, 0, "Title", True), (2, 1, "a", False), (2, 2, "b", False)]


def test_segments_become_boxes(spark):
    rows = [(1, 0.0, 0.0, 0.5, 50.0), (1, 100.0, 1.0, 100.0, 49.0), (1, 1.0, 0.0, 99.0, 0.0), (1, 0.0, 50.0, 100.0, 50.0), (1, 200.0, 0.0, 200.0, 50.0), (2, 0.0, 0.0, 0.0, 50.0), (2, 100.0, 0.0, 100.0, 50.0)]
    got = layout.closed_boxes(spark.createDataFrame(rows, "page long, x0 double, y0 double, x1 double, y1 double")).collect()
    assert [(r.page, r.x0, r.x1) for r in got] == [(1, 0.0, 100.0)]


def test_tables_over_pages(spark):
    rows = [(1, 1, 10.0, 95.0, 100.0, [0.0, 50.0], "a"), (1, 2, 5.0, 60.0, 100.0, [1.0, 51.0], " "), (1, 3, 5.0, 60.0, 100.0, [1.0, 51.0], ""), (2, 1, 10.0, 95.0, 100.0, [0.0], "a"), (2, 2, 5.0, 60.0, 100.0, [9.0], "")]
    tables = spark.createDataFrame(rows, "doc_id long, page long, y0 double, y1 double, height double, edges array<double>, first_cell string")
    assert [r.group for r in layout.continued_tables(tables).orderBy("doc_id", "page").collect()] == [1, 1, 2, 1, 2]
    found = spark.createDataFrame([(1, 1, [["a", "b"], ["c", "d"]]), (1, 2, [["x", "y"]]), (1, 3, [["x", "y"]])], "page long, table_id long, rows array<array<string>>")
    assert [tuple(r) for r in layout.unique_tables(found, found).collect()] == [(1, 1)]


def test_margins_and_fields(spark):
    rows = spark.createDataFrame([("tax_id", "123.456.789-01", True), ("phone", "12345", False), ("email", "a@b.c", True), ("name", "One", False), ("name", "One Two", True), ("other", "x", False)], "label string, value string, fine boolean")
    assert rows.where(layout.valid_field(F.col("label"), F.col("value")) != F.col("fine")).count() == 0


def test_hyphenation_needs_evidence(spark):
    lines = spark.createDataFrame([(1, 0, "the pro-"), (1, 1, "cess of self-"), (1, 2, "help and mys-"), (1, 3, "tery")], "doc_id long, pos long, line string")
    words = spark.createDataFrame([("process",), ("self-help",), ("Process",)], "word string")
    assert {(r["first"], r.joined) for r in repair.hyphenations(lines, words).collect()} == {("pro", "process"), ("self", "self-help")}


def test_pages_are_joined_where_a_paragraph_goes_on(spark):
    rows = [(1, 1, "native", "It goes"), (1, 2, "native", "on here."), (1, 3, "native", "New one"), (1, 5, "native", "far"), (2, 1, "failed", "It goes"), (2, 2, "native", "on")]
    got = repair.joined_pages(spark.createDataFrame(rows, "doc_id long, page long, status string, text string")).orderBy("doc_id", "page").collect()
    assert [(r.page, r.last_page, r.text) for r in got] == [(1, 2, "It goes on here."), (3, 3, "New one"), (5, 5, "far"), (1, 1, "It goes"), (2, 2, "on")]


def test_masking_keeps_look_alikes(spark):
    docs = spark.createDataFrame([(1, "Ana Souza, ana@x.org; maria.ana@x.org, 123.456-78 and 1234567 8, 123456789, ana souza"), (2, None), (3, "Ana Souza")], "doc_id long, text string")
    values = spark.createDataFrame([(1, "Ana Souza"), (1, "ana@x.org"), (1, "12345678"), (1, "x"), (2, "Ana Souza")], "doc_id long, value string")
    got = {r.doc_id: (r.text, r.n_masked) for r in repair.masked(docs, values).collect()}
    assert got == {1: ("[REDACTED], [REDACTED]; maria.ana@x.org, [REDACTED] and [REDACTED], 123456789, [REDACTED]", 5), 2: (None, 0), 3: ("Ana Souza", 0)}
    again = spark.createDataFrame([(1, got[1][0])], "doc_id long, text string")
    assert repair.masked(again, values).first().n_masked == 0


def test_levels_of_course_headings(spark):
    rows = [(1, 1, "1. One"), (1, 2, "1.1. Two"), (1, 3, "A) letter"), (1, 4, "II - roman"), (1, 5, "1.1.1.1.1.1.1 deep"), (1, 6, "plain")]
    got = repair.heading_levels(spark.createDataFrame(rows, "doc_id long, line long, title string")).orderBy("line").collect()
    assert [r.level for r in got] == [2, 3, 5, 4, 6, 2]


def test_exams(spark):
    rows = [
        (1, "1. (X)", "questions", "What? (A) one (B) two"), (1, "2. (X)", "questions", "And? (A) one (C) two"), (1, "3. (X)", "questions", "Twice"), (1, "3. (Y)", "questions", "Twice"), (1, "4. (X)", "questions", "Q (A) x (B) y"),
        (1, "1. B", "answers", ""), (1, "2. A", "answers", ""), (1, "3. A", "answers", ""), (1, "4. D", "answers", ""), (1, "5. (X)", None, "no question"),
    ]
    got = {(r.number, r.stem): (r.labels, r.problem, r.answer) for r in exams.exam_index(spark.createDataFrame(rows, "doc_id long, title string, kind string, body string")).collect()}
    assert got[1, "What?"] == (["A", "B"], None, "B") and got[2, "And? (A) one (C) two"] == (None, "alternative_sequence_inconsistent", "A")
    assert got[4, "Q"] == (["A", "B"], "answer_not_in_observed_alternatives", "D") and got[3, "Twice"][2] is None and len(got) == 4


def test_contents(spark):
    rows = [(1, 0, "| 1. A long"), (1, 1, "| title ..... 12 |"), (1, 2, "| Other . . . . 7 |"), (1, 3, "no ..... 5")]
    got = exams.contents_entries(spark.createDataFrame(rows, "doc_id long, pos long, line string")).orderBy("pos").collect()
    assert [(r.title, r.announced_page) for r in got] == [("1. A long title", 12), ("Other", 7)]


def test_chunks_keep_code_tables_and_images():
    code, table, image = "```\n" + "x\n" * 40 + "\ny\n```", "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 10, "![a](" + "p" * 120 + ")"
    text = f"# Head\n\nshort\n\n{code}\n\n{table}\n\n{image}\n\n" + "word " * 60
    for strict in (False, True):
        chunks = exams.split_markdown(text, 100, strict)
        assert sum(code in c for c in chunks) == sum(table.strip() in c for c in chunks) == sum(image in c for c in chunks) == 1
        assert "".join("".join(chunks).split()) == "".join(text.split())
    assert all(len(c) <= 100 or c in (code, table.strip(), image) for c in exams.split_markdown(text, 100, True))
    random_ = random.Random(1)
    for _ in range(50):
        t = "".join(random_.choice("ab \n") for _ in range(400))
        parts = exams.split_markdown(t, 50, True)
        assert all(len(p) <= 50 for p in parts) and "".join("".join(parts).split()) == "".join(t.split())
        cut = exams._cut(t, 50)
        assert "".join(cut) == t and all(0 < len(p) <= 50 for p in cut)
    assert exams.split_markdown("short", 100) == []


def test_corpus_gate(spark):
    rows = [("a", 1, 0.9, 0.75, True, True), ("a", 2, None, 0.75, True, True), ("b", 1, 0.7, 0.75, True, True), ("c", 1, None, 0.65, True, True), ("d", 1, 0.9, 0.65, True, False)]
    got = {r.id: r.status for r in exams.corpus_gate(spark.createDataFrame(rows, "id string, page long, score double, minimum double, status_ok boolean, anchors_ok boolean")).collect()}
    assert got == {"a": "passed", "b": "failed", "c": "inconclusive", "d": "failed"}


def test_collections(spark):
    titles = spark.createDataFrame([("12.3. QUESTÕES DE CONCURSOS (2024)", "questions"), ("Exercícios", "questions"), ("Gabarito comentado", "answers"), ("1. Questões de fato", None), ("", None)], "t string, kind string")
    assert titles.where(~exams.collection_kind(F.col("t")).eqNullSafe(F.col("kind"))).count() == 0
