"""Boxes of notes over pages and the paragraphs in them."""

from quirework.operators import notes as N

BOX = "doc_id long, page int, box int, x0 double, y0 double, x1 double, y1 double, height double, content string"
LINE = "doc_id long, page int, y double"


def boxes(spark, rows, lines):
    found = N.note_boxes(spark.createDataFrame(rows, BOX), spark.createDataFrame(lines, LINE)).collect()
    return sorted((r.doc_id, r.page, r.note_box, r.last_page, r.content) for r in found)


def foot(page, text, box=0, x0=50.0, doc=1):
    return (doc, page, box, x0, 20.0 if page > 1 else 600.0, x0 + 400, 780.0, 800.0, text)


def test_notes_go_on_over_pages(spark):
    rows = [foot(1, "ATENÇÃO! um"), foot(2, "dois"), foot(3, "três"), (1, 4, 0, 50.0, 20.0, 450.0, 100.0, 800.0, "quatro"), foot(5, "fim")]
    assert boxes(spark, rows, [(1, k, 780.0) for k in range(1, 6)]) == [(1, 1, 0, 4, "ATENÇÃO! um dois três quatro")]


def test_notes_end(spark):
    far = {"other sides": [foot(1, "NOTA: a"), foot(2, "b", x0=60.0)], "two boxes": [foot(1, "NOTA: a"), foot(2, "b"), foot(2, "c", box=1)], "a page between": [foot(1, "NOTA: a"), foot(3, "b")], "a note of its own": [foot(1, "NOTA: a"), foot(2, "Obs. b")]}
    for name, rows in far.items():
        found = boxes(spark, rows, [(1, 1, 700.0)])
        assert found[0] == (1, 1, 0, 1, "NOTA: a") and len(found) == (2 if name == "a note of its own" else 1), name
    rows = [foot(1, "NOTA: a"), foot(2, "b")]
    assert boxes(spark, rows, [(1, 1, 790.0)])[0][3] == 1 and boxes(spark, rows, [(1, 2, 5.0)])[0][3] == 1 and boxes(spark, rows, [(1, 2, 30.0)])[0][3] == 2
    assert boxes(spark, [foot(1, "nota a"), foot(2, None)], []) == [] and boxes(spark, [], []) == []


def test_two_notes_may_share_a_box(spark):
    rows = [foot(1, "Dica: a"), foot(1, "Cuidado! b", box=1), foot(2, "c")]
    assert boxes(spark, rows, []) == [(1, 1, 0, 2, "Dica: a c"), (1, 1, 1, 2, "Cuidado! b c")]


def grouped(spark, text, notes):
    docs = spark.createDataFrame([(1, text), (2, None), (None, text)], "doc_id long, text string")
    found = spark.createDataFrame([(1, *n) for n in notes], "doc_id long, page int, last_page int, content string")
    out = {r.doc_id: (r.text, r.n_grouped) for r in N.grouped_notes(docs, found).collect()}
    assert out[2] == ("", 0) and out[None] == (text, 0)
    return out[1]


def test_paragraphs_of_a_box_are_grouped(spark):
    text = "# **ATENÇÃO!**\n\nPrimeira <b>regra</b>.\n\nSegunda\nregra.\n\nFora."
    expected = ("> [!NOTE]\n> **ATENÇÃO!**\n>\n> Primeira <b>regra</b>.\n>\n> Segunda\n> regra.\n\nFora.", 1)
    assert grouped(spark, text, [(1, 1, "ATENÇÃO! Primeira regra. Segunda regra.")]) == expected
    assert grouped(spark, expected[0], [(1, 1, "ATENÇÃO! Primeira regra. Segunda regra.")])[0] == expected[0]
    for other in ((2, 2, "ATENÇÃO! Primeira regra. Segunda regra."), (1, 1, "ATENÇÃO! Primeira regra. Outra"), (1, 1, "ATENÇÃO! Primeira"), (1, 1, "")):
        assert grouped(spark, text, [other]) == (text, 0)


def test_pages_bound_a_note(spark):
    text = "<!-- PAGE page=3 status=native -->\n\nNOTA: um\n\n<!-- PAGE page=4 status=native -->\n\ndois\n\nDica: x\n\ny"
    assert grouped(spark, text, [(3, 3, "Nota: um dois")]) == (text, 0)
    joined, n = grouped(spark, text, [(3, 4, "Nota: um dois"), (4, 4, "dica: x y"), (4, 4, "dica: x y z")])
    assert n == 2 and joined.endswith("> dois\n\n> [!NOTE]\n> Dica: x\n>\n> y") and joined.startswith("<!-- PAGE page=3 status=native -->\n\n> [!NOTE]\n> NOTA: um\n>\n")


def test_tables_may_be_in_another_order(spark):
    text = "NOTA: veja\n\n| a1 | c3 |\n| b2 | d4 |\n\nfim"
    assert grouped(spark, text, [(1, 1, "NOTA: veja a1 b2 c3 d4")])[1] == 1
    assert grouped(spark, text, [(1, 1, "NOTA: veja a1 b2 c3 d5")])[1] == 0
    assert grouped(spark, text.replace("|", ""), [(1, 1, "NOTA: veja a1 b2 c3 d4")])[1] == 0
