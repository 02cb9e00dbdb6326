"""Marks of style and the structure of course texts against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quirework.functions import markup as M
from quirework.functions import rules as R
from quirework.operators import structure as S
from quirework.operators.folds import folded

PIECES = ["<b>", "</b>", "<u>", "</u>", "<i class='x'>", "</i>", "**", "__", "*", "_", "<br>", "<br />", "<!-- a * b -->", " ", "a", "bc", "é", "a_b", "1", "<p>", "x < y", "\n"]
SIGN = re.compile(r"<!--.*?-->|</?(?:b|em|i|mark|strong|u|sub|sup)\b[^>]*>|<br\s*/?>|\*\*|__|(?<!\w)[*_]|[*_](?!\w)", re.S)


def texts(seed, n=250, pieces=PIECES, most=14):
    random_ = random.Random(seed)
    return ["".join(random_.choice(pieces) for _ in range(random_.randrange(most))) for _ in range(n)] + [""]


def places_of(text):
    """Each visible character with its place."""
    out, at = [], 0
    for m in SIGN.finditer(text):
        out += [(text[k], k) for k in range(at, m.start())]
        if m[0].startswith("<br"):
            out.append(("\n", m.start()))
        at = m.end()
    return out + [(text[k], k) for k in range(at, len(text))]


def stack_of(text):
    stack = []
    for m in SIGN.finditer(text):
        sign = m[0]
        if sign.startswith(("<!--", "<br")):
            continue
        if sign.startswith("</"):
            if stack and stack[-1][1] == sign.lower():
                stack.pop()
        elif sign.startswith("<"):
            stack.append((sign, "</" + re.match(r"<(\w+)", sign)[1] + ">"))
        elif stack and stack[-1][0] == sign:
            stack.pop()
        else:
            stack.append((sign, sign))
    return stack


def cleaned(text):
    before = None
    while text != before:
        before = text
        text = re.sub(r"<(b|em|i|mark|strong|u)>\s*</\1>", "", text)
        text = re.sub(r"</(b|em|i|mark|strong|u)><\1>", "", text)
        text = re.sub(r"(?<=\S)(\*{4}|_{4})(?=\S)", "", text)
    return text


def split(text, place):
    places = places_of(text)
    if place <= 0:
        return "", text
    if place >= len(places):
        return text, ""
    at = places[place][1]
    stack = stack_of(text[:at])
    return cleaned(text[:at].rstrip() + "".join(c for _, c in reversed(stack))), cleaned("".join(s for s, _ in stack) + text[at:].lstrip())


@pytest.mark.parametrize("seed", [1, 2])
def test_visible_places_and_cuts(spark, seed):
    random_ = random.Random(seed)
    rows = [(t, random_.randrange(-1, 1 + max(1, len(places_of(t))))) for t in texts(seed)]
    df = spark.createDataFrame(rows, "t string, k int")
    t, k = df.t, df.k
    for r in df.select("t", "k", M.plain(t).alias("plain"), M.runs(t).alias("runs"), M.split_visible(t, k).alias("s"), M.open_styles(t).alias("open"), M.clean_styles(t).alias("clean")).collect():
        places = places_of(r.t)
        assert r.plain == "".join(c for c, _ in places)
        assert [run.source + i for run in r.runs for i in range(run.size)] == [p for _, p in places] and [run.at for run in r.runs] == [sum(x.size for x in r.runs[:n]) for n in range(len(r.runs))]
        assert [(s.sign, s.closing) for s in r.open] == stack_of(r.t) and r.clean == cleaned(r.t)
        assert (r.s.left, r.s.right) == split(r.t, r.k)


def test_halves_show_what_the_whole_shows(spark):
    """With tags only, both halves are balanced and show the text, but for white space at the cut."""
    made = []
    for t in texts(5, pieces=[p for p in PIECES if p not in ("**", "__", "*", "_", "</b>", "</u>", "</i>", "a_b", "<!-- a * b -->")]):
        closing = "".join(c for _, c in reversed(stack_of(t)))
        made.append((t + closing, len(places_of(t)) // 2))
    df = spark.createDataFrame(made, "t string, k int")
    s = M.split_visible(df.t, df.k)
    for r in df.select("t", "k", M.visible(s["left"]).alias("left"), M.visible(s["right"]).alias("right"), M.open_styles(s["left"]).alias("a"), M.open_styles(s["right"]).alias("b")).collect():
        whole = "".join(c for c, _ in places_of(r.t))
        assert (r.left + r.right).replace(" ", "").replace("\n", "") == whole.replace(" ", "").replace("\n", "")
        assert r.a == [] and r.b == []


def test_cuts_within_what_begins_like_a_tag(spark, tmp_path):
    """What a cut leaves of </ul> is no tag, and no closing sign makes it one."""
    from quirework.plans.markup import visible_split

    df = spark.createDataFrame([("<b>x</ul>y</b>", 4), ("x</ul>y", 4), ("<b>x</ul>", 1)], "t string, k int")
    s = M.split_visible(df.t, df.k)
    got = [tuple(r) for r in df.select(s["left"], s["right"], M.visible(s["left"]), M.visible(s["right"])).collect()]
    assert got == [("<b>x</b></u", "<b>l>y</b>", "x</u", "l>y"), ("x</u", "l>y", "x</u", "l>y"), ("<b>x</b>", "<b></ul>", "x", "</ul>")]
    spark.createDataFrame([(1, "abc</ulm>xyz")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [(r.left_seen, r.right_seen, r.balanced) for r in visible_split(spark, str(tmp_path)).collect()] == [("abc</u", "lm>xyz", True)]


def test_cuts_at_several_places(spark):
    df = spark.createDataFrame([("<b>one two</b> three", [3, 4, 8]), ("", [2]), ("plain", [])], "t string, at array<int>")
    got = [r[0] for r in df.select(M.split_at(df.t, df["at"])).collect()]
    assert ["".join(p.split()) for p in got[0]] == ["<b>one</b>", "", "<b>two</b>", "three"] and got[1:] == [["", ""], ["plain"]]
    nested = "<b><i><u>" * 5 + "</u></i></b>" * 5
    assert spark.createDataFrame([(nested,)], "t string").select(M.clean_styles(F.col("t"))).first()[0] == ""


def emphasised(text):
    out = []
    for line in text.splitlines(keepends=True):
        for mark in ("**", "__"):
            parts = re.split(r"(?<!\\)" + re.escape(mark), line)
            if len(parts) % 2:
                for k in range(1, len(parts), 2):
                    p, body = parts[k], parts[k].strip()
                    parts[k] = p[: len(p) - len(p.lstrip())] + mark + body + mark + p[len(p.rstrip()) :] if body else mark + p + mark
                line = "".join(parts)
        out.append(line)
    return "".join(out)


def test_emphasis(spark):
    made = texts(9, pieces=["**", "__", " ", "a", "b c", "\\", "\n", "\r\n", "\t", "\x0b", "\xa0", "*"]) + ["** a ** b ** c **"]
    df = spark.createDataFrame([(t,) for t in made], "t string")
    for r in df.select("t", M.repaired_emphasis(df.t).alias("e")).collect():
        assert r.e == emphasised(r.t)
        assert [c for c, _ in places_of(r.e) if not c.isspace()] == [c for c, _ in places_of(r.t) if not c.isspace()] or "*" in r.t.replace("**", "") or "\\" in r.t


def test_prose_and_spacing(spark):
    titles = {"<b>1. x</b> é": True, "1. é": True, "1. É": False, "1. O PRAZO É": False, "1. o prazo é curto": True, "1. prazo": False, "1. " + "x " * 80: True, "**Nota:** texto": True, "**Nota:**": False, "1. deve-se ver": True, "1. considera-se": True, "1. devemos": False, "2": False, "": False}
    df = spark.createDataFrame(list(titles.items()), "t string, e boolean")
    assert {r.t: r.p for r in df.select("t", R.prose_heading(df.t).alias("p")).collect()} == titles
    spaced = {"§ 4º- B e Art. 9- A": "§ 4º-B e Art. 9-A", "art. 2- b , c": "art. 2- b, c", "§ 1- AB": "§ 1- AB", "start. 3- B": "start. 3- B", "a\t;b :**c** !": "a;b:**c**!", "( ,": "( ,", "- , x": "- , x", "": "", "§ 2- A- B": "§ 2-A- B"}
    df = spark.createDataFrame(list(spaced.items()), "t string, e string")
    assert {r.t: r.p for r in df.select("t", R.legal_spacing(df.t).alias("p")).collect()} == spaced


def test_folds_carry_their_state_over_batches(spark):
    rows = [(k % 3 if k % 7 else None, k, k) for k in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        def step(state, row):
            state["sum"] += row["v"]
            return {"total": state["sum"]}

        got = {(r.k, r.pos): r.total for r in folded(spark.createDataFrame(rows, "k int, pos int, v int"), "k", "pos", lambda: {"sum": 0}, step, "total long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected, sums = {}, {}
    for k, pos, v in rows:
        sums[k] = sums.get(k, 0) + v
        expected[k, pos] = sums[k]
    assert got == expected


def levels_by_stack(titles):
    """The rules of levels on a plain list of (kind, level)."""
    stack, out, letter, number = [], [], None, None

    def place(kind, value=None):
        nonlocal number
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == kind:
                del stack[k + 1 :]
                stack[k] = (kind, stack[k][1], value)
                return stack[k][1]
        stack.append((kind, min((stack[-1][1] if stack else 1) + 1, 6), value))
        return stack[-1][1]

    romans = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    firsts = [m[1] if (m := re.match(r"([A-Za-z])[.)]\s+", t)) else None for t in titles]
    near = lambda a, b: bool(a and b and a.isupper() == b.isupper() and ord(b) == ord(a) + 1)
    for k, t in enumerate(titles):
        if m := re.match(r"(\d+(?:\.\d+)*)\.?(?:\s|$)", t):
            level = min(m[1].count(".") + 2, 6)
            stack[:], letter = [("number", level, None)], None
        elif m := re.match(r"([A-Z])\.(\d+(?:\.\d+)*)\.?(?:\s|$)", t):
            level = min(place("capital") + m[2].count(".") + 1, 6)
            stack.append(("compound", level, None))
        elif m := re.match(r"([A-Z])\s*[.)](?:\s|$)", t) or re.match(r"([a-z])\s*\)(?:\s|$)", t):
            c, before = m[1], letter
            letter = c
            case = "capital" if c.isupper() else "small"
            value = romans.get(c.upper())
            if (k and near(firsts[k - 1], firsts[k])) or (k + 1 < len(firsts) and near(firsts[k], firsts[k + 1])) or near(before, c) or value is None:
                level = place(case)
            elif value == 1 or (stack and stack[-1][0] == "roman" and stack[-1][2] == value - 1):
                level = place("roman", value)
            else:
                level = place(case)
        elif m := re.match(r"(?i)(II|III|IV|VI|IX|XI)\s*[).](?:\s|$)", t):
            level = place("roman", {"II": 2, "III": 3, "IV": 4, "VI": 6, "IX": 9, "XI": 11}[m[1].upper()])
        else:
            level = 0
        out.append(level)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_levels_equal_a_plain_stack(spark, seed):
    random_ = random.Random(seed)
    kinds = ["1.", "2.3.", "1.2.3", "1.1.1.1.1.1.1", "A.", "B.", "C)", "I.", "V.", "X.", "H.", "J.", "a)", "b)", "c)", "i)", "v)", "II.", "iii)", "IV)", "ix.", "A.1.", "B.2.1", "Nada"]
    docs = {d: [f"{random_.choice(kinds)} Tema {k}" for k in range(random_.randrange(40))] for d in range(30)}
    rows = [(d, "\n\n".join("#" * random_.randrange(1, 7) + " " + t for t in titles)) for d, titles in docs.items()]
    got = {r.doc_id: r.text for r in S.structured(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, titles in docs.items():
        lines = [x for x in got[d].split("\n") if x]
        assert lines == [("#" * level + " " if level else "") + t for t, level in zip(titles, levels_by_stack(titles), strict=True)]


def test_structure(spark):
    text = "# **Nota:** texto\n# 1.1. Tema\n**ATENÇÃO!** veja\n> JULGADOS DO STF\n# Julgados do STF\nRECURSOS REPETITIVOS\nTema 3 e 4\nFim. <b>SÚMULA Nº 12</b>\nna SÚMULA Nº 12\n| TEMA 1 |\nTÍTULO\n1. a\n# 2. b\n3. c"
    df = spark.createDataFrame([(1, text, ["TÍTULO"]), (2, None, None), (None, "# 1. x", [])], "doc_id long, text string, t array<string>")
    got = {r.doc_id: r.text for r in S.structured(df, titles="t").collect()}
    assert got[2] == "" and got[None] == "## 1. x"
    squeezed = re.sub(r"\n+", "\n", got[1])
    assert squeezed == "**Nota:** texto\n### 1.1. Tema\n> [!NOTE]\n> **ATENÇÃO!** veja\n> JULGADOS DO STF\n### Julgados do STF\n#### RECURSOS REPETITIVOS\n##### Tema 3 e 4\nFim.\n##### SÚMULA Nº 12\nna SÚMULA Nº 12\n| TEMA 1 |\n#### TÍTULO\n1. a\n2. b\n3. c"
    assert S.structured(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exam_boundaries(spark):
    raw = {
        1: ("# 2. QUESTÕES\n\n**1. (Prova/2024)** Texto.\n\n(A) Um.\n\n- (B) Dois.\n\n- (C) Três.\n\n# 3. GABARITO\n\n**1. C**\n\n- Comentário com conteúdo.\n\n-\n",
            "# 2. QUESTÕES\n\n## **1. (Prova/2024)**\n\nTexto.\n\n(A) Um.\n\n(B) Dois.\n\n(C) Três.\n# 3. GABARITO\n\n## **1. C**\n\n- Comentário com conteúdo.\n\n-\n"),
        2: ("# QUESTÕES\n\n**1. (P)** x.\n\n(A) Um.\n\n- (C) Três.", "# QUESTÕES\n\n## **1. (P)**\n\nx.\n\n(A) Um.\n\n- (C) Três."),
        3: ("## Exercícios\n# (A) um\n## art. 3\n**1. (P) <b>x (A) um (B) dois</b>** fim\n# Outro\n**2. (P)** y (A) um (B) dois", "## Exercícios\n# (A) um\n## art. 3\n**1. (P) <b>x (A) um (B) dois</b>** fim\n# Outro\n**2. (P)** y (A) um (B) dois"),
        4: ("# QUESTÕES\n# 1. (P)\na) um\n(A) Um\n(B) Dois\n## Sub\n(C) x", None),
        5: (None, ""), 6: ("", ""), 7: ("Sem título\n\n\n\nfim", "Sem título\n\nfim"),
    }
    df = spark.createDataFrame([(d, t) for d, (t, _) in raw.items()], "doc_id long, text string")
    got = {r.doc_id: r.text for r in S.exam_boundaries(df).collect()}
    for d, (_, expected) in raw.items():
        if d == 3:
            # "(A)" is above the collection's level and ends nothing, as it is an alternative
            assert got[d].startswith("## Exercícios\n(A) um\nart. 3\n\n### **1. (P)") and got[d].endswith("# Outro\n**2. (P)** y (A) um (B) dois")
        elif expected is not None:
            assert got[d] == expected, d
    again = {r.doc_id: r.text for r in S.exam_boundaries(spark.createDataFrame(list(got.items()), "doc_id long, text string")).collect()}
    assert again == got


def test_separators(spark):
    from quirework.operators.separators import repaired_separators

    long = "Considerando que o artigo primeiro desta lei dispõe sobre a matéria tratada adiante, "
    cases = {
        1: (long + "a reda ção fica.", [long + "a redação fica."], long + "a redação fica."),
        2: (long + "oprazo corre.", [long + "o prazo corre."], long + "o prazo corre."),
        3: (long + "a <b>reda</b> <b>ção</b> fica.", [long + "a redação fica."], long + "a <b>redação</b> fica."),
        4: (long + "a reda ção", [long + "a redação" + " x" * 3, long + "a reda ção" + " x" * 3], long + "a reda ção"),  # ambiguous
        5: (long + "bem vindo aqui", [long + "bem-\nvindo aqui"], long + "bem-vindo aqui"),
        6: (long + "cons- trução aqui", [long + "cons-\ntrução aqui"], long + "construção aqui"),
        7: (long + "um\n\ndois <!-- a --> três", [long + "umdoistrês"], long + "um\n\ndois <!-- a --> três"),
        8: (long + "ver https://a.b/bemvindo fim", [long + "ver https://a.b/bem-\nvindo fim"], long + "ver https://a.b/bem-vindo fim"),
        9: (None, ["x"], None),
        10: ("reda ção", None, "reda ção"),
        11: ("a b", ["ab"], "a b"),
        12: ("", [None], ""),
    }
    pages = spark.createDataFrame([(d, 1, t) for d, (t, _, _) in cases.items()] + [(None, 1, cases[1][0])], "doc_id long, page int, text string")
    sources = spark.createDataFrame([(d, 1, p, ["construção"]) for d, (_, p, _) in cases.items() if p] + [(1, 2, ["x"], None), (None, 1, cases[1][1], None)], "doc_id long, page int, passages array<string>, whole array<string>")
    got = {r.doc_id: (r.text, r.n_repaired) for r in repaired_separators(pages, sources, together="whole").collect()}
    assert {d: t for d, (t, _) in got.items()} == {d: e for d, (_, _, e) in cases.items()} | {None: cases[1][2]}
    assert got[4][1] == 0 and got[2][1] == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_contexts_equal_a_search_of_the_source(spark, seed):
    """The index of contexts says what a search for each context says; letters and digits stay as they are."""
    from quirework.operators import separators as P

    random_ = random.Random(seed)
    words = ["".join(random_.choice("abcé1") for _ in range(random_.randrange(1, 9))) for _ in range(12)]
    source = P.Source([" ".join(random_.choice(words) for _ in range(150)) for _ in range(3)], frozenset())
    for radius in P.RADII[:2]:
        for k in random_.sample(range(1, len(source.letters) - 1), 60):
            a, b = max(0, k - radius), min(len(source.letters), k + radius)
            context = source.letters[a:b]
            expected = {source.between[i + k - a - 1] for i in range(len(source.letters)) if source.letters.startswith(context, i) and 0 < i + k - a <= len(source.between)}
            assert source.at_context(radius, context, k - a) == expected


def test_tails_and_headings(spark):
    from quirework.operators.repair import adjacencies, joined_tails

    lines = spark.createDataFrame([(1, 0, "Preserve a redação"), (1, 1, "integral. Outra"), (1, 2, "9 x"), (None, 0, "um"), (None, 1, "dois")], "doc_id long, pos int, line string")
    pairs = adjacencies(lines)
    assert sorted((str(r.doc_id), r.first, r.second) for r in pairs.collect()) == [("1", "redação", "integral"), ("None", "um", "dois")]
    texts = {
        1: "Preserve a redação\n\n**<u>integral.</u>**\n \nfim\n\n# redação\n\n**integral.**\n\na redação\n\nintegral.\n\n**redação**\n\n**Integral.**",
        2: "a redação\n\n**integral.**",
        3: None,
        None: "um\n\n__dois!__",
    }
    got = {r.doc_id: (r.text, r.n_joined) for r in joined_tails(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), pairs).collect()}
    assert got == {1: (texts[1].replace("redação\n\n**<u>", "redação **<u>", 1), 1), 2: (texts[2], 0), 3: ("", 0), None: ("um __dois!__", 1)}
    heads = spark.createDataFrame([(1, "# **1. Um B. Dois C. Três**\n1. Um C. Três\n# Um C. Três"), (2, "# 1. Um C. Três"), (3, None)], "doc_id long, text string")
    known = spark.createDataFrame([(1, "C. Três"), (1, "B. Dois C. Três"), (1, "Dois"), (2, "D. x")], "doc_id long, suffix string")
    assert {r.doc_id: r.text for r in S.split_headings(heads, known).collect()} == {1: "# **1. Um**\n\n# **B. Dois C. Três**\n1. Um C. Três\n# Um C. Três", 2: "# 1. Um C. Três", 3: ""}


def test_titles_by_style(spark):
    rows = [
        (1, "TÍTULO", None, True, 12.04, "a"), (1, "1. x", "1. x", False, 12.0, "a"), (1, "B) y z", "B) y", False, 11.96, "a"), (1, "OUTRO", None, True, 12.0, "b"), (1, "1.2 x", "1.2 x", False, 12.0, "b"),
        (1, "TÍTULO:", None, True, 12.0, "a"), (1, "Título", None, True, 12.0, "a"), (1, "2024", None, True, 12.0, "a"), (1, "MEIO", None, False, 12.0, "a"), (1, "X" * 100, None, True, 12.0, "a"),
        (1, None, None, True, None, None), (2, "TÍTULO", None, True, 12.0, "a"), (None, "UM", None, True, 9.0, "a"), (None, "x", "A. x", False, 9.0, "a"), (None, "x", "B. x", False, 9.0, "a"),
    ]
    got = {r.doc_id: r.titles for r in S.set_titles(spark.createDataFrame(rows, "doc_id long, text string, label string, bold boolean, size double, font string")).collect()}
    assert got == {1: ["TÍTULO"]}


def test_cuts_of_texts_without_signs(spark):
    """Against plain cuts; a text that no sign of style is in isn't taken apart, and a heading is worked out once."""
    texts = ["", " ", "a", "um dois", "  um \u00a0 dois\t", "1. Um B. Dois\n C. Três ", "\U0001f600 x \U0001f600", "a > b / c", "\x1ca b\x85"]
    white = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0"
    rows = [(t, p) for t in texts for p in (None, *range(-1, len(t) + 2))] + [(None, 1)]
    made = spark.createDataFrame(rows, "t string, p int").select("t", "p", M.plain(F.col("t")).alias("plain"), M.split_visible(F.col("t"), F.col("p")).alias("s")).collect()
    for r in made:
        assert r.plain == r.t
        if r.t is None or r.p is None or r.p >= len(r.t) and r.p > 0:
            assert tuple(r.s) == (r.t, "")
        else:
            assert tuple(r.s) == (("", r.t) if r.p <= 0 else (r.t[: r.p].rstrip(white), r.t[r.p :].lstrip(white)))
    heads = spark.createDataFrame([(1, "# 1. Um B. Dois C. Três\n## 2. B. Dois\n#  **2.** <b>x</b> B. Dois\n# B. Dois\n# 3. x\tB. Dois")], "doc_id long, text string")
    split = S.split_headings(heads, spark.createDataFrame([(1, "B. Dois"), (1, "C. Três"), (1, "B. Dois C. Três")], "doc_id long, suffix string"))
    assert split.first().text == "# 1. Um\n\n# B. Dois C. Três\n## 2.\n\n## B. Dois\n# **2.** <b>x</b>\n\n# B. Dois\n# B. Dois\n# 3. x\tB. Dois"
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(lines") == 3 and "RLIKE(lines" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_texts_in_python_equal_column_expressions(spark, seed):
    """Cuts, visible texts, open styles and kinds of collections of odd texts are what the column expressions say."""
    from quirework.functions import signs as G
    from quirework.functions.text import canonical, canonical_py
    from quirework.operators import exams as E
    from quirework.operators.documents import alternatives

    random_ = random.Random(seed)
    atoms = ["(A) um", " (B) dois", " C) x", "\na) y", "**", "****", "__", "*", "_", "<b>", "</b>", "<u", "</em>", "<em x='1'>", "<B>", "<br>", "<br />", "<!-- x -->", "<!--", " ", "\n", "\r", "\x85", " ", "\xa0", "é", "²", "́", "x", "Palavra", ".", "1. "]
    titles = ["Quest", "ões", "QUESTOES", "exercícios", "Gabarito", " comentado", "s", " ", "1. ", "2.3 ", "(x)", "\t", "́", " de prova", "respostas comentadas"]
    rows = [("".join(random_.choice(atoms) for _ in range(random_.randrange(14))), random_.randrange(-1, 30), "".join(random_.choice(titles) for _ in range(random_.randrange(5)))) for _ in range(1_500)]
    table = spark.createDataFrame(rows, "t string, p int, title string").repartition(4).cache()
    t = F.col("t")
    shown = table.select("t", "p", "title", M.plain(t).alias("plain"), M.open_styles(t).alias("open"), M.clean_styles(t).alias("clean"), M.split_visible(t, F.col("p")).alias("cut"))
    for r in shown.collect():
        assert (r.plain, [tuple(x) for x in r.open], r.clean, tuple(r.cut)) == (G.plain(r.t), G.open_styles(r.t), G.clean_styles(r.t), G.split_visible(r.t, r.p)), (r.t, r.p)
    said = table.select("t", "title", E.collection_kind(F.col("title")).alias("kind"), canonical(F.col("title")).alias("canonical"), F.coalesce(F.size(alternatives(t)[0]), F.lit(0)).alias("n"))
    for r in said.collect():
        assert (r.kind, r.canonical, max(r.n, 0)) == (E.collection_kind_of(r.title), canonical_py(r.title), len(S._alternative_places(r.t))), r
    assert {E.collection_kind_of(x) for x in ("2. QUESTÕES (x)", "Gabaritos comentados", "Questao")} == {"questions", "answers", None}


def test_exams_take_no_shuffle(spark):
    """A text is gone through where it is, and says itself whether a second pass leaves it."""
    text = "# QUESTÕES\n**1. (P)** x (A) um (B) dois\n# GABARITO\n**1. B**"
    made = S.exam_boundaries(spark.createDataFrame([(1, text), (2, None), (None, "")], "doc_id long, text string"), settled="settled")
    assert {(r.doc_id, r.text, r.settled) for r in made.collect()} == {(1, "# QUESTÕES\n\n## **1. (P)**\n\nx\n\n(A) um\n\n(B) dois\n# GABARITO\n\n## **1. B**\n", True), (2, "", True), (None, "", True)}
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
