"""Steps whose work must follow their input, against comparing all."""

import random

from pyspark.sql import functions as F

from quirework.operators import layout as B
from quirework.operators import separators as P


def test_separators_of_long_repetitions():
    """A boundary in a word said five hundred times is told by the whole page, at one end or in the middle."""
    for left, right in (("", ""), ("onze letras a mais ", ""), ("", " e mais outras letras"), ("onze letras a mais ", " e mais outras letras")):
        text = left + "thatha " * 250 + "thatha" + right
        damaged = text.replace("thatha", "tha tha")
        runs = [{"at": 0, "source": 0, "size": len(damaged)}]
        for start, end, instead in reversed(P.edits(damaged, damaged, runs, P.Source([text], frozenset()))):
            damaged = damaged[:start] + instead + damaged[end:]
        assert damaged == text


def test_wider_contexts_against_all_places():
    """What wider contexts settle is what comparing every place of the source settles."""
    random_ = random.Random(4)
    for _ in range(12):
        word = "".join(random_.choice("ab") for _ in range(random_.randrange(1, 7)))
        parts = [word] * random_.randrange(120, 400)
        for _ in range(random_.randrange(3)):
            parts[random_.randrange(len(parts))] = "c"
        source = P.Source([" ".join(parts), " ".join(parts[: random_.randrange(400)])], frozenset())
        cut = "".join(parts)[random_.randrange(3) :]
        asked = sorted({random_.randrange(1, len(cut)) for _ in range(60)} | {1, len(cut) - 1})

        def settled(k):
            radius = 288
            while True:
                a, b = max(0, k - radius), min(len(cut), k + radius)
                found = {source.between[i + k - a - 1] for i in range(len(source.letters) - (b - a) + 1) if source.letters[i : i + b - a] == cut[a:b]}
                if len(found) < 2 or radius >= len(cut):
                    return found
                radius *= 2

        wanted = {k: found.pop() for k in asked if len(found := settled(k)) == 1}
        assert source.at_wider(cut, asked) == wanted


def test_boxes_of_many_uprights(spark):
    """Against comparing all: uprights that end a little apart, shared sides, lines drawn again; a page of many boxes makes no pairs of uprights."""
    random_ = random.Random(3)
    near = lambda a, b: abs(a - b) <= 2
    rows = []
    for page in range(6):
        for _ in range(14):
            x, y = random_.choice((0, 40, 80)) + random_.random() * 2, random_.choice((0, 30)) + random_.random() * 2
            rows += [(page, x, y, x + random_.random(), y + 30 + random_.random())] * random_.choice((1, 2))
            rows.append((page, x, y, x + random_.choice((40, 80)) + random_.random(), y + random_.random()))
            rows.append((page, x, y + 30, x + 40 + random_.random(), y + 30))
    wanted = set()
    for page in range(6):
        mine = [r[1:] for r in rows if r[0] == page]
        up = [(a, min(b, d), max(b, d)) for a, b, c, d in mine if near(a, c)]
        flat = [(b, min(a, c), max(a, c)) for a, b, c, d in mine if near(b, d)]
        for x, top, low in up:
            for x2, top2, low2 in up:
                if x2 > x + 2 and near(top, top2) and near(low, low2) and all(any(near(y, side) and near(a, x) and near(b, x2) for y, a, b in flat) for side in (top, low)):
                    wanted.add((page, x, top, x2, low))
    kinds = "page int, x0 double, y0 double, x1 double, y1 double"
    got = B.closed_boxes(spark.createDataFrame(rows, kinds)).collect()
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted) > 10
    n, x = 40_000, F.col("id") * 200.0
    side = lambda a, b, c, d: F.struct(a.alias("x0"), F.lit(b).alias("y0"), c.alias("x1"), F.lit(d).alias("y1"))
    sides = F.array(side(x, 10.0, x, 60.0), side(x + 150, 10.0, x + 150, 60.0), side(x, 10.0, x + 150, 10.0), side(x, 60.0, x + 150, 60.0))
    assert B.closed_boxes(spark.range(n).select(F.lit(1).alias("page"), F.explode(sides).alias("s")).select("page", "s.*")).count() == n


def test_points_in_spans(spark):
    """Against comparing all, with equal values, ends that are points, nulls and ids that repeat; a page of many points and spans makes no pairs."""
    random_ = random.Random(2)
    value = lambda: random_.choice((None, float(random_.randrange(-300, 300)), random_.random() * 1000))
    points = [(random_.choice((1, 2, None)), value()) for _ in range(300)]
    spans = [(random_.randrange(60), random_.choice((1, 2, 3, None)), value(), value()) for _ in range(90)]
    wanted = {}
    for name, page, low, high in spans:
        wanted[name] = wanted.get(name, 0) + sum(None not in (page, low, high, v) and p == page and low <= v <= high for p, v in points)
    made = B.counted_within(spark.createDataFrame(spans, "id int, page int, low double, high double"), spark.createDataFrame(points, "page int, value double"))
    assert {r.id: r.inside for r in made.collect()} == wanted and made.count() == len(wanted)
    n = 60_000
    many = B.counted_within(spark.range(n).select("id", F.lit(1).alias("page"), F.lit(0.0).alias("low"), F.col("id").cast("double").alias("high")), spark.range(n).select(F.lit(1).alias("page"), F.col("id").cast("double").alias("value")))
    assert many.where("inside <> id + 1").count() == 0


def test_kept_texts_are_dealt_evenly(spark):
    """Texts that came in one part are read again in several a core."""
    from quirework.plans.markup import keeper

    kept = keeper(spark, "test")(spark.range(1000).coalesce(1), "rows")
    sizes = [r["count"] for r in kept.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 4 * spark.sparkContext.defaultParallelism and max(sizes) < 200


def test_log_tail_sorts_only_the_newest_files(spark):
    """Against a plain walk; lines of older files never come to the task that sorts lines."""
    from quirework.sources.files import log_tail

    random_ = random.Random(6)
    rows = [(f"log.{k // 40:03d}", k, random_.choice((None, "a", "á" * 3, "abcdef"))) for k in range(2000)]
    wanted, total = [], 0
    for row in reversed(rows):
        total += 0 if row[2] is None else len(row[2].encode()) + 1
        if 0 < total <= 300:
            wanted.append(row)
    made = log_tail(spark.createDataFrame(rows, "file string, k int, line string"), "file", "k", "line", 300)
    assert [tuple(r) for r in made.collect()] == wanted[::-1]
    assert "LeftSemi" in made._jdf.queryExecution().optimizedPlan().toString()


def test_sections_of_long_documents_in_blocks(spark, monkeypatch):
    """Against a plain walk: blocks of a few lines hand on what is nearest, whatever lies between; so do intervals and marks."""
    from quirework.operators import outline as O

    monkeypatch.setattr(O, "BLOCK_LINES", 7)
    random_ = random.Random(8)
    rows = [(doc, line, random_.choice((1, 2, 3, 3, 4, 4, 4)), random_.choice("abc")) for doc in (1, 2, 3) for line in sorted(random_.sample(range(1, 300), 90))]
    heads = spark.createDataFrame(rows, "doc_id int, line long, level int, title string")
    found = {(r.doc_id, r.line): r for r in O.section_index(heads, heads.groupBy("doc_id").agg(F.lit(300).cast("long").alias("last_line"))).collect()}
    assert len(found) == len(rows)
    for doc, line, level, _ in rows:
        mine = [r for r in rows if r[0] == doc]
        parent = max((r[1] for r in mine if r[1] < line and r[2] < level), default=None)
        end = min((r[1] - 1 for r in mine if r[1] > line and r[2] <= level), default=300)
        direct = min((r[1] - 1 for r in mine if r[1] > line), default=end)
        assert (found[doc, line].parent_line, found[doc, line].line_end, found[doc, line].direct_line_end) == (parent, end, min(direct, end))
    spans = [(doc, start, start + random_.randrange(40), f"{doc}.{k}") for doc in (1, 2, None) for k, start in enumerate(sorted(random_.sample(range(300), 25)))]
    points = spark.createDataFrame([(doc, at) for doc in (1, 2, 3, None) for at in range(320)], "doc_id int, at int")
    made = {(r.doc_id, r.at): r.v for r in O.inside(points, spark.createDataFrame(spans, "doc_id int, a int, b int, v string"), "doc_id", "at", "a", "b", "v").collect()}
    first = lambda doc, at: min(((a, v) for d, a, b, v in spans if d == doc and a <= at <= b), default=(0, None))[1]
    # An interval is cut to what no earlier one holds, so the first that holds a place has it.
    assert made == {(doc, at): first(doc, at) for doc in (1, 2, 3, None) for at in range(320)}


def test_tasks_hold_no_more_rows_as_tables_grow(spark, monkeypatch):
    from quirework.operators import folds, lifecycle, notes

    monkeypatch.setattr(folds, "TASK_ROWS", 100)
    assert folds.parts_for(spark, 400) is None and folds.parts_for(spark, 2_001) == 21
    pages = spark.range(2_000).selectExpr("id div 4 as doc_id", "cast(id % 4 as int) as page", "if(id % 40 = 0, 'v1', 'v2') as signature")
    now = spark.range(500).selectExpr("id as doc_id", "'v2' as signature")
    made = lifecycle.checkpointed_pages(folds.dealt(pages, folds.parts_for(spark, 2_000), "doc_id"), now)
    assert made.rdd.getNumPartitions() == 20 and made.count() == 1_800
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    boxes = pages.selectExpr("doc_id", "page", "0 as box", "0D as x0", "90D as y0", "9D as x1", "780D as y1", "800D as height", "if(page = 0, 'NOTA: a', 'b') as content")
    found = notes.note_boxes(folds.dealt(boxes, 20, "doc_id"), boxes.selectExpr("doc_id", "page", "y1 as y"), parts=20).collect()
    assert len(found) == 500 and {(r.last_page, r.content) for r in found} == {(3, "NOTA: a b b b")}


def test_recall_takes_no_texts_and_no_other_tokens_through_shuffles(spark):
    from quirework.operators import documents as D

    words = " ".join(f"w{k}" for k in range(20))
    rows = spark.createDataFrame([(1, words, words + " w1 other" * 50), (2, words, "nothing of it"), (3, words, None), (3, words, "w1 w1 w2"), (4, "w1", "w1")], "id long, r string, x string")
    made = D.token_recall(rows, "id", "r", "x")
    assert {(r.id, r.n_reference, r.recall) for r in made.collect()} == {(1, 20, 1.0), (2, 20, 0.0), (3, 20, None), (3, 20, 0.15), (4, 1, None)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join") :].splitlines()[1]
    assert "size(" in joined and "array_intersect" in plan


def test_order_scores_come_from_arrow_arrays(spark):
    from quirework.operators import documents as D

    words = [f"w{k}" for k in range(20)]
    rows = spark.createDataFrame([(1, words, ["x", *words]), (2, words, words[::-1]), (3, words, []), (4, words[:3], words), (5, None, words), (6, words, None)], "id long, r array<string>, x array<string>")
    assert {r.id: r.s for r in rows.select("id", D.order_score("r", "x").alias("s")).collect()} == {1: 1.0, 2: 0.05, 3: None, 4: None, 5: None, 6: None}


def test_order_scores_take_whole_texts(spark):
    """Against difflib over all tokens; beyond the 2,000th the order counts as before it."""
    from difflib import SequenceMatcher

    from quirework.operators import documents as D

    random_ = random.Random(4)
    words = [f"w{k}" for k in range(2_500)]
    pairs = [(words, words[:2_000] + words[:1_999:-1]), (words, ["x"] * 3 + words[2_000:])]
    pairs += [([random_.choice("abcdefgh") for _ in range(random_.randrange(20, 120))], [random_.choice("abcdefghx") for _ in range(random_.randrange(1, 120))]) for _ in range(150)]
    rows = spark.createDataFrame([(k, r, x) for k, (r, x) in enumerate(pairs)], "id long, r array<string>, x array<string>")
    made = {r.id: r.s for r in rows.select("id", D.order_score("r", "x").alias("s")).collect()}
    assert made == {k: SequenceMatcher(None, r, [t for t in x if t in set(r)], autojunk=False).ratio() for k, (r, x) in enumerate(pairs)}
    assert made[0] == 0.8004 and made[1] == 1 / 3


def test_same_letters_are_looked_up_where_they_differ(spark, monkeypatch):
    """A page of its source's letters has the edits that looking up every boundary gives, and only boundaries that differ are looked up."""
    random_ = random.Random(6)
    looked: list[int] = []
    found_at = P.Source.at_context
    monkeypatch.setattr(P.Source, "at_context", lambda *asked: looked.append(1) or found_at(*asked))
    made = []
    for n in (3, 12, 200, 4_000):
        words = ["".join(random_.choice("abcéÉ1") for _ in range(random_.randrange(1, 7))) for _ in range(n)]
        text = "".join(random_.choice(words) + random_.choice((" ", " ", " ", "-", "\t", ". ", "  ", "", " http://a.b/c-d ")) for _ in range(1_500))
        page = "".join("" if c == " " and random_.random() < 0.1 else c + " " if random_.random() < 0.04 else c for c in text)
        looked.clear()
        made.append(P.edits(page, page, None, P.Source([text], frozenset())))
        asked = len(looked)
        # One letter more, apart by an empty line: no longer the same letters, so every boundary is looked up.
        looked.clear()
        every = P.edits(page + "\n\nX", page + "\n\nX", [{"at": 0, "source": 0, "size": len(page) + 3}], P.Source([text, "\n\nX"], frozenset()))
        assert made[-1][:-20] == every[: len(made[-1]) - 20] and len(made[-1]) > 100
        assert n < 4_000 or 20 * asked < len(looked)
        assert P.edited(page, made[-1]) == "".join(part for a, b, c in zip([0, *(e for _, e, _ in made[-1])], [*(s for s, _, _ in made[-1]), len(page)], [*(c for _, _, c in made[-1]), ""], strict=True) for part in (page[a:b], c))
    pages = spark.createDataFrame([(1, 1, "a <b>c</b>"), (1, 2, "a b"), (None, 1, None)], "doc_id long, page int, text string")
    joined = P.repaired_separators(pages, pages.selectExpr("doc_id", "page", "array(text) as passages"))
    assert {(r.page, r.text, r.n_repaired) for r in joined.collect()} == {(1, "a <b>c</b>", 0), (2, "a b", 0), (1, None, 0)}
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
