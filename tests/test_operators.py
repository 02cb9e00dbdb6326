"""Operators on small tables with known results, and properties that must hold."""

import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import markup as K
from quirework.functions import text as T
from quirework.operators import documents as D
from quirework.operators import library as B
from quirework.operators import licences as L
from quirework.operators import outline as O
from quirework.operators import telemetry as M
from quirework.sources import files, sinks
from quirework.streaming.index import breaker_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("seconds", "text"), [(45.0, "45s"), (125.0, "2m 5s"), (65.0, "1m 5s"), (59.5, "1m 0s"), (2.5, "2s")])
def test_durations(spark, seconds, text):
    assert one(spark, T.duration(F.lit(seconds))) == text


def test_text_functions(spark):
    assert one(spark, T.visible(F.lit("**Bold** <!-- c --><u>x</u><br/>a_b *it*"))) == "Bold x\na_b it"
    assert one(spark, T.canonical(F.lit("  PRESCRIÇÃO   Penal "))) == "prescricao penal"
    assert one(spark, T.sanitised(F.lit("senha=abc; License-Key: 1 /Home/app/x ABC-12ab-34CD-56EF-7890 ABC-12ab"))) == "senha=[REDACTED]; License-Key: [REDACTED] %USERPROFILE%/x ABC-[REDACTED] ABC-12ab"
    assert [one(spark, T.roman_value(F.lit(x))) for x in ("XIV", "mcmxc", "IIII", "A")] == [14, 1990, 4, None]
    assert one(spark, T.suspicious(F.lit("a\ufffdb\x01c\n"))) == 2
    assert one(spark, T.json_for_html(F.lit("</script>&\u2028"))) == "\\u003c/script\\u003e\\u0026\\u2028"
    cleaned = K.clean_styles(F.lit("<b></b>x<i> </i></b><b>y****z"))
    assert one(spark, cleaned) == one(spark, K.clean_styles(cleaned)) == "xyz"


def licences(spark):
    rows = [("LIC-1", "Ána Souza", "AAAA-BBBB", "2025-09-03", 3), ("LIC-2", "Bob 100%", "CCCC-DDDD", "2025-12-01", 3), ("LIC-3", "Carl", "EEEE-FFFF", "2025-11-20", 12)]
    df = spark.createDataFrame(rows, "license_id string, customer_name string, machine_id string, start string, months int")
    start = F.col("start").cast("timestamp_ntz")
    return df.select("*", L.normalized_name_column(F.col("customer_name")).alias("normalized_name"), F.lit("ref").alias("customer_reference"), F.lit(1).alias("current_revision"), start.alias("not_before"), L.add_months(start, F.col("months")).alias("expires_at"))


def now(text="2026-02-01 00:00:00"):
    return F.expr(f"timestamp_ntz'{text}'")


def test_search_language(spark):
    rows = licences(spark)
    found = lambda q: [r.license_id for r in L.search(rows, q, now())[0].collect()]
    assert found("status:expirada") == ["LIC-1"] and found("status:expirando") == ["LIC-2"] and found("status:valida") == ["LIC-3"]
    assert found("ANA") == ["LIC-1"] and found("cliente:ána") == ["LIC-1"] and found("maquina:cccc") == ["LIC-2"]
    assert found("expira:365d") == ["LIC-2", "LIC-3"] and found("") == [] and found("%") == ["LIC-1", "LIC-2", "LIC-3"]
    for bad in ("status:x", "expira:xd", "expira:-1d", "expira:9999d"):
        with pytest.raises(ValueError):
            L.parse_search(bad, now())
    with pytest.raises(ValueError):
        L.search(rows, "a", now(), page=0)
    assert L.dashboard(rows, now()).first().asDict() == {"valid": 1, "expiring": 1, "expired": 1}
    assert L.dashboard(rows.where("false"), now()).first().asDict() == {"valid": 0, "expiring": 0, "expired": 0}


def test_state_order_and_boundaries(spark):
    rows = licences(spark).where("license_id = 'LIC-2'")  # until 2026-03-01
    state = lambda at, machine="cccc-dddd", tampered=False: L.evaluate(rows, now(at), F.lit(machine), F.lit(tampered)).select("state", "days_remaining").first()
    assert tuple(state("2026-01-30 00:00:00")) == ("expiring", 30) and tuple(state("2026-01-29 23:59:59")) == ("valid", 31)
    assert tuple(state("2026-02-28 23:59:59")) == ("expiring", 1) and tuple(state("2026-03-01 00:00:00")) == ("expired", 0)
    assert state("2025-11-30 00:00:00").state == "invalid" and state("2026-05-01 00:00:00", "x").state == "machine_mismatch" and state("2026-05-01 00:00:00", tampered=True).state == "clock_tampered"
    by_days = rows.select(L.status_by_whole_days(F.col("expires_at"), now("2026-01-29 12:00:00")).alias("s")).first().s
    assert by_days == "expiring"
    assert str(one(spark, L.add_months(F.expr("timestamp_ntz'2024-01-31 00:00:00'"), F.lit(1)))) == "2024-02-29 00:00:00"


def brute_outline(levels):
    stack, out = [], []
    for line, level in enumerate(levels, 1):
        while stack and out[stack[-1]][1] >= level:
            out[stack.pop()][3] = line - 1
        if stack and out[stack[-1]][4] is None:
            out[stack[-1]][4] = line - 1
        out.append([line, level, out[stack[-1]][0] if stack else None, None, None])
        stack.append(len(out) - 1)
    for node in out:
        node[3] = node[3] or len(levels)
        node[4] = node[4] or node[3]
    return [tuple(n) for n in out]


def test_outlines_equal_a_stack(spark):
    random_ = random.Random(1)
    docs = {d: [random_.randrange(1, 7) for _ in range(random_.randrange(1, 40))] for d in range(40)}
    rows = [(d, k, level, random_.choice("abc")) for d, levels in docs.items() for k, level in enumerate(levels, 1)]
    heads = spark.createDataFrame(rows, "doc_id long, line long, level int, title string")
    out = O.section_index(heads, heads.groupBy("doc_id").agg(F.max("line").alias("last_line")))
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.line, r.level, r.parent_line, r.line_end, r.direct_line_end))
    assert {d: sorted(v) for d, v in got.items()} == {d: brute_outline(v) for d, v in docs.items()}
    assert O.tree_problems(out).count() == 0 and out.select("doc_id", "id").distinct().count() == len(rows)
    broken = out.withColumn("line_end", F.when(F.col("level") == 2, F.col("line") - 1).otherwise(F.col("line_end")))
    assert O.tree_problems(broken).count() > 0


def test_alternatives(spark):
    get = lambda text: tuple(spark.range(1).select(*(c.alias(n) for c, n in zip(D.alternatives(F.lit(text)), "lp", strict=True))).first())
    assert get("Q (A) x (B) y (C) z") == (["A", "B", "C"], None)
    assert get("Q (A) x (B) y (D) z") == (None, "alternative_sequence_inconsistent")
    assert get("A) x B) y A) x B) y") == (None, "multiple_alternative_sequences")
    assert get("a) i b) ii so (A) x (B) y") == (["A", "B"], None) and get("none") == (None, "alternative_boundaries_uncertain")


def test_anchors_and_fuzzy_tokens(spark):
    text = F.lit("one two three two")
    assert one(spark, D.anchors_in_order(F.array(F.lit("one"), F.lit("two"), F.lit("two")), text)) and not one(spark, D.anchors_in_order(F.array(F.lit("three"), F.lit("one")), text))
    words = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, D.nearly_equal(words("a", "protegao"), words("a", "protecao"))) and not one(spark, D.nearly_equal(words("abcd"), words("abce")))


def test_chunks_lose_nothing(spark):
    random_ = random.Random(2)
    texts = [(k, "\n".join("x" * random_.randrange(0, 60) for _ in range(random_.randrange(30)))) for k in range(50)]
    rows = D.chunks(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", 100).collect()
    joined = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk)):
        assert len(r.text) <= 100
        joined.setdefault(r.doc_id, []).extend(r.text.split("\n\n"))
    for k, t in texts:
        assert joined.get(k, []) == ([x for x in t.split("\n") if x] if len(t) > 100 else [])
    sizes = F.array(*(F.lit(x).cast("long") for x in (50, 60, 30, 200, 10)))
    assert one(spark, D.packed(sizes, 100)) == [0, 1, 1, 2, 3]


def test_fidelity(spark):
    reference, reverse = " ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}" for k in reversed(range(40)))
    rows = spark.createDataFrame([(1, reference, reference), (2, reference, "w1 w2"), (3, "few words", reference), (4, reference, ""), (5, reference, reverse)], "id long, r string, x string")
    recall = {r.id: r.recall for r in D.token_recall(rows, "id", "r", "x").collect()}
    assert recall == {1: 1.0, 2: 0.05, 3: None, 4: None, 5: 1.0}
    order = {r.id: r.o for r in rows.select("id", D.order_score(T.tokens(F.col("r")), T.tokens(F.col("x"))).alias("o")).collect()}
    assert order[1] == 1.0 and order[5] < 0.5 and order[3] is None


def test_telemetry(spark):
    rows = spark.createDataFrame([(0.5, "native", 0.95, "", None, 100 << 20), (0.5, "ocr", 0.80, "w", None, 0), (0.5, "failed", None, "w", None, 0)], "seconds double, status string, score double, warning string, cache_hit boolean, rss long")
    got = M.conversion_summary(rows).first()
    assert (got.pages, got.pages_per_second, got.native, got.ocr, got.failed, got.mean_score, got.low_scores, got.warnings, got.hit_ratio, got.peak_mb) == (3, 2.0, 1, 1, 1, 0.875, 1, 2, 0.0, 100.0)
    lines = spark.createDataFrame([("x ERROR memory is full",), ("x WARNING onnx ocr",), ("x INFO sqlite",), ("x CRITICAL sqlite disco",)], "line string")
    counts = M.log_classes(lines, "line").first()
    assert (counts.memory_or_budget, counts.onnx_or_ocr, counts.sqlite_or_storage, counts.permission_or_disk) == (1, 1, 1, 1)


def test_audit_chain_shows_changes(spark):
    rows = spark.createDataFrame([(k % 3, k, f"a{k}") for k in range(30)], "who long, n long, what string")
    chain = M.append_chain(rows, "who", "n", ["n", "what"])
    assert M.verify_chain(chain, "who", "n", ["n", "what"]).where("not valid").count() == 0
    forged = chain.withColumn("what", F.when(F.col("n") == 10, "other").otherwise(F.col("what")))
    assert [r.n for r in M.verify_chain(forged, "who", "n", ["n", "what"]).where("not valid").collect()] == [10]
    assert [r.n for r in M.verify_chain(chain.where("n <> 10"), "who", "n", ["n", "what"]).where("not valid").collect()] == [13]


def test_breaker():
    state, seen = ("closed", 0, 0.0), []
    for at, ok in [(0, False), (1, False), (2, False), (3, True), (61, True), (62.5, False), (63, True), (64, False), (65, False), (66, False), (70, True), (127, False), (128, True)]:
        state, allowed = M.breaker_step(state, float(at), ok)
        seen.append((state[0], allowed))
    assert seen[:4] == [("closed", True), ("closed", True), ("open", True), ("open", False)]
    assert seen[4] == ("open", False) and seen[5] == ("open", True)  # the call that is let through after a minute fails
    assert seen[6] == ("open", False) and state[0] == "open"


def test_breaker_stream_equals_batch(spark, tmp_path):
    random_ = random.Random(3)
    calls = [(k % 4, float(3 * k), random_.random() < 0.5, k) for k in range(200)]
    spark.createDataFrame(calls, "who long, at double, ok boolean, n long").coalesce(1).write.parquet(f"{tmp_path}/calls")
    stream = spark.readStream.schema("who long, at double, ok boolean, n long").parquet(f"{tmp_path}/calls")
    breaker_stream(stream, "who").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r.who, r["at"]): (r.state, r.allowed) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = M.breaker(spark.createDataFrame(calls, "who long, at double, ok boolean, n long").withColumn("ts", F.timestamp_seconds("at")), "who", "n", "ts", "ok").collect()
    at = {c[3]: c[1] for c in calls}
    assert got == {(r.who, at[r.n]): (r.state, r.allowed) for r in batch}


def test_clock(spark):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(("10:00", "10:10", "10:06", "10:04", "10:20"))], "who long, n long, t string").withColumn("local", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t")))
    assert [r.tampered for r in M.clock_check(rows, "who", "n", "local").orderBy("n").collect()] == [False, False, False, True, False]


def test_search_ranks_and_snippets(spark):
    docs = spark.createDataFrame([(1, "prescription of criminal law " * 3), (2, "criminals and law"), (3, "nothing here"), (4, "<b>law</b> criminal"), (5, None)], "doc_id long, text string")
    assert {r.doc_id for r in B.bm25(docs, "doc_id", "text", "Criminal law").collect()} == {1, 2, 4} and B.bm25(docs, "doc_id", "text", " ?! ").count() == 0
    text = docs.where("doc_id = 4").select(B.snippet(F.col("text"), ["criminal"]).alias("s")).first().s
    assert text == "&lt;b&gt;law&lt;/b&gt; <mark>criminal</mark>"
    assert B.search_words("a_b  c-d") == ["a", "b", "c", "d"]


def test_names(spark):
    batch = spark.createDataFrame([(1, "Doc"), (2, "doc"), (3, "other")], "n long, stem string")
    taken = spark.createDataFrame([("doc",), ("other (2)",)], "name string")
    assert [r.reserved for r in B.reserve_names(batch, "stem", "n").orderBy("n").collect()] == ["Doc", "doc (2)", "other"]
    assert [r.reserved for r in B.reserve_names(batch, "stem", "n", taken).orderBy("n").collect()] == ["Doc (2)", "doc (3)", "other"]
    three = spark.createDataFrame([(n, "a") for n in range(4)], "n long, stem string")
    in_use = spark.createDataFrame([("A (2)",), ("a (5)",), ("a (1)",)], "name string")
    assert [r.reserved for r in B.reserve_names(three, "stem", "n", in_use).orderBy("n").collect()] == ["a", "a (3)", "a (4)", "a (6)"]


def test_upsert_is_idempotent(spark):
    names = ["file_name", "file_size", "page_count", "last_page_read", "preferred_zoom", "markdown_path", "is_converted", "last_accessed", "availability_status", "index_status"]
    row = lambda key, size, seq: (key, f"n{seq}", size, 1, seq, "1", "m", 1, seq, "available", "done", seq)
    schema = "file_path long, file_name string, file_size long, page_count long, last_page_read long, preferred_zoom string, markdown_path string, is_converted int, last_accessed long, availability_status string, index_status string, seq long"
    changes = spark.createDataFrame([row(1, 0, 1), row(1, 7, 2), row(2, 0, 1)], schema)
    old = spark.createDataFrame([row(2, 5, 0), row(3, 9, 0)], schema).drop("seq")
    for kind in B.ON_CONFLICT:
        first = B.upsert(old, changes, kind)
        assert sorted(first.select("file_path", *names).collect()) == sorted(B.upsert(first, changes, kind).select("file_path", *names).collect())
    assert {r.file_path: r.file_size for r in B.upsert(old, changes, "metadata").collect()} == {1: 7, 2: 5, 3: 9}
    assert {r.file_path: r.file_size for r in B.upsert(old, changes, "full").collect()} == {1: 7, 2: 0, 3: 9}


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("# T\n\n| a | b |\n|---|---|\n| 1 | 2\\|3 |\n\n```\n| no | table |\n|---|---|\n```\n| ragged |\n|---|---|\n")
    docs = files.markdown_files(spark, str(tmp_path / "a"))
    assert [r.rows for r in files.markdown_tables(docs, "file_path", "markdown").collect()] == [[["a", "b"], ["1", "2\\|3"]]]
    assert files.usage(files.listing(spark, str(tmp_path))).first().files == 1
    rows = spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":1,"a":2}',), ('{"a":1}',), ("x",), (None,)], "t string")
    assert [r.problem for r in files.strict_json(rows, "t", ["a", "b"]).collect()] == [None, "duplicate_key", "fields", "json", "size"]
    page = spark.createDataFrame([("T<", '{"x":"</script>"}', "b&")], "title string, payload string, text string")
    sinks.html(page, str(tmp_path / "html"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "html")).collect())
    assert text.count("</script>") == 1 and "b&amp;" in text
    sinks.chunk_files(spark.createDataFrame([(1, 1, "see ](images/a.png)")], "doc_id long, chunk int, text string"), str(tmp_path / "chunks"), "doc_id")
    assert spark.read.json(str(tmp_path / "chunks")).first().text == "see ](../images/a.png)"
    listed = spark.createDataFrame([("src/a.py",), (".git/x.py",), ("node_modules/y.py",), ("b.txt",)], "p string")
    assert [r.p for r in listed.where(files.included(F.col("p"), ("node_modules",), (".py",))).collect()] == ["src/a.py"]


def test_batch_control(spark):
    assert one(spark, M.waits(1.0, 2.0, 5, F.lit(6.9))) == [1.0, 2.0] and one(spark, M.waits(1.0, 2.0, 1, F.lit(9.0))) == []
    state = lambda *x: one(spark, M.batch_state(F.array(*map(F.lit, x)).cast("array<string>")))
    assert (state("paused", "paused"), state("paused", "running"), state("running", "failed"), state()) == ("paused", "running", "failed", "idle")
    assert [one(spark, M.percent(F.lit(a), F.lit(b))) for a, b in ((1, 3), (0, 0), (5, 5))] == [33, 0, 100]
    assert one(spark, M.workers(F.lit(9), F.lit(8), F.lit(3 << 30))) == 3


def test_problem_pages_and_retries(spark):
    from quirework.operators import telemetry

    rows = [("b", "x", 1, "failed", False), ("b", "x", 1, "native", True), ("b", "x", 2, "failed", None), ("b", "y", 1, None, None), ("c", "z", 1, "ocr", False)]
    counts = telemetry.page_problem_counts(spark.createDataFrame(rows, "batch string, name string, page int, status string, review boolean"))
    assert sorted(map(tuple, counts.collect())) == [("b", 1, 2, 1, 1), ("c", 0, 0, 0, 0)]
    pages = spark.createDataFrame([("x", 1, "failed", None), ("x", 2, "failed", None), ("x", 3, "native", "c"), ("y", 1, "failed", None)], "name string, page int, status string, text string")
    selected = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("x", 9)], "name string, page int")
    again = spark.createDataFrame([("x", 1, "ocr", "a"), ("x", 2, "failed", "b"), ("x", 3, "ocr", "d"), ("y", 1, "ocr", "e"), ("x", 9, "ocr", "f")], pages.schema)
    got = telemetry.retried_pages(pages, selected, again).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [("x", 1, "ocr", "a", 2), ("x", 2, "failed", None, 1), ("x", 3, "native", "c", 1), ("y", 1, "failed", None, 1)]
