"""Queries on page geometry, repairs, exams and file forms, over texts and boxes made from the keys of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import documents as D
from quirework.operators import exams as E
from quirework.operators import layout as B
from quirework.operators import outline as O
from quirework.operators import repair as R
from quirework.plans.lifecycle import one_of
from quirework.plans.registry import query, table
from quirework.sources import files as S


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("page"), "c_name")


@query("select l_orderkey, l_linenumber, l_partkey, (l_partkey % 800) + 20 <= 80 or l_partkey % 800 >= 720 as margin, l_suppkey % 100 >= 88 and l_partkey % 20 <= 13 and l_partkey % 30 <= 15 as edge from lineitem")
def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in the outer tenth of a page of 800, and images that may be ornaments of its right edge."""
    y, part = F.col("l_partkey") % 800, F.col("l_partkey")
    edge = B.edge_image(F.col("l_suppkey") % 100, part % 20, part % 30, F.lit(100), F.lit(100))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", B.in_margin(y, y + 20, F.lit(800)).alias("margin"), edge.alias("edge"))


@query("""select c_custkey as k, case c_custkey % 4 when 0 then c_custkey % 15 between 10 and 13 when 1 then c_custkey % 3 = 0 when 2 then c_custkey % 5 = 0 else c_custkey % 7 = 0 end as valid from customer""")
def field_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = customers(spark, sf_dir), F.col("k")
    label = one_of(k, "phone", "email", "name", "tax_id")
    email, name, tax = F.when(k % 3 == 0, "a@b.cd").otherwise("a@b"), F.when(k % 5 == 0, " Ana Maria ").otherwise("Ana"), F.when(k % 7 == 0, "123.456.789-01").otherwise("123")
    value = F.when(k % 4 == 0, F.repeat(F.lit("7-"), (k % 15).cast("int"))).when(k % 4 == 1, email).when(k % 4 == 2, name).otherwise(tax)
    return rows.select("k", B.valid_field(label, value).alias("valid"))


@query("""with b as (select c_nationkey as page, c_custkey as k, c_custkey % 7 as r, case when c_custkey % 7 = 0 then 40 else 20 end as tall from customer where c_custkey % 10 <> 0),
 l as (select page, r, max(tall) as h, string_agg(k::varchar, ' ' order by k) as text from b group by 1, 2)
 select page, (row_number() over (partition by page order by r) - 1)::int as line, text, h >= 1.38 * avg(h) over (partition by page) as heading from l""")
def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of text on up to seven lines of a page, from left to right; unsure ones are passed over."""
    k = F.col("k")
    y, tall = (k % 7 * 50 + k % 3).cast("double"), F.when(k % 7 == 0, 40.0).otherwise(20.0)
    boxes = customers(spark, sf_dir).select("page", k.cast("string").alias("text"), F.when(k % 10 == 0, 0.2).otherwise(0.9).alias("score"), k.cast("double").alias("x_min"), y.alias("y_min"), (k + 1).cast("double").alias("x_max"), (y + tall).alias("y_max"))
    return B.text_lines(boxes, "page")


@query("select s_nationkey as page, s_suppkey * 200.0::double as x0, 10.0::double as y0, s_suppkey * 200.0::double + 150 as x1, 60.0::double as y1 from supplier where s_suppkey % 3 <> 0")
def drawn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from their four sides; one in three lacks its lower side."""
    x = F.col("s_suppkey") * 200.0
    side = lambda a, b, c, d: F.struct(a.cast("double").alias("x0"), b.cast("double").alias("y0"), c.cast("double").alias("x1"), d.cast("double").alias("y1"))
    top, low = F.lit(10.0), F.lit(60.0)
    sides = F.array(side(x, top, x, low), side(x + 150, top, x + 150, low), side(x, top, x + 150, top), F.when(F.col("s_suppkey") % 3 != 0, side(x, low, x + 150, low)))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), F.explode(sides).alias("s")).where("s is not null").select("page", "s.*")
    return B.closed_boxes(rows)


@query('select c_custkey as doc_id, p::int as page, (case when c_custkey % 6 = 0 then 1 else p end)::long as "group" from customer, unnest([1, 2, 3]) as t(p)')
def continued_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables on three pages that go on only where they begin high on the page and have an empty first cell."""
    k = F.col("k")
    rows = customers(spark, sf_dir).select(k.alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page"), F.when(k % 2 == 0, 80.0).otherwise(400.0).alias("y0"), F.lit(760.0).alias("y1"), F.lit(800.0).alias("height"), F.array(F.lit(10.0), F.lit(90.0)).alias("edges"), F.when(k % 3 == 0, " ").otherwise("x").alias("first_cell"))
    return B.continued_tables(rows).select("doc_id", "page", "group")


@query('select n_nationkey as "table", n_nationkey as source from nation where n_nationkey % 5 <> 0')
def matched_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and their sources by columns; those whose source occurs twice aren't matched."""
    row = lambda a, b: F.array(a.cast("string"), b.cast("string"))
    rows = F.array(row(F.lit("a"), F.lit("b")), row(F.col("n_name"), F.col("n_nationkey")))
    tables = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("table_id"), F.col("n_regionkey").alias("page"), rows.alias("rows"))
    again = tables.where("table_id % 5 = 0").withColumn("table_id", F.col("table_id") + 100)
    return B.unique_tables(tables, tables.unionByName(again))


@query("""select c_custkey as doc_id, case c_custkey % 3 when 0 then 'exem' else 'guarda' end as first, case c_custkey % 3 when 0 then 'plo' else 'chuva' end as second, case c_custkey % 3 when 0 then 'exemplo' else 'guarda-chuva' end as joined from customer where c_custkey % 3 < 2""")
def hyphenated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a line end cut, joined as the vocabulary has them; without evidence they stay."""
    k = F.col("k")
    text = F.when(k % 3 == 0, "um exem-\nplo bom").when(k % 3 == 1, "o guarda-\nchuva").otherwise("sem pro-\nva")
    lines = D.lines(customers(spark, sf_dir).select(k.alias("doc_id"), text.alias("text")), "doc_id", "text")
    vocabulary = spark.createDataFrame([("Exemplo",), ("guarda-chuva",)], "word string")
    return R.hyphenations(lines, vocabulary)


@query("""select c_custkey as doc_id, p::int as page, (case when c_custkey % 6 = 0 then 3 else p end)::int as last_page, case when c_custkey % 6 = 0 then 'fim um fim um fim um' else (case when c_custkey % 3 = 0 then 'fim' else 'Fim' end) || ' um' || (case when c_custkey % 2 = 0 then '' else '.' end) end as text
 from customer, unnest([1, 2, 3]) as t(p) where c_custkey % 6 <> 0 or p = 1""")
def continued_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that go on over pages: no closing sign before, lower case after."""
    k = F.col("k")
    text = F.concat(F.when(k % 3 == 0, "fim").otherwise("Fim"), F.lit(" um"), F.when(k % 2 == 0, "").otherwise("."))
    pages = customers(spark, sf_dir).select(k.alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page"), F.lit("native").alias("status"), text.alias("text"))
    return R.joined_pages(pages)


@query("""select c_custkey as doc_id, case when c_custkey % 2 = 0 then 'de [REDACTED], e Anamariana' else 'de Ána-Maria, e Anamariana' end as text, (case when c_custkey % 2 = 0 then 1 else 0 end)::int as n_masked from customer""")
def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known values masked however they are written, but not as parts of longer words."""
    k = F.col("k")
    rows = customers(spark, sf_dir).select(k.alias("doc_id"), F.lit("de Ána-Maria, e Anamariana").alias("text"))
    values = customers(spark, sf_dir).where(k % 2 == 0).select(k.alias("doc_id"), F.explode(F.array(F.lit("Ána Maria"), F.lit("Ána"))).alias("value"))
    return R.masked(rows, values)


@query("""select c_custkey as doc_id, p::int as line, ([2, 3, 4, 4, 2])[p]::int as level from customer, unnest([1, 2, 3, 4, 5]) as t(p)""")
def course_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of course headings: by the depth of their numbers, and under them by signs."""
    titles = F.array(*map(F.lit, ("1. Parte", "1.1. Tema", "I - Item", "II) Item", "2 Parte")))
    rows = customers(spark, sf_dir).select(F.col("k").alias("doc_id"), F.posexplode(titles).alias("line", "title")).withColumn("line", F.col("line") + 1)
    return R.heading_levels(rows).select("doc_id", "line", "level")


@query("select p_partkey, case p_partkey % 5 when 0 then 'questions' when 1 then 'answers' when 2 then 'questions' end as kind from part")
def collection_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = one_of(F.col("p_partkey"), "3.1. QUESTÕES DE PROVA", "Gabarito comentado", "Exercícios (parte 2)", "Sobre questões", "Parte")
    return table(spark, sf_dir, "part").select("p_partkey", E.collection_kind(title).alias("kind"))


@query("""select c_custkey as doc_id, n::int as number, 'Qual?' as stem, 'A,B,C' as labels, case when n = 1 then null when c_custkey % 2 = 0 then 'answer_not_in_observed_alternatives' else 'answer_missing_or_ambiguous' end as problem, case when n = 1 then 'B' when c_custkey % 2 = 0 then 'E' end as answer from customer, unnest([1, 2]) as t(n)""")
def exam_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the answers of their numbers, and what is wrong with them."""
    k, body = F.col("k"), F.lit("Qual? A) um B) dois C) tres")
    section = lambda title, kind, text: F.struct(F.lit(title).alias("title"), F.lit(kind).alias("kind"), text.alias("body"))
    every = [section("1. (Prova)", "questions", body), section("2. (Prova)", "questions", body), section("1. B", "answers", F.lit("")), section("2. E", "answers", F.lit(""))]
    rows = customers(spark, sf_dir).select(k.alias("doc_id"), F.explode(F.array(*every)).alias("s")).select("doc_id", "s.*")
    rows = rows.where(~((F.col("title") == "2. E") & (F.col("doc_id") % 2 == 1)))
    found = E.exam_index(rows)
    return found.select("doc_id", "number", "stem", F.array_join("labels", ",").alias("labels"), "problem", "answer")


@query("""select c_custkey as doc_id, 'Parte ' || c_custkey as title, (c_custkey % 90)::int as announced_page from customer union all select c_custkey, '2. Longo titulo', 7 from customer""")
def contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of contents in tables; a numbered cell without leaders begins the next title."""
    k = F.col("k").cast("string")
    text = F.concat(F.lit("| Parte "), k, F.lit(" ..... "), (F.col("k") % 90).cast("string"), F.lit(" |\n| 2. |\n| Longo titulo .... 7 |\ntexto ... 9"))
    lines = D.lines(customers(spark, sf_dir).select(F.col("k").alias("doc_id"), text.alias("text")), "doc_id", "text")
    return E.contents_entries(lines).select("doc_id", "title", "announced_page")


@query("""select c_custkey as doc_id, c::int as chunk, array_to_string(list_transform(range(c * 3, least(c * 3 + 3, 8)), lambda i: lpad(i::varchar, 30, 'x')), chr(10) || chr(10)) as text from customer, unnest([0, 1, 2]) as t(c) where c_custkey % 2 = 0""")
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of 30 characters, three to a chunk of 100; a text that fits has none."""
    parts = F.transform(F.sequence(F.lit(0), F.when(F.col("k") % 2 == 0, 7).otherwise(1)), lambda i: F.lpad(i.cast("string"), 30, "x"))
    rows = customers(spark, sf_dir).select(F.col("k").alias("doc_id"), F.array_join(parts, "\n\n").alias("text"))
    return E.split_documents(rows, 100)


@query("""select l_orderkey as id, case when bool_and(l_partkey % 50 <> 0 and coalesce(case when l_partkey % 3 > 0 then (l_partkey % 10) / 10.0::double end, 0.1) >= 0.1) is false then 'failed' when count(case when l_partkey % 3 > 0 then 1 end) = 0 then 'inconclusive' else 'passed' end as status, min(case when l_partkey % 3 > 0 then (l_partkey % 10) / 10.0::double end) as lowest from lineitem group by 1""")
def corpus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    cases = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("page"), F.when(part % 3 > 0, (part % 10) / 10.0).alias("score"), F.lit(0.1).alias("minimum"), (part % 50 != 0).alias("status_ok"), F.lit(True).alias("anchors_ok"))
    return E.corpus_gate(cases)


@query("""select doc_id, sha256('<!-- PAGE page=' || (doc_id % 100) || ' status=' || (case doc_id % 3 when 0 then 'native' when 1 then 'failed' else 'empty' end) || ' -->' || chr(10) || chr(10) || (case when doc_id % 3 > 0 then '> [!WARNING]' || chr(10) || '> page ' || (doc_id % 100) || ': ' || (case doc_id % 3 when 1 then 'failed' else 'empty' end) || chr(10) || chr(10) else '' end) || text) as text from documents""")
def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = one_of(F.col("doc_id"), "native", "failed", "empty")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(D.with_marker(F.col("doc_id") % 100, status, F.col("text")), 256).alias("text"))


@query("""select c_custkey as k, case c_custkey % 5 when 0 then null when 1 then 'json' when 2 then 'duplicate_key' when 3 then 'fields' else 'size' end as problem from customer""")
def strict_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with exactly the wanted fields, once each, and not too long."""
    name = F.col("c_name")
    texts = [F.concat(F.lit('{"a": 1, "b": "'), name, F.lit('"}')), F.concat(F.lit('{"a": '), name), F.lit('{"a": 1, "b": 2, "a": 3}'), F.lit('{"a": 1}'), F.concat(F.lit('{"a": 1, "b": "'), F.repeat(name, 9000), F.lit('"}'))]
    rows = customers(spark, sf_dir).select("k", F.element_at(F.array(*texts), (F.col("k") % 5 + 1).cast("int")).alias("text"))
    return S.strict_json(rows, "text", ["a", "b"]).select("k", "problem")


@query("""select c_custkey as k, 0::int as "table", 'Nome;Valor/x|y;' || c_custkey as rows from customer where c_custkey % 3 = 0""")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with one rule and equal widths, outside of code."""
    k = F.col("k").cast("string")
    good, uneven, fenced = (F.concat(F.lit(a), k, F.lit(b)) for a, b in (("x\n| Nome | Valor |\n|---|---|\n| x\\|y | ", " |\n"), ("| a | b |\n|---|---|\n| ", " |\n"), ("```\n| a | b |\n|---|---|\n| c | ", " |\n```")))
    text = F.element_at(F.array(good, uneven, fenced), (F.col("k") % 3 + 1).cast("int"))
    found = S.markdown_tables(customers(spark, sf_dir).withColumn("text", text), "k", "text")
    joined = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("\\|"), F.lit("|"))), ";")), "/")
    return found.select("k", "table", joined.alias("rows"))


@query("select c_custkey as k, c_custkey % 4 = 0 as included from customer")
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that belong to a project by folder and ending."""
    path = F.concat(one_of(F.col("k"), "src/a/", "src/.git/", "node_modules/x/", "src/b/"), F.col("k").cast("string"), one_of(F.col("k"), ".PY", ".py", ".py", ".exe"))
    return customers(spark, sf_dir).select("k", S.included(path, ("node_modules",), (".py", ".md")).alias("included"))


@query("""with l as (select 'log.' || lpad((event_id // 500)::varchar, 9, '0') as file, event_id, event_type as line from events), s as (select *, sum(strlen(line) + 1) over (order by file desc, event_id desc rows between unbounded preceding and current row) as total from l) select file, event_id, line from s where total <= 20000""")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20,000 bytes of rotated logs."""
    file = F.concat(F.lit("log."), F.lpad(F.floor(F.col("event_id") / 500).cast("string"), 9, "0"))
    return S.log_tail(table(spark, sf_dir, "events").select(file.alias("file"), "event_id", F.col("event_type").alias("line")), "file", "event_id", "line", 20_000)


@query("""with s as (select c_custkey as doc_id, unnest([{'line': 1, 'code': 'none'}, {'line': 5, 'code': case when c_custkey % 5 = 0 then 'invalid_parent_or_interval' end}, {'line': 5, 'code': case when c_custkey % 3 = 0 then 'invalid_direct_interval' end},
   {'line': 10, 'code': case when c_custkey % 2 = 0 then 'section_sibling_overlap' end}, {'line': 10, 'code': case when c_custkey % 7 = 0 and (c_custkey % 5 > 0 or c_custkey % 2 = 0) then 'duplicate_id' end}]) as x from customer) select doc_id, x.code as code, x.line::int as line from s where x.code is not null and x.code <> 'none'""")
def section_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees with a child that ends after its parent, a wrong direct end, overlapping siblings and repeated ids."""
    k = F.col("k")
    section = lambda name, parent, level, line, end, direct: F.struct(name.alias("id"), parent.alias("parent_line"), F.lit(level).alias("level"), F.lit(line).alias("line"), end.alias("line_end"), direct.alias("direct_line_end"))
    alone = (k % 5 == 0) & (k % 2 == 1)  # these have no third section
    end = F.when(alone, 40).when(k % 5 == 0, 90).when(k % 2 == 0, 12).otherwise(9)
    root = section(F.lit("a"), F.lit(None).cast("int"), 1, 1, F.lit(30), F.lit(4))
    child = section(F.lit("b"), F.lit(1), 2, 5, end, F.when(k % 3 == 0, 4).otherwise(6))
    other = F.when(~alone, section(F.when(k % 7 == 0, "b").otherwise("c"), F.lit(1), 2, 10, F.lit(20), F.lit(11)))
    rows = customers(spark, sf_dir).select(k.alias("doc_id"), F.explode(F.array(root, child, other)).alias("s")).where("s is not null").select("doc_id", "s.*")
    return O.tree_problems(rows).select("doc_id", "code", "line")
