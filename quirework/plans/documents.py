"""Queries on documents. An outline of regions, nations, customers and orders stands for section trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions.markup import clean_styles
from quirework.functions.text import canonical, roman_value, visible
from quirework.operators import documents as D
from quirework.operators import outline as O
from quirework.operators.layout import counted_within
from quirework.plans.markup import keeper
from quirework.plans.registry import query, table

OUTLINE = """nodes as (select r_regionkey as doc_id, null as n, null as c, null as o, 1 as level, r_name as title from region
   union all select n_regionkey, n_nationkey, null, null, 2, n_name from nation
   union all select n_regionkey, n_nationkey, c_custkey, null, 3, c_name from customer join nation on c_nationkey = n_nationkey
   union all select n_regionkey, n_nationkey, c_custkey, o_orderkey, 4, 'Order of ' || o_orderpriority from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
 headings as (select doc_id, row_number() over (partition by doc_id order by n nulls first, c nulls first, o nulls first) as line, level, title from nodes)"""


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, level, title): a document for each region."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    none = F.lit(None).cast("long")
    of_nation = nation.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").cast("long").alias("n"), "n_name")
    of_customer = customer.select(F.col("c_nationkey").cast("long").alias("n"), F.col("c_custkey").alias("c"), "c_name").join(of_nation, "n")
    of_order = orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), F.concat(F.lit("Order of "), "o_orderpriority").alias("title")).join(of_customer, "c")
    rows = [
        region.select(F.col("r_regionkey").alias("doc_id"), none.alias("n"), none.alias("c"), none.alias("o"), F.lit(1).alias("level"), F.col("r_name").alias("title")),
        of_nation.select("doc_id", "n", none.alias("c"), none.alias("o"), F.lit(2).alias("level"), F.col("n_name").alias("title")),
        of_customer.select("doc_id", "n", "c", none.alias("o"), F.lit(3).alias("level"), F.col("c_name").alias("title")),
        of_order.select("doc_id", "n", "c", "o", F.lit(4).alias("level"), "title"),
    ]
    every = rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])
    # A line's number is how many lines the nations, and customers of its nation, before its own have, and its rank among those of
    # its customer; so no task sorts a region, of which there are five.
    within = Window.partitionBy("doc_id", "n", "c").orderBy(F.col("o").asc_nulls_first())
    of_c = every.groupBy("doc_id", "n", "c").agg(F.count("*").alias("lines"))
    of_n = of_c.groupBy("doc_id", "n").agg(F.sum("lines").alias("lines"))
    earlier = lambda keys, k: F.coalesce(F.sum("lines").over(Window.partitionBy(*keys).orderBy(F.col(k).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts_n = of_n.select(F.col("doc_id").alias("_d"), F.col("n").alias("_n"), earlier(["doc_id"], "n").alias("before_n"))
    starts_c = of_c.select("doc_id", "n", "c", earlier(["doc_id", "n"], "c").alias("before_c"))
    starts = starts_c.join(starts_n, starts_c["doc_id"].eqNullSafe(starts_n["_d"]) & starts_c["n"].eqNullSafe(starts_n["_n"]))
    starts = starts.select(F.col("doc_id").alias("_d"), F.col("n").alias("_n"), F.col("c").alias("_c"), (F.col("before_n") + F.col("before_c")).alias("before"))
    ranked = every.withColumn("rank", F.row_number().over(within))
    same = [ranked[k].eqNullSafe(starts[f"_{'d' if k == 'doc_id' else k}"]) for k in ("doc_id", "n", "c")]
    return ranked.join(starts, same).select("doc_id", (F.col("before") + F.col("rank")).alias("line"), "level", "title")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = keeper(spark, "sections")
    found = kept(headings(spark, sf_dir), "headings")
    return kept(O.section_index(found, found.groupBy("doc_id").agg(F.max("line").alias("last_line")), kept=kept), "sections")


ABOVE = ", ".join(f"max(case when level = {k} then line end) over b as a{k}, min(case when level = {k} then line end) over f as z{k}" for k in (1, 2, 3, 4))
INDEX = f"""{OUTLINE}, near as (select *, {ABOVE}, max(line) over (partition by doc_id) as last_line from headings
   window b as (partition by doc_id order by line rows between unbounded preceding and 1 preceding), f as (partition by doc_id order by line rows between 1 following and unbounded following)),
 ends as (select *, case level when 2 then a1 when 3 then greatest(a1, a2) when 4 then greatest(a1, a2, a3) end as parent_line,
   coalesce(case level when 1 then z1 when 2 then least(z1, z2) when 3 then least(z1, z2, z3) else least(z1, z2, z3, z4) end - 1, last_line) as line_end, least(z1, z2, z3, z4) - 1 as next_line from near),
 tree as (select e.*, coalesce(least(e.next_line, e.line_end), e.line_end) as direct_line_end,
   concat_ws(chr(31), g.title, h.title, p.title, e.title) as path, (g.title is not null)::int + (h.title is not null)::int + (p.title is not null)::int as depth
   from ends e left join ends p on p.doc_id = e.doc_id and p.line = e.parent_line left join ends h on h.doc_id = e.doc_id and h.line = p.parent_line left join ends g on g.doc_id = e.doc_id and g.line = h.parent_line),
 sections as (select *, row_number() over (partition by doc_id, path order by line)::int as occurrence from tree)"""


@query(f"with {INDEX} select doc_id, line, level, title, parent_line, line_end, direct_line_end, depth, occurrence, 'section-' || left(sha256(path || chr(31) || occurrence), 20) as id from sections")
def section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("doc_id", "line", "level", "title", "parent_line", "line_end", "direct_line_end", F.size("context").alias("depth"), "occurrence", "id")


@query("select 0 as doc_id, '' as code, 0::bigint as line where false")
def section_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.tree_problems(sections(spark, sf_dir)).select("doc_id", "code", "line")


@query(f"with {INDEX}, v as (select doc_id, count(*) as sections, max(line_end) as lines, 'passed' as status from sections group by doc_id) select * from v")
def section_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections(spark, sf_dir)
    bad = O.tree_problems(rows).groupBy("doc_id").agg(F.count("*").alias("bad"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sections"), F.max("line_end").alias("lines")).join(bad, "doc_id", "left").select("doc_id", "sections", "lines", F.when(F.col("bad") > 0, "failed").otherwise("passed").alias("status"))


@query(f"with {OUTLINE} select doc_id, line, heading from (select doc_id, line, level, max(case when level = 3 then title end) over (partition by doc_id, grp) as heading from (select *, count(case when level = 3 then 1 end) over (partition by doc_id order by line) as grp from headings)) where level = 4")
def heading_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading that each line stands under: the last one at or before it."""
    found = keeper(spark, "sections")(headings(spark, sf_dir), "headings")
    marks = found.where("level = 3").select("doc_id", "line", F.col("title").alias("heading"))
    return O.as_of(found.where("level = 4").select("doc_id", "line"), marks, "doc_id", "line", "heading").select("doc_id", "line", "heading")


@query(f"with {INDEX}, i as (select doc_id, line as a, line_end as b, title from sections where level = 3), p as (select doc_id, line from sections where level = 4) select p.doc_id as doc_id, p.line as line, min_by(title, a) as title from p left join i on i.doc_id = p.doc_id and p.line between a and b group by 1, 2")
def block_in_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections(spark, sf_dir)
    points = found.where("level = 4").select("doc_id", "line")
    return O.inside(points, found.where("level = 3").select("doc_id", "line", "line_end", "title"), "doc_id", "line", "line", "line_end", "title")


@query(f"""with {INDEX}, s as (select doc_id, title, id, line // 50 + 1 as page_start from (select *, 'section-' || left(sha256(path || chr(31) || occurrence), 20) as id from sections) where level < 4),
 e as (select doc_id, '  ' || upper(title) || ' ' as title, 1 as toc_page, (line // 50 + 1 + line % 2) as announced_page from sections where level = 2),
 j as (select e.*, count(s.id) as n, max(s.id) as sid, max(s.page_start) as page from e left join s on s.doc_id = e.doc_id and lower(s.title) = lower(trim(e.title)) and s.page_start <> e.toc_page group by all)
 select doc_id, title, announced_page, case when n = 1 then sid end as section_id, case when n = 1 then page end as actual_page, case when n = 0 then 'unresolved' when n > 1 then 'ambiguous' when page <> announced_page then 'source_discrepancy' else 'matched' end as status from j""")
def contents_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = (F.floor(F.col("line") / 50) + 1).cast("long")
    found = sections(spark, sf_dir).withColumn("page_start", page)
    entries = found.where("level = 2").select("doc_id", F.concat(F.lit("  "), F.upper("title"), F.lit(" ")).alias("title"), F.lit(1).alias("toc_page"), (F.col("page_start") + F.col("line") % 2).alias("announced_page"))
    return D.match_contents(entries, found.where("level < 4")).select("doc_id", "title", "announced_page", "section_id", "actual_page", "status")


@query("""with q as (select l_orderkey * 10 + l_linenumber as number, l_partkey from lineitem), m as (select *, count(*) over (partition by number) as c from q),
 a as (select o_orderkey * 10 + 1 as number, o_orderpriority as answer from orders)
 select m.number as number, l_partkey, case when c = 1 then answer end as answer from m left join a on a.number = m.number""")
def answers_of_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("number"), "l_partkey")
    answers = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10 + 1).alias("number"), F.col("o_orderpriority").alias("answer"))
    return O.unique_match(questions, answers, "number", "answer").select("number", "l_partkey", "answer")


CANDIDATES = """pages_in as (select doc_id, doc_id % 5 = 0 as scanned, case when doc_id % 3 = 0 then '' else text end as native, case when doc_id % 7 = 0 then '  ' else source end as direct, case when doc_id % 4 = 0 then lang end as ocr from documents)"""
FILLED = lambda c: f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"


@query(f"""with {CANDIDATES}, c as (select doc_id, scanned, {FILLED('native')} as n, {FILLED('direct')} as d, {FILLED('ocr')} as o from pages_in)
 select doc_id, sha256(case when scanned then coalesce(o, d, n) else coalesce(n, d, o) end) as text, case when scanned then case when o is not null then 'ocr' when d is not null then 'fallback' when n is not null then 'native' else 'empty' end
   else case when n is not null then 'native' when d is not null then 'fallback' when o is not null then 'ocr' else 'empty' end end as status from c""")
def page_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    native, direct, ocr = F.when(doc % 3 == 0, "").otherwise(F.col("text")), F.when(doc % 7 == 0, "  ").otherwise(F.col("source")), F.when(doc % 4 == 0, F.col("lang"))
    text, status = D.extracted(doc % 5 == 0, native, direct, ocr, F.lit(False))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("text"), status.alias("status"))


@query("select doc_id, case when n_chars % 90 >= 40 then false when doc_id % 2 = 0 then true else n_chars % 90 = 0 end as scanned, case when n_chars % 4 = 0 then 'text' when n_chars % 4 = 1 then 'recognised_text' when doc_id % 2 = 0 then 'visual' else 'none' end as kind from documents")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = F.col("doc_id") % 2 == 0
    status = F.element_at(F.array(F.lit("native"), F.lit("ocr"), F.lit("empty"), F.lit("failed")), (F.col("n_chars") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", D.scanned(F.col("n_chars") % 90, images).alias("scanned"), D.content_kind(status, images).alias("kind"))


@query("select user_id, true as blank from events group by user_id")
def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 4 + 250).alias("v")))), lambda x: x.v)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(D.blank(samples).alias("blank"))


KIND = """case when regexp_matches(head, '^#{1,6}[ \\t]+.+') then 'heading' when starts_with(head, '|') then 'table' when regexp_matches(head, '^>\\s*\\[!\\w+\\]') then 'note' when starts_with(head, '>') then 'quotation'
  when regexp_matches(head, '^(?:§\\s*\\d|[Aa]rt\\.\\s*\\d)') then 'legal_transcription' when regexp_matches(head, '^\\[\\^[^\\]]+\\]:') then 'footnote' when regexp_matches(head, '^!\\[') then 'visual'
  when regexp_matches(head, '^(?:[-*+]\\s|\\d+[.)]\\s|\\(?[A-Za-z][.)]\\s)') then 'list_item' else 'paragraph' end"""


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents), e as (select *, trim(line, ' ') = '' as empty from l),
 o as (select *, not empty and (coalesce(lag(empty) over w, true) or regexp_matches(line, '^#{{1,6}}[ \\t]+.+|^[-*+]\\s|^<!-- PAGE page=') or coalesce(regexp_matches(lag(line) over w, '^#{{1,6}}[ \\t]+.+'), false)) as begins from e window w as (partition by doc_id order by pos)),
 b as (select *, sum(begins::int) over (partition by doc_id order by pos) as block from o), g as (select doc_id, block, min(pos) + 1 as line_start, max(pos) + 1 as line_end, min_by(line, pos) as head, string_agg(line, chr(10) order by pos) as body from b where not empty and trim(line, ' ') <> '---' group by doc_id, block)
 select doc_id, block::int as block, {KIND} as kind, line_start::int as line_start, line_end::int as line_end, md5(body) as text from g""")
def typed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.blocks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "block", "kind", "line_start", "line_end", F.md5("text").alias("text"))


@query()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1000).select("doc_id", "chunk", F.length("text").alias("chars"), F.md5("text").alias("text"))


@query()
def packed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk of each turn when turns are packed in order into 2000 characters."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    sizes = F.transform("turns", lambda t: t.n)
    return rows.select("conv_id", F.array_join(D.packed(sizes, 2000).cast("array<string>"), ",").alias("chunks"))


PAIRS = "pairs as (select d.doc_id as doc_id, d.text as x, b.text as r from documents d join benchmark b on b.item_id = d.doc_id % (select greatest(count(*), 1) from benchmark))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an extract, with one of all benchmark passages as its reference; passages are numbered from 0."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("r"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("x"), (F.col("doc_id") % max(items.count(), 1)).alias("item_id"))
    return rows.join(items, "item_id").select("doc_id", "r", "x")


@query(f"""with {PAIRS}, t as (select doc_id, regexp_extract_all(lower(r), '[\\p{{L}}\\p{{N}}]+') as r, regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+') as x from pairs),
 a as (select doc_id, t, count(*) as n from (select doc_id, unnest(r) as t from t) group by 1, 2), b as (select doc_id, t, count(*) as n from (select doc_id, unnest(x) as t from t) group by 1, 2),
 m as (select a.doc_id as doc_id, sum(least(a.n, b.n)) as matched from a join b on a.doc_id = b.doc_id and a.t = b.t group by 1)
 select t.doc_id as doc_id, len(r)::int as n_reference, case when len(r) >= 20 and len(x) > 0 then round(coalesce(matched, 0)::double / len(r), 4) end as recall from t left join m on m.doc_id = t.doc_id""")
def token_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.token_recall(pairs(spark, sf_dir), "doc_id", "r", "x").select("doc_id", "n_reference", "recall")


@query()
def fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.functions.text import tokens

    found = pairs(spark, sf_dir)
    order = found.select("doc_id", D.order_score(tokens(F.col("r")), tokens(F.col("x"))).alias("order_score"))
    rows = D.token_recall(found, "doc_id", "r", "x").join(order, "doc_id")
    return rows.select("doc_id", "recall", "order_score", D.fidelity(F.col("recall"), F.col("order_score"), F.col("suspicious")).alias("score"))


@query("with a as (select doc_id, text, split_part(text, ' ', 1) as a, split_part(text, ' ', 3) as b from documents) select doc_id, instr(substr(text, instr(text, a) + length(a)), b) > 0 as ordered, instr(text, b) > 0 and instr(substr(text, instr(text, b) + length(b)), a) > 0 as reversed from a")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", D.anchors_in_order(F.array(word(1), word(3)), F.col("text")).alias("ordered"), D.anchors_in_order(F.array(word(3), word(1)), F.col("text")).alias("reversed"))


@query("select p_partkey, case p_size % 5 when 0 then 'A,B,C' when 1 then '' when 2 then '' when 3 then 'A,B' else '' end as labels, case p_size % 5 when 1 then 'alternative_sequence_inconsistent' when 2 then 'multiple_alternative_sequences' when 4 then 'alternative_boundaries_uncertain' end as problem from part")
def question_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ("Which? (A) one (B) two (C) three", "Which? (A) one (B) two (D) four", "A) one B) two A) one B) two", "Of a) this b) that: (A) one (B) two", "No alternatives")
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("p_size") % 5 + 1).cast("int"))
    labels, problem = D.alternatives(text)
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.array_join(labels, ","), F.lit("")).alias("labels"), problem.alias("problem"))


@query("""with e as (select *, ascii(chr(65 + (event_id % 7)::int)) as letter, lag(ascii(chr(65 + (event_id % 7)::int))) over (partition by user_id order by event_id) as before from events),
 i as (select user_id, event_id, letter, sum(case when before is null or letter <> before + 1 then 1 else 0 end) over (partition by user_id order by event_id) as run from e)
 select user_id, run, count(*) as letters, min(event_id) as first_event, max(event_id) as last_event from i group by 1, 2 having count(*) >= 2""")
def letter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.col("event_id") % 7 + 65
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", letter.alias("letter"))
    breaks = F.col("letter") != F.lag("letter").over(Window.partitionBy("user_id").orderBy("event_id")) + 1
    return O.islands(rows, "user_id", "event_id", breaks, "run").groupBy("user_id", "run").agg(F.count("*").alias("letters"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")).where("letters >= 2")


@query("with n as (select o_custkey, o_orderkey, o_orderkey % 5 as number, lag(o_orderkey % 5) over w as before, lead(o_orderkey % 5) over w as after from orders window w as (partition by o_custkey order by o_orderkey)) select o_custkey, o_orderkey, number from n where before = number - 1 and after = number + 1")
def prose_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that stand between their neighbours are items of a list, not headings."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 5).alias("number"))
    rows = rows.withColumn("before", F.lag("number").over(w)).withColumn("after", F.lead("number").over(w))
    return rows.where("before = number - 1 and after = number + 1").select("o_custkey", "o_orderkey", "number")


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents), t as (select *, contains(line, '|') as is_row, lag(contains(line, '|')) over (partition by doc_id order by pos) as before from l), i as (select *, sum(case when before is distinct from is_row then 1 else 0 end) over (partition by doc_id order by pos) as run from t) select doc_id, run, count(*) as rows, max(len(string_split(line, '|')))::int as columns from i where is_row group by 1, 2")
def table_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("is_row", F.contains("line", F.lit("|")))
    breaks = ~F.col("is_row").eqNullSafe(F.lag("is_row").over(Window.partitionBy("doc_id").orderBy("pos")))
    found = O.islands(rows, "doc_id", "pos", breaks, "run").where("is_row")
    return found.groupBy("doc_id", "run").agg(F.count("*").alias("rows"), F.max(F.size(F.split("line", r"\|"))).alias("columns"))


@query("with t as (select distinct unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as word from conversations), v as (select distinct unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as word from documents) select word from t anti join v using (word)")
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.functions.text import tokens

    words = lambda name: table(spark, sf_dir, name).select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return words("conversations").join(words("documents"), "word", "left_anti")


@query("with m as (select user_id as doc_id, event_id % 50 as page, props as value from events), f as (select doc_id, value, count(distinct page) as n_pages from m group by 1, 2), p as (select doc_id, count(distinct page) as pages from m group by 1) select f.doc_id as doc_id, value, n_pages from f join p on p.doc_id = f.doc_id where n_pages >= 2 or pages = 1")
def repeated_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 50).alias("page"), F.col("props").alias("value"))
    return D.repeated_marks(rows, rows.groupBy("doc_id").agg(F.count_distinct("page").alias("pages")))


@query("select l_orderkey, case when count(distinct (l_partkey % 3 || '.' || l_linenumber)) >= 2 then 'course' else 'cases' end as profile from lineitem group by l_orderkey")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document with two different nested numbers in its headings is a course."""
    heading = F.concat(F.lit("## "), (F.col("l_partkey") % 3).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(". Title"))
    number = F.regexp_extract(heading, r"^#{1,6}\s+(?:\*\*)?(\d+\.\d+(?:\.\d+)*)\.?\s", 1)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(F.count_distinct(number) >= 2, "course").otherwise("cases").alias("profile"))


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber as number from lineitem")
def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    numeral = F.element_at(F.array(*map(F.lit, ("I", "ii", "III", "IV", "V", "vi", "VII"))), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", roman_value(numeral).alias("number"))


@query("select doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g'), ' ')) as canonical from documents")
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(canonical(F.col("text"))).alias("canonical"))


@query()
def visible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(visible(clean_styles(F.col("html")))).alias("visible"))


@query("select s.s_suppkey as s_suppkey, count(c.c_custkey) as inside from supplier s left join customer c on c.c_nationkey = s.s_nationkey and c.c_acctbal between s.s_acctbal - 1001 and s.s_acctbal + 1001 group by 1")
def points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in boxes with a tolerance of one: nations stand for pages, so that they are an equality of all that is dealt."""
    spans = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("page"), (F.col("s_acctbal") - 1001).alias("low"), (F.col("s_acctbal") + 1001).alias("high"))
    points = table(spark, sf_dir, "customer").where("c_custkey is not null").select(F.col("c_nationkey").alias("page"), F.col("c_acctbal").alias("value"))
    return counted_within(spans, points).select(F.col("id").alias("s_suppkey"), "inside")


@query("with j as (select d.source, l.doc_id, d.doc_id is not null and l.quality = 1 as ok from labels l left join documents d on d.doc_id = l.doc_id) select source, count(*) as entries, bool_and(ok) as accepted from j group by source")
def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review counts only if every entry of it names a block that is there, with its content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("entries"), F.bool_and(F.col("source").isNotNull() & (F.col("quality") == 1)).alias("accepted"))


@query("select n_nationkey, '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"parent\":' || n_regionkey || '}' as structure from nation")
def structure_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))).alias("structure"))


@query("select user_id, list_aggregate(list_distinct(list(event_id % 10)), 'count')::int as pages from events group by user_id")
def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x % 10)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.size(F.array_distinct(listed)).alias("pages"))


@query("select p_partkey, ((p_partkey * 7919) % 16777216)::int >> 16 as red, (((p_partkey * 7919) % 16777216)::int >> 8) & 255 as green, ((p_partkey * 7919) % 16777216)::int & 255 as blue from part")
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours written as # and six hexadecimal digits, read into their parts."""
    text = F.concat(F.lit("#"), F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0"))
    part = lambda at: F.conv(F.substring(text, at, 2), 16, 10).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", part(2).alias("red"), part(4).alias("green"), part(6).alias("blue"))
