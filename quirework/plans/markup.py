"""Queries on marks of style and on the structure of course texts, over the texts of the tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import markup as M
from quirework.functions.text import INLINE
from quirework.operators import blocks as K
from quirework.operators import notes as N
from quirework.operators import passes as O
from quirework.operators import repair as R
from quirework.operators import separators as P
from quirework.operators import structure as S
from quirework.operators.folds import dealt, parts_for
from quirework.plans.registry import query, table
from quirework.session import shared_folder
from quirework.sources import versions as V

#: What a reader sees of html, in SQL without look-arounds: doubled marks leave a sign that no word has, marks within words are kept by name.
_KEPT = "regexp_replace({t}, '([\\p{{L}}\\p{{N}}_])\\*([\\p{{L}}\\p{{N}}_])', '\\1' || chr(1) || '\\2', 'g')"
_UNDER = "regexp_replace({t}, '([\\p{{L}}\\p{{N}}_])_([\\p{{L}}\\p{{N}}_])', '\\1' || chr(2) || '\\2', 'g')"
_SIGNS = "regexp_replace(regexp_replace(html, '<br\\s*/?>', chr(10), 'g'), '(?s)<!--.*?-->|</?(b|em|i|mark|strong|u|sub|sup)\\b[^>]*>|\\*\\*|__', chr(3), 'g')"
for _form in (_KEPT, _KEPT, _UNDER, _UNDER):
    _SIGNS = _form.format(t=_SIGNS)
PLAIN = f"translate(regexp_replace({_SIGNS}, '[*_' || chr(3) || ']', '', 'g'), chr(1) || chr(2), '*_')"
SQL_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


@query(rf"""with p as (select page_id, {PLAIN} as plain from pages), k as (select *, length(plain) // 2 as place from p)
 select page_id, place::int as place, regexp_replace(left(plain, place), '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g') as left_seen,
 regexp_replace(substr(plain, place + 1), '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g') as right_seen, true as balanced from k""")
def visible_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut in the middle of what is seen: both sides show it, and the left side closes as many tags as it opens."""
    tags = lambda c, slash: F.size(F.regexp_extract_all(F.col(c), F.lit(rf"<{slash}(?:{'|'.join(INLINE)})\b[^>]*>"), F.lit(0)))
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.floor(F.length(M.plain(F.col("html"))) / 2).cast("int").alias("place"))
    cut = pages.select("page_id", "place", M.split_visible(F.col("html"), F.col("place")).alias("s"))
    return cut.select("page_id", "place", M.visible(F.col("s.left")).alias("left_seen"), M.visible(F.col("s.right")).alias("right_seen"), (tags("s.left", "") == tags("s.left", "/")).alias("balanced"))


_MARKS = "string_split({x}, '{m}')"
_MOVED = """case when len({parts}) % 2 = 1 then array_to_string(list_transform({parts}, lambda p, k: case when k % 2 = 1 then p
 when trim(p, ' ') = '' then '{m}' || p || '{m}' else repeat(' ', length(p) - length(ltrim(p, ' '))) || '{m}' || trim(p, ' ') || '{m}' || repeat(' ', length(p) - length(rtrim(p, ' '))) end), '') else {x} end"""


def _moved(x: str, mark: str) -> str:
    return _MOVED.format(parts=_MARKS.format(x=x, m=mark), x=x, m=mark)


@query(f"""with l as (select doc_id, unnest(string_split(replace(text, chr(9), ' '), chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
 b as (select doc_id, k, {_moved('line', '**')} as line from l), u as (select doc_id, k, {_moved('line', '__')} as line from b)
 select doc_id, md5(string_agg(line, chr(10) order by k)) as text_md5 from u group by doc_id""")
def emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of marks moved to their words in all documents."""
    text = F.translate("text", "\t", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(M.repaired_emphasis(text).cast("binary")).alias("text_md5"))


LABELS = ("1.", "A.", "a)", "1.2.", "II.", "B.", "2.1.3.", "b)", "E.", "iv)", "A.1.", "**ATENÇÃO!**")
OTHERS = {5: "JULGADOS DO STF", 11: "TEMA 12", 17: "RECURSOS REPETITIVOS"}
#: (kind, depth) of each label, for SQL.
_KINDS = (("number", 1), ("capital", 0), ("small", 0), ("number", 2), ("roman", 0), ("capital", 0), ("number", 3), ("small", 0), ("capital", 0), ("roman", 0), ("compound", 1), ("note", 0))


def course_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, line): the sentences of each document as course text; which line is a heading of what label goes by its place."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "said"))
    said = F.concat(F.left(F.regexp_replace("said", "[^a-z ]", ""), F.lit(30)), F.lit("x"))
    form = F.pmod(F.col("doc_id") + F.col("pos"), F.lit(24))
    line = said
    for k, label in enumerate(LABELS):
        line = F.when(form == 2 * k, F.concat(F.lit(f"# {label} "), said, F.lit("."))).otherwise(line)
    for k, label in OTHERS.items():
        line = F.when(form == k, F.lit(label)).otherwise(line)
    return pieces.select("doc_id", "pos", line.alias("line"))


def texts_of(lines: DataFrame) -> DataFrame:
    """Lines as texts; a document's lines come from one row and go into one."""
    return lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("all")).select("doc_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("text"))


def keeper(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes texts and reads them again. They are dealt evenly, several parts a core: texts are small for the work that they make."""
    folder = shared_folder(spark, name)
    parts = 4 * spark.sparkContext.defaultParallelism

    def kept(df: DataFrame, step: str) -> DataFrame:
        df.repartition(parts).write.parquet(f"{folder}/{step}")
        return spark.read.parquet(f"{folder}/{step}")

    return kept


_KIND = " ".join(f"when {2 * k} then '{kind}'" for k, (kind, _) in enumerate(_KINDS)) + " when 5 then 'collection' when 11 then 'ruling' when 17 then 'part'"
_DEPTH = " ".join(f"when {2 * k} then {depth}" for k, (_, depth) in enumerate(_KINDS))
#: The stack of open headings as a list of (k, l); found is where the row's kind is open, 0 if it isn't.
WALK = f"""recursive said as (select doc_id, generate_subscripts(string_split(text, '. '), 1) - 1 as pos from documents),
 forms as (select doc_id, pos, (doc_id + pos) % 24 as form from said),
 marks as (select doc_id, row_number() over (partition by doc_id order by pos) as r, case form {_KIND} end as kind, coalesce(case form {_DEPTH} end, 0) as depth from forms where case form {_KIND} end is not null),
 walk(doc_id, r, stack, coll, ruling, level) as (
  select distinct doc_id, 0::bigint, []::struct(k varchar, l int)[], 2, 4, 0 from marks
  union all
  select doc_id, r, case kind when 'number' then [{{'k': 'number', 'l': least(depth + 1, 6)}}] when 'compound' then list_append(base, {{'k': 'compound', 'l': least(base[-1].l + depth, 6)}}) when 'capital' then base when 'small' then base when 'roman' then base else stack end,
   case kind when 'collection' then 3 else coll end, case kind when 'collection' then 4 when 'part' then coll + 2 else ruling end,
   case kind when 'number' then least(depth + 1, 6) when 'compound' then least(base[-1].l + depth, 6) when 'collection' then 3 when 'part' then coll + 1 when 'ruling' then least(ruling, 6) when 'note' then 0 else base[-1].l end
  from (select m.doc_id, m.r, m.kind, m.depth, w.stack, w.coll, w.ruling, case when found > 0 then stack[1:found] else list_append(stack, {{'k': own, 'l': least(coalesce(stack[-1].l, 1) + 1, 6)}}) end as base
   from (select *, coalesce(list_position(list_transform(stack, lambda s: s.k), own), 0) as found from (select w.*, m.kind, m.depth, case m.kind when 'compound' then 'capital' else m.kind end as own from walk w join marks m on m.doc_id = w.doc_id and m.r = w.r + 1)) w join marks m on m.doc_id = w.doc_id and m.r = w.r + 1)
 )"""


@query(f"with {WALK} select doc_id, coalesce(string_agg(level::varchar, '' order by r) filter (where level > 0), '') as levels, count(*) filter (where r > 0 and level = 0) as notes from walk group by doc_id")
def course_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of all headings of course texts in order, and the number of notes, after the structure pass."""
    # Kept, since the condition below would work out the texts anew.
    kept = keeper(spark, "structure")
    made = kept(S.structured(kept(texts_of(course_lines(spark, sf_dir)), "made")), "structured")
    lines = F.split("text", "\n")
    levels = F.transform(F.filter(lines, lambda x: x.rlike(r"^#{1,6} ")), lambda x: F.length(F.regexp_extract(x, "^(#+)", 1)).cast("string"))
    out = made.select("doc_id", F.array_join(levels, "").alias("levels"), F.size(F.filter(lines, lambda x: x == "> [!NOTE]")).cast("long").alias("notes"))
    return out.where("levels <> '' or notes > 0")


#: Forms of a question: alternatives in sequence on one line, a gap in the sequence, signs of lists before them, a heading; {q} is the label.
_FORMS = ("**{q}** said (A) one (B) two", "**{q}** said (A) one (C) two", "**{q}** said\n- (A) one\n- (B) two", "## {q} said\n(A) one\n\n(B) two")


@query("""with s as (select doc_id, generate_subscripts(string_split(text, '. '), 1) as k, unnest(string_split(text, '. ')) as said from documents),
 q as (select doc_id, k, k || '. (' || k || '/2024)' as label, left(regexp_replace(said, '[^a-z ]', '', 'g'), 20) || 'x' as said, k % 4 as form from s),
 b as (select doc_id, k, case when k = 1 or k % 4 = 3 then chr(10) else '' end || case form when 0 then '## ' || label || chr(10) || chr(10) || ltrim(said) || chr(10) || chr(10) || '(A) one' || chr(10) || chr(10) || '(B) two'
   when 1 then '## **' || label || '**' || chr(10) || chr(10) || ltrim(said) || chr(10) || chr(10) || '(A) one' || chr(10) || chr(10) || '(B) two'
   when 2 then '## **' || label || '**' || chr(10) || chr(10) || ltrim(said) || ' (A) one (C) two'
   else '## **' || label || '**' || chr(10) || chr(10) || ltrim(said) || chr(10) || chr(10) || '(A) one' || chr(10) || chr(10) || '(B) two' end as body from q),
 a as (select doc_id, '# QUESTÕES' || chr(10) || string_agg(body, chr(10) order by k) as asked, string_agg(chr(10) || '## **' || k || '. B**' || chr(10), chr(10) order by k) as given from b group by doc_id)
 select doc_id, md5(regexp_replace(asked || chr(10) || '# GABARITO' || chr(10) || given, '\n{3,}', chr(10) || chr(10), 'g')) as text_md5, true as settled from a""")
def exam_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exams of the documents' sentences with boundaries put right, and whether another pass leaves them."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.split("text", r"\. ").alias("said")).where("said is not null")

    def sentence(said: Column, pos: Column) -> Column:
        number = (pos + 1).cast("string")
        label = F.concat(number, F.lit(". ("), number, F.lit("/2024)"))
        short = F.concat(F.left(F.regexp_replace(said, "[^a-z ]", ""), F.lit(20)), F.lit("x"))
        form = F.get(F.array(*map(F.lit, _FORMS)), F.pmod(pos, F.lit(len(_FORMS))))
        asked = M.let(short, lambda s: F.replace(F.replace(form, F.lit("said"), s), F.lit("{q}"), label))
        return F.struct(pos.alias("pos"), asked.alias("asked"), F.concat(F.lit("**"), number, F.lit(". B**")).alias("given"))

    # Texts are short for the work that they make, so they are dealt over several parts a core, which stay that many.
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt(documents.select("doc_id", F.transform("said", sentence).alias("all")), parts, "doc_id")
    both = rows.groupBy("doc_id").agg(F.collect_list("all").alias("all")).select("doc_id", F.when(F.size("all") == 1, F.get("all", F.lit(0))).otherwise(F.array_sort(F.flatten("all"))).alias("all"))
    text = F.concat(F.lit("# QUESTÕES\n"), F.array_join(F.transform("all", lambda x: x["asked"]), "\n"), F.lit("\n# GABARITO\n"), F.array_join(F.transform("all", lambda x: x["given"]), "\n"))
    made = S.exam_boundaries(both.select("doc_id", text.alias("text")), settled="settled")
    return made.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "settled")


@query("""with t as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') as text from documents),
 d as (select doc_id, text, regexp_replace(regexp_replace(text, '([a-z]{3})([a-z]{3}) ', '\\1 \\2 ', 'g'), 'e ([b-d])', 'e\\1', 'g') as damaged, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) as letters from t)
 select doc_id, md5(case when letters < 20 then damaged else text end) as text_md5 from d""")
def repaired_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with spaces taken out and put into words, repaired by the texts that they were."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    damaged = F.regexp_replace(F.regexp_replace("text", "([a-z]{3})([a-z]{3}) ", "$1 $2 "), "e ([b-d])", "e$1")
    made = P.repaired_separators(texts.select("doc_id", "page", damaged.alias("text")), texts.select("doc_id", "page", F.array("text").alias("passages")))
    return made.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, said, first, second): sentences with a word of five at their ends, and a word of three that follows."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "said"))
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (F.col("pos") % by + 1).cast("int"))
    said = F.trim(F.regexp_replace("said", "[^a-z ]", ""))
    return pieces.select("doc_id", "pos", said.alias("said"), pick(("temaa", "temab", "temac", "temad", "temae"), 5).alias("first"), pick(("alfa", "beta", "gama"), 3).alias("second"))


@query("""with s as (select doc_id, generate_subscripts(string_split(text, '. '), 1) - 1 as pos, unnest(string_split(text, '. ')) as raw from documents),
 t as (select doc_id, pos, trim(regexp_replace(raw, '[^a-z ]', '', 'g'), ' ') as said, 'tema' || substr('abcde', (pos % 5)::int + 1, 1) as first, ['alfa', 'beta', 'gama'][pos % 3 + 1] as second from s),
 e as (select distinct doc_id, first, second from t where pos % 2 = 0 union select doc_id, 'fim', w from (select doc_id, lead(regexp_extract(said || ' ' || first, '^ *([a-z]+)', 1)) over (partition by doc_id order by pos) as w from t where pos % 2 = 0) where w is not null),
 j as (select t.*, e.doc_id is not null as joined from t left join e using (doc_id, first, second))
 select doc_id, count(*) filter (where joined)::int as n_joined, md5(string_agg(case when joined then said || ' ' || first || ' **' || second || '.**' else said || ' ' || first || chr(10) || chr(10) || '**' || second || '.**' end, chr(10) || chr(10) order by pos)) as text_md5 from j group by doc_id""")
def sentence_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last words of sentences as paragraphs of their own, joined where the lines of every second sentence prove it."""
    rows = tail_lines(spark, sf_dir)
    paragraph = F.concat("said", F.lit(" "), "first", F.lit("\n\n**"), "second", F.lit(".**"))
    texts = texts_of(rows.select("doc_id", "pos", F.concat(paragraph, F.lit("\n")).alias("line")))
    texts = texts.select("doc_id", F.regexp_replace("text", r"\n$", "").alias("text"))
    pair = F.array(F.struct((F.col("pos") * 2).alias("pos"), F.concat("said", F.lit(" "), "first").alias("line")), F.struct((F.col("pos") * 2 + 1).alias("pos"), F.concat("second", F.lit(" fim")).alias("line")))
    lines = rows.where("pos % 2 = 0").select("doc_id", F.explode(pair).alias("l")).select("doc_id", "l.*")
    made = R.joined_tails(texts, R.adjacencies(lines))
    return made.select("doc_id", "n_joined", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""with s as (select doc_id, generate_subscripts(string_split(text, '. '), 1) - 1 as pos, unnest(string_split(text, '. ')) as raw from documents),
 t as (select doc_id, pos, pos || '. ' || left(regexp_replace(raw, '[^a-z ]', '', 'g'), 20) || 'x' as head, substr('ABC', (pos % 3)::int + 1, 1) || '. Nome ' || pos % 4 as suffix from s),
 k as (select distinct doc_id, suffix from t where pos % 5 < 2)
 select doc_id, md5(string_agg('## ' || case when k.suffix is null then head || ' ' || t.suffix else head || chr(10) || chr(10) || '## ' || t.suffix end, chr(10) order by pos)) as text_md5 from t left join k using (doc_id, suffix) group by doc_id""")
def split_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that end in another one, where the source has that as a heading."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "said"))
    suffix = F.concat(F.substring(F.lit("ABC"), F.col("pos") % 3 + 1, F.lit(1)), F.lit(". Nome "), (F.col("pos") % 4).cast("string"))
    head = F.concat(F.col("pos").cast("string"), F.lit(". "), F.left(F.regexp_replace("said", "[^a-z ]", ""), F.lit(20)), F.lit("x"))
    rows = pieces.select("doc_id", "pos", suffix.alias("suffix"), F.concat(F.lit("## "), head, F.lit(" "), suffix).alias("line"))
    made = S.split_headings(texts_of(rows.select("doc_id", "pos", "line")), rows.where("pos % 5 < 2").select("doc_id", "suffix"))
    return made.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""with recursive l as (select l_orderkey as doc_id, l_linenumber as page, l_partkey % 5 as box, 50 + l_suppkey % 2 * 10 as x0, case when l_linenumber = 1 then 700 else 90 end as y0, case when l_partkey % 3 = 0 then 600 else 780 end as y1, case when l_linenumber = 1 or l_partkey % 7 = 0 then 'NOTA: ' else '' end || l_partkey as content from (select l_orderkey, l_linenumber, max(l_partkey) as l_partkey, max(l_suppkey) as l_suppkey from lineitem group by 1, 2)),
 edges as (select doc_id, page, max(y1) + l_more as last_line from (select *, case when page % 5 = 4 then 9 else 0 end as l_more from l) group by doc_id, page, l_more),
 walk(doc_id, start, note_box, page, x0, y1, content) as (
  select doc_id, page, box, page, x0, y1, content from l where starts_with(content, 'NOTA')
  union all
  select w.doc_id, w.start, w.note_box, n.page, n.x0, n.y1, w.content || ' ' || n.content from walk w join l n on n.doc_id = w.doc_id and n.page = w.page + 1 join edges e on e.doc_id = w.doc_id and e.page = w.page
   where w.y1 >= 680 and e.last_line <= w.y1 + 2 and n.y0 <= 144 and not starts_with(n.content, 'NOTA') and n.x0 = w.x0)
 select doc_id, start as page, note_box, max(page) as last_page, max_by(content, page) as content from walk group by all""")
def note_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes in boxes made of the lines of orders, one box a page; those that end high or above a line go no further."""
    lines = table(spark, sf_dir, "lineitem")
    parts = parts_for(spark, lines.count())
    items = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), parts, "l_orderkey")
    items = items.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
    page, part = F.col("l_linenumber").cast("int"), F.col("l_partkey")
    content = F.concat(F.when((page == 1) | (part % 7 == 0), "NOTA: ").otherwise(""), part.cast("string"))
    x0, y1 = (50 + F.col("l_suppkey") % 2 * 10).cast("double"), F.when(part % 3 == 0, 600.0).otherwise(780.0)
    boxes = items.select(F.col("l_orderkey").alias("doc_id"), page.alias("page"), (part % 5).cast("int").alias("box"), x0.alias("x0"), F.when(page == 1, 700.0).otherwise(90.0).alias("y0"), (x0 + 400).alias("x1"), y1.alias("y1"), F.lit(800.0).alias("height"), content.alias("content"))
    lines = boxes.select("doc_id", "page", (F.col("y1") + F.when(F.col("page") % 5 == 4, 9).otherwise(0)).alias("y"))
    return N.note_boxes(boxes, lines, parts=parts).select("doc_id", "page", "note_box", "last_page", "content")


#: Sentences on a page of the texts with notes.
PAGE_SENTENCES = 12


@query(f"""with s as (select doc_id, generate_subscripts(string_split(text, '. '), 1) - 1 as pos, unnest(string_split(text, '. ')) as raw from documents),
 t as (select doc_id, pos, left(regexp_replace(raw, '[^a-z ]', '', 'g'), 20) || 'x' as said from s),
 p as (select doc_id, pos, case when pos % {PAGE_SENTENCES} = 0 then '<!-- PAGE page=' || (pos // {PAGE_SENTENCES} + 1) || ' status=native -->' || chr(10) || chr(10) else '' end ||
  case when pos % 6 = 0 then '> [!NOTE]' || chr(10) || '> **ATENÇÃO!** ' || said || chr(10) || '>' || chr(10) || '> resto ' || pos when pos % 3 = 0 then '**ATENÇÃO!** ' || said || chr(10) || chr(10) || 'resto ' || pos else said end as part, pos % 6 = 0 as boxed from t)
 select doc_id, count(*) filter (where boxed)::int as n_grouped, md5(string_agg(part, chr(10) || chr(10) order by pos)) as text_md5 from p group by doc_id""")
def grouped_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of documents' sentences on pages; the source has boxes for every second of them, and others with more words."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "said"))
    said = F.concat(F.left(F.regexp_replace("said", "[^a-z ]", ""), F.lit(20)), F.lit("x"))
    page = (F.floor(F.col("pos") / PAGE_SENTENCES) + 1).cast("int")
    rest = F.concat(F.lit("resto "), F.col("pos").cast("string"))
    marker = F.when(F.col("pos") % PAGE_SENTENCES == 0, F.concat(F.lit("<!-- PAGE page="), page.cast("string"), F.lit(" status=native -->\n\n"))).otherwise("")
    line = F.concat(marker, F.when(F.col("pos") % 3 == 0, F.concat(F.lit("**ATENÇÃO!** "), said, F.lit("\n\n"), rest)).otherwise(said), F.lit("\n"))
    texts = texts_of(pieces.select("doc_id", "pos", line.alias("line"))).select("doc_id", F.regexp_replace("text", r"\n$", "").alias("text"))
    content = F.concat(F.lit("Atenção! "), said, F.lit(" "), rest, F.when(F.col("pos") % 6 == 0, "").otherwise(" fim"))
    notes = pieces.where("pos % 3 = 0").select("doc_id", page.alias("page"), page.alias("last_page"), content.alias("content"))
    made = N.grouped_notes(texts, notes)
    return made.select("doc_id", "n_grouped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("select 'customer/' || c_custkey || '.md' as name, strlen(c_name || chr(10) || c_mktsegment) as size, sha256(c_name || chr(10) || c_mktsegment) as sha256 from customer")
def versioned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer, written over an earlier version of the set and read from its list."""
    root = shared_folder(spark, "versions")
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("name"), F.concat("c_name", F.lit("\n"), "c_mktsegment").alias("content"))
    V.write_version(customers.limit(0), root)
    V.write_version(customers, root)
    return V.current_version(spark, root).select("name", "size", "sha256")


@query(f"with {WALK} select doc_id, coalesce(string_agg(level::varchar, '' order by r) filter (where level > 0), '') as levels, count(*) filter (where r > 0 and level = 0) as notes from walk group by doc_id")
def prepared_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course texts after all passes that need no evidence, in their checked order; levels and notes as the structure pass alone gives them."""
    kept = keeper(spark, "courses")
    made = kept(O.applied(kept(texts_of(course_lines(spark, sf_dir)), "made"), O.course_passes(), kept=kept), "passed")
    lines = F.split("text", "\n")
    levels = F.transform(F.filter(lines, lambda x: x.rlike(r"^#{1,6} ")), lambda x: F.length(F.regexp_extract(x, "^(#+)", 1)).cast("string"))
    out = made.select("doc_id", F.array_join(levels, "").alias("levels"), F.size(F.filter(lines, lambda x: x == "> [!NOTE]")).cast("long").alias("notes"))
    return out.where("levels <> '' or notes > 0")


#: Lines of a sentence by its form, and the kind of the block that they are; {s} is the sentence.
BLOCK_FORMS = (("## {s}", "heading"), ("{s}\n{s}", "paragraph"), ("```\n{s}\n\n# {s}\n```", "code"), ("| {s} |", "table"), ("> {s}\n> {s}", "quotation"), ("- {s}", "list_item"), ("**{s}**", "paragraph"), ("[^1]: {s}", "footnote"))
#: Lines of a sentence on average, with the empty one after it.
LINES_OF_SENTENCE = 3
_FORM_CASES = " ".join("when {} then {}".format(k, " || ".join(f"'{part}'" if part != "{s}" else "s" for part in re.split(r"(\{s\})", form) if part).replace("\n", "' || chr(10) || '")) for k, (form, _) in enumerate(BLOCK_FORMS))
_KIND_CASES = " ".join(f"when {k} then '{kind}'" for k, (_, kind) in enumerate(BLOCK_FORMS))


@query(f"""with t as (select doc_id, generate_subscripts(string_split(text, '. '), 1) - 1 as pos, unnest(string_split(text, '. ')) as raw from documents),
 f as (select doc_id, pos, (doc_id + pos) % 8 as form, left(regexp_replace(raw, '[^a-z ]', '', 'g'), 12) || 'x' as s from t),
 r as (select doc_id, pos, form, s, case form {_FORM_CASES} end as raw from f),
 l as (select *, len(string_split(raw, chr(10))) as n, sum(len(string_split(raw, chr(10))) + 1) over (partition by doc_id order by pos) as upto from r),
 h as (select *, max(case when form = 0 then pos end) over (partition by doc_id order by pos) as section from l),
 b as (select *, row_number() over (partition by doc_id order by pos)::int as block, case form {_KIND_CASES} end as kind, (upto - n)::int as line_start, (upto - 1)::int as line_end, trim(case form when 6 then s else raw end, ' ' || chr(10)) as seen from h),
 k as (select *, coalesce('section-' || section, 'None') || chr(31) || kind || chr(31) || seen as key from b)
 select doc_id, block, kind, line_start, line_end, case when form = 0 then 'section-' || pos else 'block-' || left(sha256(key || chr(31) || row_number() over (partition by doc_id, key order by block)), 20) end as id, case when form = 0 then null else 'section-' || section end as parent_id, form = 6 as ambiguous from k""")
def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the documents' sentences in eight forms, code with empty lines and headings in it among them."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.split("text", r"\. ").alias("said"))
    sentences = documents.agg(F.sum(F.size("said"))).first()[0] or 0
    parts = parts_for(spark, sentences * LINES_OF_SENTENCE)
    form = lambda pos: F.pmod(F.col("doc_id") + pos, F.lit(len(BLOCK_FORMS)))

    def raw(said: Column, pos: Column) -> Column:
        short = F.concat(F.left(F.regexp_replace(said, "[^a-z ]", ""), F.lit(12)), F.lit("x"))
        return M.let(short, lambda s: F.replace(F.get(F.array(*(F.lit(shape) for shape, _ in BLOCK_FORMS)), form(pos).cast("int")), F.lit("{s}"), s))

    texts = documents.select("doc_id", F.array_join(F.transform("said", raw), "\n\n").alias("text"))
    # Lines of a form, with the empty one after it.
    lines = F.get(F.array(*(F.lit(shape.count("\n") + 2) for shape, _ in BLOCK_FORMS)), form(F.col("pos")).cast("int"))
    places = dealt(documents.select("doc_id", F.posexplode("said").alias("pos", "said")).select("doc_id", "pos", lines.alias("lines")), parts, "doc_id")
    upto = F.sum("lines").over(Window.partitionBy("doc_id").orderBy("pos"))
    heads = places.withColumn("upto", upto).where(form(F.col("pos")) == 0)
    sections = heads.select("doc_id", (F.col("upto") - 1).cast("int").alias("line"), F.concat(F.lit("section-"), F.col("pos").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"))
    none = lambda kinds: spark.createDataFrame([], kinds)
    made = K.document_blocks(texts, sections, none("doc_id long, line_start int, line_end int, section_id string"), none("doc_id long, line_start int, line_end int, id string, label string, question_id string"), none("doc_id long, line_start int, line_end int, section_id string, number int"), parts=parts)
    return made.select("doc_id", "block", "kind", "line_start", "line_end", "id", "parent_id", F.col("ambiguity").isNotNull().alias("ambiguous"))


@query("""with t as (select doc_id, generate_subscripts(string_split(text, '. '), 1) - 1 as pos, unnest(string_split(text, '. ')) as raw from documents),
 l as (select *, upper(left(regexp_replace(raw, '[^a-z ]', '', 'g'), 30)) || 'X' || case when pos % 5 = 0 then ':' else '' end as said, pos % 7 as size, pos % 2 as font from t),
 s as (select doc_id, size, font from l where pos % 3 = 1 group by all having count(*) >= 2)
 select doc_id, array_to_string(list_sort(list_distinct(list(trim(said, ' ')))), '|') as titles from l semi join s using (doc_id, size, font) where pos % 3 = 0 and pos % 5 > 0 group by doc_id""")
def set_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles among the documents' sentences, whose styles go by their places; every third sentence is a numbered label."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "raw"))
    said = F.concat(F.upper(F.left(F.regexp_replace("raw", "[^a-z ]", ""), F.lit(30))), F.lit("X"), F.when(F.col("pos") % 5 == 0, ":").otherwise(""))
    label = F.when(F.col("pos") % 3 == 1, F.concat(F.col("pos").cast("string"), F.lit(". x")))
    lines = pieces.select("doc_id", F.when(F.col("pos") % 3 == 1, F.lit("x")).otherwise(said).alias("text"), label.alias("label"), (F.col("pos") % 3 == 0).alias("bold"), (F.col("pos") % 7).cast("double").alias("size"), (F.col("pos") % 2).cast("string").alias("font"))
    return S.set_titles(lines).select("doc_id", F.array_join("titles", "|").alias("titles"))
