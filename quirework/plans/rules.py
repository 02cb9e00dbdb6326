"""Queries on titles, numbers, sets and privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import rules as R
from quirework.operators import privacy as P
from quirework.plans.registry import query, table

TITLES = """titles as (select p_partkey, case p_partkey % 9 when 0 then '**DIREITO PENAL:**' when 1 then 'Direito Penal' when 2 then 'COMENTÁRIO' when 3 then 'Lei ' || p_partkey when 4 then 'LEITURA' when 5 then 'CÓDIGO  CIVIL'
  when 6 then 'EXECUÇÃO PENAL' when 7 then p_partkey || '. O prazo não corre' else '**' || p_name || ':** texto' end as title from part)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    kinds = [F.lit("**DIREITO PENAL:**"), F.lit("Direito Penal"), F.lit("COMENTÁRIO"), F.concat(F.lit("Lei "), key.cast("string")), F.lit("LEITURA"), F.lit("CÓDIGO  CIVIL"), F.lit("EXECUÇÃO PENAL"), F.concat(key.cast("string"), F.lit(". O prazo não corre")), F.concat(F.lit("**"), "p_name", F.lit(":** texto"))]
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*kinds), (key % 9 + 1).cast("int")).alias("title"))


@query(f"""with {TITLES} select p_partkey, case p_partkey % 9 when 0 then 1 when 6 then 1 when 3 then 3 when 5 then 3 else 2 end as level, p_partkey % 9 >= 7 as prose from titles""")
def heading_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by what a title says; numbered sentences and bold labels with words after them are prose."""
    return titles(spark, sf_dir).select("p_partkey", R.heading_level(F.col("title")).alias("level"), R.prose_heading(F.col("title")).alias("prose"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then '§ 4º-B e art. 9-A' when 1 then 'fim, ' || o_orderkey || '.' else 'Art. 2- b; x' end as text from orders""")
def legal_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = F.when(key % 3 == 0, "§ 4º- B e art. 9- A").when(key % 3 == 1, F.concat(F.lit("fim , "), key.cast("string"), F.lit("  ."))).otherwise("Art. 2- b ; x")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.legal_spacing(raw).alias("text"))


@query("select c_custkey, lower(regexp_replace(strip_accents(c_name || '-É.ã ' || c_mktsegment), '[^\\p{L}\\p{N}]+', '', 'g')) as value from customer")
def plain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", R.letters_and_digits(F.concat("c_name", F.lit("-É.ã "), "c_mktsegment")).alias("value"))


@query("select event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') as written, case when event_id % 3 > 0 then date_trunc('second', ts) end as \"read\" from events")
def utc_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times to the second as text, and read again; a text without its sign is none."""
    rows = table(spark, sf_dir, "events").withColumn("written", R.utc_text(F.col("ts")))
    text = F.when(F.col("event_id") % 3 == 0, F.replace("written", F.lit("Z"), F.lit(""))).otherwise(F.col("written"))
    return rows.select("event_id", "written", R.utc_time(text).cast("timestamp_ntz").alias("read"))


@query(f"""with r as (select l_orderkey, l_linenumber, l_partkey, case when l_linenumber = 7 then 'nan'::double when l_linenumber = 6 then 72.5::double else (l_quantity * 15)::double end as dpi, (l_partkey % 3000)::double as width, (l_suppkey % 3000 + 500)::double as height from lineitem)
 select l_orderkey, l_linenumber, l_partkey, case when isnan(dpi) or dpi <> floor(dpi) or dpi < {R.LEAST_DPI} or dpi > {R.MOST_DPI} then 'dpi' when width * dpi / 72 * (height * dpi / 72) > {R.MOST_PIXELS} then 'pixels' end as problem from r""")
def render_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    dpi = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).when(F.col("l_linenumber") == 6, 72.5).otherwise((F.col("l_quantity") * 15).cast("double"))
    problem = R.render_problem(dpi, (F.col("l_partkey") % 3000).cast("double"), (F.col("l_suppkey") % 3000 + 500).cast("double"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", problem.alias("problem"))


@query("select o_orderkey, o_orderkey % 4 = 0 as canonical from orders")
def canonical_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 64 bytes only the unpadded form with a last sign whose spare bits are zero counts."""
    data = F.unhex(F.sha2(F.col("o_orderkey").cast("string"), 512))
    right = F.translate(F.base64(data), "+/=\r\n", "-_")
    spare = F.translate(F.right(right, F.lit(1)), "AQgw", "BRhx")
    wrong = [right, F.concat(right, F.lit("==")), F.concat(F.left(right, F.lit(85)), spare), F.left(right, F.lit(85))]
    text = F.element_at(F.array(*wrong), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.canonical_signature(text).alias("canonical"))


@query("""with f as (select user_id, list_distinct(list(event_type)) as have from events group by 1)
 select user_id, array_to_string(list_sort(list_filter(['error', 'login', 'view'], lambda x: not list_contains(have, x))), ',') as missing, array_to_string(list_sort(list_filter(have, lambda x: x not in ('error', 'login', 'view'))), ',') as extra,
  array_to_string(list_sort(list_distinct(list_concat(have, ['export', 'view']))), ',') as capabilities from f""")
def field_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each set of fields lacks and has beyond the wanted one, and its union with others on registering again."""
    have = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    missing, extra = R.missing_and_extra(F.col("have"), F.array(*map(F.lit, ("view", "login", "error"))))
    union = F.array_sort(F.array_union("have", F.array(F.lit("view"), F.lit("export"))))
    return have.select("user_id", *(F.array_join(c, ",").alias(n) for c, n in ((missing, "missing"), (extra, "extra"), (union, "capabilities"))))


@query("select c_custkey, list_sort(string_split(c_name, '')) = list_sort(string_split(case when c_custkey % 2 = 0 then reverse(c_name) else c_name || 'x' end, '')) as same from customer")
def same_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("c_custkey") % 2 == 0, F.reverse("c_name")).otherwise(F.concat("c_name", F.lit("x")))
    return table(spark, sf_dir, "customer").select("c_custkey", R.same_characters(F.col("c_name"), other).alias("same"))


@query("select l_suppkey, array_to_string(list_sort(list_distinct(list(l_partkey)))[1:20], ',') as first, greatest(0, count(distinct l_partkey) - 20)::int as more from lineitem group by 1")
def first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty of a list and how many are left out of it."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("items"))
    first, more = R.first_and_rest(F.col("items"))
    return lists.select("l_suppkey", F.array_join(first.cast("array<string>"), ",").alias("first"), more.alias("more"))


@query("select o_orderkey, greatest(0, o_orderkey % 90 - 20)::int as first, greatest(greatest(0, o_orderkey % 90 - 20), least(o_custkey % 60, greatest(0, o_orderkey % 90 - 20) + 50))::int as past from orders")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, past = R.page_range((F.col("o_custkey") % 60).cast("int"), (F.col("o_orderkey") % 90 - 20).cast("int"), F.lit(50))
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("first"), past.alias("past"))


@query("select doc_id, case when doc_id % 3 = 0 then array_to_string(list_filter(string_split_regex(lower(source), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') when doc_id % 5 = 0 then lower(lang) else '' end as tokens from documents")
def reference_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the first of three texts that has any."""
    doc = F.col("doc_id")
    found = R.first_filled(F.when(doc % 3 == 0, F.col("source")).otherwise(" -- "), F.when(doc % 5 == 0, F.col("lang")), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, " ").alias("tokens"))


@query("select p_partkey, case p_partkey % 3 when 0 then '**' || p_name || '**' when 1 then '<mark><em>' || p_name || '</em></mark>' else p_name end as text from part")
def trimmed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (F.concat(F.lit(" ** "), "p_name", F.lit(" ** ")), F.concat(F.lit("<mark><em>  "), "p_name", F.lit(" </em></mark>\n")), F.concat(F.lit("\t"), "p_name", F.lit("  ")))
    kinds = (F.concat(F.lit("**  "), "p_name", F.lit(" **")), *kinds[1:])
    return table(spark, sf_dir, "part").select("p_partkey", R.edge_trimmed(F.element_at(F.array(*kinds), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("text"))


MARKS = """marks as (select l_orderkey as doc_id, l_linenumber as page, case l_partkey % 5 when 0 then 'cpf' when 1 then 'nome' when 2 then 'email' when 3 then 'telefone' else 'other' end as label, 'v' || (l_suppkey % 3) as value from lineitem)"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*map(F.lit, ("cpf", "nome", "email", "telefone", "other")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.element_at(labels, (F.col("l_partkey") % 5 + 1).cast("int")).alias("label"), F.concat(F.lit("v"), (F.col("l_suppkey") % 3).cast("string")).alias("value"))


@query(f"""with {MARKS}, n as (select doc_id, count(distinct page) as pages from marks group by 1), o as (select doc_id, value, count(distinct page) as on_pages from marks group by 1, 2),
 a as (select m.* from marks m join n using (doc_id) join o using (doc_id, value) where pages = 1 or on_pages >= 2),
 g as (select doc_id, count(*) filter (where label = 'cpf') as strong, count(*) filter (where label = 'nome') as names, count(*) filter (where label in ('email', 'telefone')) as contacts, count(*) as marks, count(distinct page) as pages from a group by 1)
 select doc_id, coalesce(strong > 0 or (names > 0 and contacts > 0), false) as identified, case when strong > 0 or (names > 0 and contacts > 0) then g.marks else 0 end as marks, case when strong > 0 or (names > 0 and contacts > 0) then g.pages else 0 end as pages from n left join g using (doc_id)""")
def identity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose repeated marks name a person, with how many marks on how many pages are protected."""
    return P.identity_statistics(marks(spark, sf_dir)).select("doc_id", "identified", "marks", "pages")


@query("select doc_id, n_chars % 90 < 40 and doc_id % 2 = 0 and doc_id % 3 = 0 as omitted from documents")
def omitted_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are nearly only an image are left out where the document names a person."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", P.omitted_visual(F.repeat(F.lit("x"), (F.col("n_chars") % 90).cast("int")), doc % 2 == 0, doc % 3 == 0).alias("omitted"))
