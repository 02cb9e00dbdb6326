"""Queries on operations. Events stand for page conversions, log lines, service calls and audit events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import duration, sanitised, size
from quirework.operators import telemetry as T
from quirework.operators.folds import dealt, parts_for
from quirework.plans.registry import query, table

PAGES = """pages_done as (select user_id, value / 1000 as seconds, case event_type when 'view' then 'native' when 'click' then 'ocr' when 'purchase' then 'fallback' when 'error' then 'failed' else 'empty' end as status,
  case when event_id % 11 <> 0 then least(value / 500, 1) end as score, case when event_type = 'error' then 'check the page' else '' end as warning, case when event_id % 3 < 2 then event_id % 3 = 0 end as cache_hit, (event_id % 2000) * 1048576 as rss from events)"""


def pages_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "native").when(kind == "click", "ocr").when(kind == "purchase", "fallback").when(kind == "error", "failed").otherwise("empty")
    return table(spark, sf_dir, "events").select(
        "user_id",
        (F.col("value") / 1000).alias("seconds"),
        status.alias("status"),
        F.when(F.col("event_id") % 11 != 0, F.least(F.col("value") / 500, F.lit(1.0))).alias("score"),
        F.when(kind == "error", "check the page").otherwise("").alias("warning"),
        F.when(F.col("event_id") % 3 < 2, F.col("event_id") % 3 == 0).alias("cache_hit"),
        ((F.col("event_id") % 2000) * 1048576).alias("rss"),
    )


def _summary_sql(group: str) -> str:
    head, tail = (f"{group}, ", f"group by {group}") if group else ("", "")
    counts = ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in T.STATUSES)
    return f"""with {PAGES} select {head}count(*) as pages, round(sum(greatest(seconds, 0)), 3) as seconds, case when sum(greatest(seconds, 0)) > 0.001 then round(count(*) / sum(greatest(seconds, 0)), 2) else 0 end as pages_per_second, {counts},
  round(avg(score), 4) as mean_score, count(*) filter (where score < 0.85) as low_scores, count(*) filter (where warning <> '') as warnings, coalesce(round(count(*) filter (where cache_hit)::double / nullif(count(cache_hit), 0), 3), 0) as hit_ratio, round(max(rss) / 1048576.0::double, 2) as peak_mb from pages_done {tail}"""


@query(_summary_sql(""))
def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.conversion_summary(pages_done(spark, sf_dir))


@query(_summary_sql("user_id"))
def telemetry_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.conversion_summary(pages_done(spark, sf_dir), "user_id")


LINES = "log_lines as (select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || (case when event_type = 'error' then ' ERROR ' when event_type = 'view' then ' WARNING ' else ' INFO ' end) || ['pdf conversion failed', 'memory budget reached', 'ocr: onnx missing', 'disco: acesso negado', 'sqlite database locked', 'senha=abc, token: xyz in /home/app/log'][event_id % 6 + 1] as line from events)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", " ERROR ").when(F.col("event_type") == "view", " WARNING ").otherwise(" INFO ")
    texts = ("pdf conversion failed", "memory budget reached", "ocr: onnx missing", "disco: acesso negado", "sqlite database locked", "senha=abc, token: xyz in /home/app/log")
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, text).alias("line"))


@query(f"with {LINES}, t as (select line from log_lines where contains(line, ' ERROR ') or contains(line, ' CRITICAL ') or contains(line, ' WARNING ')) select " + ", ".join(f"count(*) filter (where regexp_matches(line, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(words)})($|[^\\p{{L}}\\p{{N}}_])')) as {name}" for name, words in T.LOG_CLASSES.items()) + " from t")
def log_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.log_classes(log_lines(spark, sf_dir), "line")


@query(f"with {LINES} select event_id, regexp_replace(regexp_replace(replace(line, '/home/app', '%USERPROFILE%'), '(?i)\\b(password|senha|token|license[_ -]?key|chave)\\b(\\s*[=:]\\s*)([^\\s,;]+)', '\\1\\2[REDACTED]', 'g'), '(?i)\\b([A-Z]{{2,5}})(-[A-Z0-9]{{4}}){{4}}\\b', '\\1-[REDACTED]', 'g') as line from log_lines")
def log_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir).select("event_id", sanitised(F.col("line")).alias("line"))


CLOCK = "ts - to_minutes(case when event_id % 17 = 0 then event_id % 13 else 0 end::int)"


@query(f"with c as (select event_id, user_id, {CLOCK} as local from events), h as (select *, max(local) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as highest from c) select event_id, user_id, coalesce(local < highest - interval 5 minutes, false) as tampered, greatest(local, highest) as effective from h")
def clock_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.when(F.col("event_id") % 17 == 0, F.col("event_id") % 13).otherwise(0).cast("int")
    rows = table(spark, sf_dir, "events").withColumn("local", F.col("ts") - F.make_dt_interval(mins=back))
    return T.clock_check(rows, "user_id", "event_id", "local").select("event_id", "user_id", "tampered", "effective")


FIELDS = ["event_id", "event_type", "props"]


@query("""with recursive e as (select *, row_number() over (partition by user_id order by event_id) as n from events),
 c as (select user_id, n, event_id, '' as previous_hash, sha256('' || chr(31) || event_id || chr(31) || event_type || chr(31) || props) as event_hash from e where n = 1
   union all select e.user_id, e.n, e.event_id, c.event_hash, sha256(c.event_hash || chr(31) || e.event_id || chr(31) || e.event_type || chr(31) || e.props) from c join e on e.user_id = c.user_id and e.n = c.n + 1)
 select user_id, event_id, previous_hash, event_hash from c""")
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.append_chain(table(spark, sf_dir, "events"), "user_id", "event_id", FIELDS).select("user_id", "event_id", "previous_hash", "event_hash")


@query("select user_id, count(*) as events, 0::bigint as broken from events group by user_id")
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = T.append_chain(table(spark, sf_dir, "events"), "user_id", "event_id", FIELDS)
    return T.verify_chain(chain, "user_id", "event_id", FIELDS).groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(~F.col("valid")).alias("broken"))


@query()
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    return T.breaker(calls, "user_id", "event_id", "ts", "ok")


@query("select user_id, count(*) filter (where event_type <> 'error') as done, count(*) filter (where event_type = 'error') as failed, array_to_string(list_sort(list_distinct(list(case when event_type = 'error' then lpad(event_id::varchar, 9, '0') end)))[1:10], ', ') as first_failures from events group by user_id")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.lpad(F.col("event_id").cast("string"), 9, "0").alias("name"), (F.col("event_type") != "error").alias("ok"))
    return T.batch_report(rows, "user_id")


@query("select user_id, round_even(100.0::double * count(*) filter (where event_type <> 'error') / count(*), 0)::int as percent, min(event_id % 50) as page, bool_and(event_type <> 'error') as all_done from events group by user_id")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.col("event_type") != "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(T.percent(done, F.count("*")).alias("percent"), F.min(F.col("event_id") % 50).alias("page"), F.bool_and(F.col("event_type") != "error").alias("all_done"))


@query("select event_id, case when round_even(value, 0) < 60 then round_even(value, 0)::bigint || 's' else (round_even(value, 0)::bigint // 60) || 'm ' || (round_even(value, 0)::bigint % 60) || 's' end as took from events")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", duration(F.col("value")).alias("took"))


@query("select doc_id, case when n_chars * 1000 >= 1073741824 then printf('%.1f GB', n_chars * 1000 / 1073741824::double) when n_chars * 1000 >= 1048576 then printf('%.1f MB', n_chars * 1000 / 1048576::double) when n_chars * 1000 >= 1024 then printf('%.1f KB', n_chars * 1000 / 1024::double) else (n_chars * 1000) || ' B' end as size from documents")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", size(F.col("n_chars") * 1000).alias("size"))


@query("select o_orderkey, greatest(1, least(o_orderkey % 9, 4, o_custkey % 6 + 1, floor(o_totalprice * 20000 / 1073741824)))::int as workers from orders")
def worker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.workers(F.col("o_orderkey") % 9, F.col("o_custkey") % 6 + 1, F.col("o_totalprice") * 20000).alias("workers"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([case when l_partkey > 1000 then 'pages' end, case when l_extendedprice * 10000 > 536870912 then 'bytes' end, case when l_quantity * 40 > 1800 then 'seconds' end], lambda x: x is not null), ',') as exceeded from lineitem")
def resource_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("size", F.col("l_extendedprice") * 10000).withColumn("took", F.col("l_quantity") * 40)
    return T.over_limits(rows, {"pages": "l_partkey", "bytes": "size", "seconds": "took"}).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("exceeded", ",").alias("exceeded"))


@query("select user_id, max(ts) as newest, max(case when event_type <> 'error' then ts end) as trusted, count(*) filter (where event_type = 'error') as corrupt from events group by user_id")
def time_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of redundant copies the newest valid one; corrupt copies are counted and passed over."""
    fine = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("newest"), F.max(F.when(fine, F.col("ts"))).alias("trusted"), F.count_if(~fine).alias("corrupt"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k, props is null or not json_valid(props) as broken from events")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal records; a broken one gives nulls instead of an error."""
    parsed = F.from_json("props", "k int", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_id", parsed.k.alias("k"), F.get_json_object("props", "$").isNull().alias("broken"))


PAGES = "pages_read as (select o_custkey as batch, l_orderkey as name, l_linenumber as page, bool_or(l_partkey % 4 = 0) as failed, bool_or(l_suppkey % 7 = 0) as review, max(l_partkey) as part from lineitem join orders on o_orderkey = l_orderkey group by all)"


def pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of orders as pages of documents, orders being documents and customers batches."""
    lines = table(spark, sf_dir, "lineitem")
    items = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), parts_for(spark, lines.count()), "l_orderkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("batch")).hint("merge"), "l_orderkey")
    status = F.when(F.col("l_partkey") % 4 == 0, "failed").otherwise("native")
    return items.select("batch", F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("page"), status.alias("status"), (F.col("l_suppkey") % 7 == 0).alias("review"), "l_partkey")


@query(f"""with {PAGES}, d as (select batch, name, count(*) filter (where failed) as failed, count(*) filter (where review) as review from pages_read group by all)
 select batch, count(*) filter (where failed > 0) as problem_documents, sum(failed)::bigint as problem_pages, count(*) filter (where review > 0) as review_documents, sum(review)::bigint as review_pages from d group by batch""")
def page_problem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.page_problem_counts(pages_read(spark, sf_dir))


@query(f"""with {PAGES} select name, page, case when failed and page % 2 = 1 and part % 3 > 0 then 'ocr' when failed then 'failed' else 'native' end as status, case when failed and page % 2 = 1 and part % 3 > 0 then 'again ' || part else 'first ' || part end as text, case when failed and page % 2 = 1 and part % 3 > 0 then 2 else 1 end as attempt from pages_read""")
def retried_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed pages of odd numbers read again, of which a third fails again; pages that nobody selected were read again too."""
    pages = pages_read(spark, sf_dir).groupBy("name", "page").agg(F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("native").alias("status"), F.max("l_partkey").alias("part"))
    first = pages.select("name", "page", "status", F.concat(F.lit("first "), F.col("part").cast("string")).alias("text"))
    again = pages.select("name", "page", F.when(F.col("part") % 3 == 0, "failed").otherwise("ocr").alias("status"), F.concat(F.lit("again "), F.col("part").cast("string")).alias("text"))
    return T.retried_pages(first, pages.where("status = 'failed' and page % 2 = 1"), again)
