"""Queries on writes to licences, users and terms, and on journals, caches, calls and clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import fingerprint
from quirework.operators import lifecycle as C
from quirework.operators import telemetry as T
from quirework.operators.folds import dealt, parts_for
from quirework.plans.licences import LICENCES, licences
from quirework.plans.registry import query, table

PRINT = lambda k: "upper(" + " || '-' || ".join(f"substr(sha256(({k})::varchar), {p}, 4)" for p in (1, 5, 9, 13)) + ")"


def one_of(key: Column, *values: object) -> Column:
    """The value whose place the key gives, modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


@query(f"""with r as (select o_orderkey as request_id, case when o_orderkey % 11 = 0 then -1 else o_custkey end as customer_id, [3, 6, 12, 5][o_orderkey % 4 + 1] as term_months, case when o_orderkey % 7 = 0 then 'X' else {PRINT('o_orderkey')} end as machine_id,
  o_orderdate as day, case when o_orderkey % 2 = 0 then ' ref ' else ' ' end as reference from orders),
 p as (select *, case when term_months = 5 then 'term' when machine_id = 'X' then 'machine' when customer_id not in (select c_custkey from customer) then 'customer' end as problem, year(day) as y from r),
 n as (select *, row_number() over (partition by y, problem is null order by day, request_id) as place from p),
 l as (select 1992 + n_nationkey % 5 as y, max(n_nationkey) as last from nation group by 1),
 i as (select n.*, case when problem is null then 'LIC-' || n.y || '-' || lpad((coalesce(last, 0) + place)::varchar, 6, '0') end as license_id from n left join l on l.y = n.y)
 select request_id, problem, license_id, customer_id, machine_id, (day + to_months(term_months))::date as expires_at, term_months, case when problem is null then 1 end as current_revision, case when problem is null then upper(coalesce(nullif(trim(reference), ''), license_id)) end as customer_reference from i""")
def licence_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    requests = table(spark, sf_dir, "orders").select(
        key.alias("request_id"), F.when(key % 11 == 0, -1).otherwise(F.col("o_custkey")).alias("customer_id"), one_of(key, 3, 6, 12, 5).alias("term_months"),
        F.when(key % 7 == 0, "x").otherwise(F.lower(fingerprint(key.cast("string")))).alias("machine_id"), F.col("o_orderdate").alias("at"), F.when(key % 2 == 0, " ref ").otherwise(" ").alias("reference"),
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    known = table(spark, sf_dir, "nation").select(F.format_string("LIC-%d-%06d", (F.col("n_nationkey") % 5 + 1992).cast("int"), F.col("n_nationkey").cast("int")).alias("license_id"))
    return C.issued(requests, customers, known).drop("issued_at")


OPERATIONS = f"""{LICENCES}, o as (select 'LIC-' || lpad(o_orderkey::varchar, 8, '0') as license_id, o_orderkey as k, o_orderdate as d, unnest(case when o_orderkey % 5 = 0 then [1, 2] else [1] end) as seq from orders),
 j as (select o.*, l.machine_id as m0, l.expires_at::date as e0, l.current_revision as r0, ['renew', 'replace', 'export'][k % 3 + 1] as operation, [3, 5][k % 2 + 1] as term, {PRINT('k + 1')} as m1 from o left join licences l on l.license_id = o.license_id),
 p as (select *, case when r0 is null then 'unknown' when seq > 1 then 'later' when operation = 'renew' and term = 5 then 'term' when operation = 'replace' and k % 4 >= 2 then 'confirmation' end as problem from j),
 done as (select license_id, seq, operation, problem, (case when problem is null and operation <> 'export' then r0 + 1 else r0 end)::int as revision, case when problem is null and operation = 'replace' then m1 else m0 end as machine_id,
   case when problem is null and operation = 'renew' then (greatest((d + interval 400 day)::date, e0) + to_months(term))::date else e0 end as expires_at from p)"""


def operations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    own = F.concat(F.lit("LIC-"), F.lpad(key.cast("string"), 8, "0"))
    rows = table(spark, sf_dir, "orders").select(
        own.alias("license_id"), F.explode(F.when(key % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("seq"), one_of(key, "renew", "replace", "export").alias("operation"), one_of(key, 3, 5).alias("term_months"),
        F.lower(fingerprint((key + 1).cast("string"))).alias("machine_id"), F.when(key % 4 < 2, F.concat(F.lit("TROCAR:"), own)).otherwise("TROCAR:x").alias("confirmation"), F.date_add(F.col("o_orderdate").cast("date"), 400).alias("at"),
    )
    held = licences(spark, sf_dir).withColumn("expires_at", F.col("expires_at").cast("date"))
    return C.revised(held, rows)


@query(f"with {OPERATIONS} select * from done")
def licence_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What renewals, changes of device and exports came to, refused ones with the reason."""
    return operations(spark, sf_dir)[1]


@query(f"with {OPERATIONS} select license_id, revision as current_revision, machine_id, expires_at from done where seq = 1")
def licences_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations(spark, sf_dir)[0].select("license_id", "current_revision", "machine_id", "expires_at")


@query("""with r as (select c_custkey as request_id, lower(trim(case when c_custkey % 2 = 0 then ' ' || c_name else 'Nation-' || c_nationkey end)) as username, trim(case when c_custkey % 10 = 0 then ' ' else c_name end) as display_name, ['owner', 'guest', 'auditor'][c_custkey % 3 + 1] as role from customer),
 p as (select *, row_number() over (partition by username order by request_id) as place, username in (select lower(c_name) from customer where c_custkey % 20 = 2) as taken from r)
 select request_id, username, display_name, role, case when username = '' or display_name = '' then 'empty' when role = 'guest' then 'role' when taken or place > 1 then 'taken' end as problem from p""")
def user_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    name = F.when(key % 2 == 0, F.concat(F.lit(" "), "c_name")).otherwise(F.concat(F.lit("Nation-"), F.col("c_nationkey").cast("string")))
    requests = rows.select(key.alias("request_id"), name.alias("username"), F.when(key % 10 == 0, " ").otherwise(F.col("c_name")).alias("display_name"), one_of(key, "owner", "guest", "auditor").alias("role"))
    return C.created_users(requests, rows.where(key % 20 == 2).select(F.col("c_name").alias("username")))


@query("select user_id, max_by(event_id % 3, event_id) = 2 as accepted, max_by(event_id % 3, event_id) as accepted_version from events group by 1")
def terms_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.terms_after(table(spark, sf_dir, "events").withColumn("version", F.col("event_id") % 3), "user_id", "event_id", F.lit(2))


@query("""with j as (select c_custkey as file_path, c_custkey as size, c_nationkey as modified, c_custkey % 2 = 0 as done from customer where c_custkey % 3 <> 0), f as (select c_custkey as file_path, c_custkey + case when c_custkey % 5 = 0 then 1 else 0 end as size, c_nationkey as modified from customer where c_custkey % 7 <> 0)
 select coalesce(j.file_path, f.file_path) as file_path, case when f.file_path is null then 'missing' when j.file_path is null then 'start' when j.size <> f.size or j.modified <> f.modified then 'restart' when done then 'skip' else 'resume' end as action from j full join f on f.file_path = j.file_path""")
def batch_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch that goes on does with each file."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key, key.alias("file_path"), key.alias("size"), F.col("c_nationkey").alias("modified"))
    files = rows.where(key % 7 != 0).withColumn("size", F.col("size") + F.when(key % 5 == 0, 1).otherwise(0))
    return C.resumable(rows.where(key % 3 != 0).withColumn("done", key % 2 == 0), files)


@query("select l_orderkey as doc_id, l_linenumber as page, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders) and l_orderkey not in (select l_orderkey from lineitem where l_suppkey % 10 = 0)")
def page_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a conversion which goes on need not read again; another signature on one discards a document's."""
    lines = table(spark, sf_dir, "lineitem")
    pages = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), "l_partkey", F.when(F.col("l_suppkey") % 10 == 0, "v1").otherwise("v2").alias("signature"))
    pages = dealt(pages, parts_for(spark, lines.count()), "doc_id")
    now = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("v2").alias("signature"))
    return C.checkpointed_pages(pages, now).select("doc_id", "page", "l_partkey")


@query("""with t as (select user_id, max(event_id) as last from events group by 1), c as (select user_id, event_id as page, case when event_id % 97 = 0 then 'stop' when event_id % 7 = 1 then 'pause' else 'run' end as command from events where event_id % 97 = 0 or event_id % 7 in (1, 2)),
 f as (select user_id, min(page) filter (where command = 'stop') as s, max_by(command, page) as latest, max(page) as spot from c group by 1)
 select t.user_id as user_id, case when s < last then 'stopped' when latest = 'pause' and spot < last then 'paused' else 'done' end as state, case when s < last then s when latest = 'pause' and spot < last then spot else last end as pages_done from t left join f on f.user_id = t.user_id""")
def control_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", event.alias("page"), F.when(event % 97 == 0, "stop").when(event % 7 == 1, "pause").when(event % 7 == 2, "run").alias("command"))
    return C.controlled(rows, rows.where("command is not null"), "user_id")


@query("""with r as (select doc_id, sha256(sha256(text) || ':' || printf('%.2f', (doc_id % 3) / 10.0::double)) as key from documents) select doc_id, key, key in (select key from r where doc_id % 4 = 0) as hit from r""")
def read_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are read already under the same least score."""
    requests = table(spark, sf_dir, "documents").select("doc_id", "text", ((F.col("doc_id") % 3) / 10.0).alias("score"))
    keyed = C.cached_reads(requests, spark.createDataFrame([], "key string"), "text", "score")
    return C.cached_reads(requests, keyed.where("doc_id % 4 = 0"), "text", "score").select("doc_id", "key", "hit")


@query("""with s as (select c_custkey, ['closed', 'open', 'half_open'][c_custkey % 3 + 1] as state, (c_custkey % 100)::double as opened from customer)
 select c_custkey, case when state = 'open' and opened <= 30 then 'half_open' else state end as shown, case when state = 'open' then greatest(0.0::double, opened - 30) else 0.0::double end as retry_after from s""")
def breaker_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "customer").select("c_custkey", one_of(F.col("c_custkey"), "closed", "open", "half_open").alias("state"), (F.col("c_custkey") % 100).cast("double").alias("opened"))
    return C.breaker_view(states, F.lit(90.0)).select("c_custkey", "shown", "retry_after")


@query("""with a as (select event_id // 4 as call_id, event_id % 4 + 1 as attempt, event_id % 3 = 0 as ok, (event_id % 5) * 0.5::double as took from events where event_id % 4 < 3),
 w as (select *, coalesce(max(ok::int) over b, 0) as done, coalesce(sum(took) over b, 0) + sum(case when attempt > 1 then power(2, attempt - 2) else 0 end) over (partition by call_id order by attempt rows between unbounded preceding and current row) as begins
   from a window b as (partition by call_id order by attempt rows between unbounded preceding and 1 preceding))
 select call_id, count(*) as attempts, bool_or(ok) as ok, max(begins + took) as seconds from w where done = 0 and begins < 4 group by call_id""")
def retried_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.floor(event / 4).alias("call_id"), (event % 4 + 1).alias("attempt"), (event % 3 == 0).alias("ok"), ((event % 5) * 0.5).cast("double").alias("took"))
    return C.retried(rows, "call_id", 3, 1.0, 4.0)


@query("select event_id, list_filter([1.0, 3.0, 7.0], lambda s: s <= event_id % 9).len()::int as waits from events")
def wait_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many waits of 1, 2 and 4 seconds a deadline allows."""
    return table(spark, sf_dir, "events").select("event_id", F.size(T.waits(1.0, 2.0, 4, (F.col("event_id") % 9).cast("double"))).alias("waits"))


@query("""with s as (select l_orderkey, list(['paused', 'running', 'queued', 'failed'][l_partkey % 4 + 1]) as states from lineitem where l_partkey % 8 <> 3 group by 1)
 select l_orderkey, case when list_unique(states) = 1 and states[1] = 'paused' then 'paused' when list_contains(states, 'failed') then 'failed' when list_contains(states, 'running') then 'running' when list_contains(states, 'queued') then 'queued' else 'idle' end as state from s""")
def batch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = one_of(F.col("l_partkey"), "paused", "running", "queued", "failed")
    found = table(spark, sf_dir, "lineitem").where("l_partkey % 8 <> 3").groupBy("l_orderkey").agg(F.collect_list(state).alias("states"))
    return found.select("l_orderkey", T.batch_state(F.col("states")).alias("state"))


@query("""select user_id, max(ts) filter (where event_id % 2 = 0 and user_id % 5 <> 0) as observed, max(ts) filter (where event_id % 6 = 0 and user_id % 5 <> 0) as trusted, case when count(*) filter (where event_id % 2 = 0 and user_id % 5 <> 0) = 0 then 'no_intact_anchor' end as problem from events group by 1""")
def time_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redundant copies of an anchor made one; an error where none is intact."""
    event = F.col("event_id")
    copies = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("observed"), F.when(event % 3 == 0, F.col("ts")).alias("trusted"), ((event % 2 == 0) & (F.col("user_id") % 5 != 0)).alias("intact"))
    return C.anchors_merged(copies, "user_id")


@query("""with c as (select event_id, user_id, ts - to_minutes((case when event_id % 17 = 0 then event_id % 13 else 0 end)::int) as local, case when event_id % 29 = 0 then ts + interval 10 minutes end as trusted from events),
 h as (select *, max(greatest(local, trusted)) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as high, max(trusted) over (partition by user_id order by event_id rows between unbounded preceding and current row) as last_trusted from c)
 select event_id, trusted is null and coalesce(local < high - interval 5 minutes, false) as tampered, case when trusted is not null then greatest(local, trusted) else greatest(local, high) end as effective, last_trusted from h""")
def clock_with_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted times, which no reading is set against, raise the highest time."""
    event = F.col("event_id")
    back = F.make_dt_interval(mins=F.when(event % 17 == 0, event % 13).otherwise(0).cast("int"))
    rows = table(spark, sf_dir, "events").withColumn("local", F.col("ts") - back).withColumn("trusted", F.when(event % 29 == 0, F.col("ts") + F.expr("INTERVAL '10' MINUTE")))
    return C.clock_with_trust(rows, "user_id", "event_id", "local", "trusted").select("event_id", "tampered", "effective", "last_trusted")


@query("select user_id, count(*) as events, count(*) filter (where event_id % 50 = 0) as broken from events group by 1")
def audit_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain in which some events were changed afterwards: exactly those no longer fit their hashes."""
    fields = ["event_id", "event_type", "props"]
    chain = T.append_chain(table(spark, sf_dir, "events"), "user_id", "event_id", fields)
    changed = chain.withColumn("event_type", F.when(F.col("event_id") % 50 == 0, "changed").otherwise(F.col("event_type")))
    return T.verify_chain(changed, "user_id", "event_id", fields).groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(~F.col("valid")).alias("broken"))


@query("""select c_custkey, c_name from customer where c_custkey % 4 = 0 union all select c_custkey, c_name from customer where c_custkey % 2 = 0 and c_custkey % 4 <> 0 and c_custkey % 3 <> 0""")
def legacy_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 3 != 0).alias("intact"))
    return C.migrated(rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 4 = 0").drop("intact"), "c_custkey")


@query("""select o_custkey, 'b' || o_orderkey as name, o_orderdate as modified from orders where o_orderkey % 3 <> 0 qualify row_number() over (partition by o_custkey order by o_orderdate desc, 'b' || o_orderkey desc) = 1""")
def newest_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    backups = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderdate").alias("modified"), (F.col("o_orderkey") % 3 != 0).alias("intact"))
    return C.newest_intact(backups, "o_custkey")


@query("""with recursive k as (select user_id, min(ts) as modified from events group by 1
  union all select k.user_id, (select min(e.ts) from events e where e.user_id = k.user_id and e.ts >= k.modified + interval 1 day) from k where exists (select 1 from events e where e.user_id = k.user_id and e.ts >= k.modified + interval 1 day))
 select user_id, modified from k qualify row_number() over (partition by user_id order by modified desc) <= 5""")
def spaced_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backups a day apart at least, the newest five of each owner."""
    return C.spaced_backups(table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("modified")), "user_id")


@query("select n_regionkey, string_agg(sha256(n_name) || '  ' || n_name, chr(10) order by n_name) as text from nation group by 1")
def declaration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"))
    return files.groupBy("n_regionkey").agg(C.declaration(files).alias("text"))
