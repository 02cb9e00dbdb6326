"""Queries on licences. Orders stand for licences and their customers, line items for revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import fingerprint
from quirework.operators import licences as L
from quirework.plans.registry import query, table

NOW = "1998-01-01 00:00:00"


def now() -> Column:
    return F.expr(f"timestamp_ntz'{NOW}'")



def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    term = F.element_at(F.array(F.lit(3), F.lit(6), F.lit(12)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).withColumn("term_months", term)
    key = F.col("o_orderkey").cast("string")
    return rows.select(
        F.concat(F.lit("LIC-"), F.lpad(key, 8, "0")).alias("license_id"),
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        L.normalized_name_column(F.col("c_name")).alias("normalized_name"),
        fingerprint(key).alias("machine_id"),
        F.col("o_orderpriority").alias("customer_reference"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("not_before"),
        L.add_months(F.col("o_orderdate"), F.col("term_months")).cast("timestamp_ntz").alias("expires_at"),
        "term_months",
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("current_revision"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.with_revision(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return rows.select(F.concat(F.lit("LIC-"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0")).alias("license_id"), "revision", F.col("l_returnflag").alias("operation"), F.col("l_shipdate").alias("issued_at"), F.col("l_extendedprice").alias("amount"))


LICENCES = """licences as (select 'LIC-' || lpad(o_orderkey::varchar, 8, '0') as license_id, c_custkey as customer_id, c_name as customer_name, lower(c_name) as normalized_name,
  upper(substr(sha256(o_orderkey::varchar), 1, 4) || '-' || substr(sha256(o_orderkey::varchar), 5, 4) || '-' || substr(sha256(o_orderkey::varchar), 9, 4) || '-' || substr(sha256(o_orderkey::varchar), 13, 4)) as machine_id,
  o_orderpriority as customer_reference, o_orderdate as not_before, [3, 6, 12][o_orderkey % 3 + 1] as term_months,
  o_orderdate + to_months([3, 6, 12][o_orderkey % 3 + 1]) as expires_at, (o_orderkey % 4 + 1)::int as current_revision
  from orders join customer on o_custkey = c_custkey)"""
REVISIONS = """revisions as (select 'LIC-' || lpad(l_orderkey::varchar, 8, '0') as license_id,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)::int as revision,
  l_returnflag as operation, l_shipdate as issued_at, l_extendedprice as amount from lineitem)"""
STATUS = f"case when expires_at <= timestamp '{NOW}' then 'expired' when expires_at <= timestamp '{NOW}' + interval 30 days then 'expiring' else 'valid' end"
PAGE = f"select license_id, customer_name, machine_id, expires_at, current_revision, {STATUS} as effective_status from licences"


@query(f"with {LICENCES} select count(*) filter (where expires_at > timestamp '{NOW}' + interval 30 days) as valid, count(*) filter (where expires_at > timestamp '{NOW}' and expires_at <= timestamp '{NOW}' + interval 30 days) as expiring, count(*) filter (where expires_at <= timestamp '{NOW}') as expired from licences")
def licence_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dashboard(licences(spark, sf_dir), now())


@query(f"with {LICENCES} {PAGE} where expires_at > timestamp '{NOW}' and expires_at <= timestamp '{NOW}' + interval 30 days order by expires_at, license_id limit 25 offset 25")
def licence_search_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search(licences(spark, sf_dir), "status:expirando", now(), page=2)[0]


@query(f"with {LICENCES} {PAGE} where normalized_name like '%customer#00000001%' and expires_at > timestamp '{NOW}' and expires_at <= timestamp '{NOW}' + interval 400 days and (lower(license_id) like '%lic-%' or normalized_name like '%lic-%' or lower(machine_id) like '%lic-%' or lower(customer_reference) like '%lic-%') order by expires_at, license_id limit 100")
def licence_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search(licences(spark, sf_dir), "cliente:Customer#00000001 expira:400d LIC-", now(), page_size=100)[0]


@query(f"with {LICENCES} select count(*) as total from licences where machine_id like '%AB%' and expires_at <= timestamp '{NOW}'")
def licence_search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search(licences(spark, sf_dir), "maquina:ab status:expirada", now())[1]


@query(f"""with {LICENCES}, judged as (select *, case when customer_id % 97 = 0 then 'machine_mismatch' when customer_id % 89 = 0 then 'clock_tampered' when timestamp '{NOW}' < not_before then 'invalid'
  when timestamp '{NOW}' >= expires_at then 'expired' when greatest(1, ceil((epoch_us(expires_at) - epoch_us(timestamp '{NOW}')) / 86400000000)) <= 30 then 'expiring' else 'valid' end as state from licences)
  select license_id, state, case when state = 'expired' then 0 when state in ('expiring', 'valid') then greatest(1, ceil((epoch_us(expires_at) - epoch_us(timestamp '{NOW}')) / 86400000000)) end::bigint as days_remaining from judged""")
def licence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = F.when(F.col("customer_id") % 97 == 0, "OTHER").otherwise(F.concat(F.lit(" "), F.lower("machine_id")))
    return L.evaluate(licences(spark, sf_dir), now(), machine, F.col("customer_id") % 89 == 0).select("license_id", "state", "days_remaining")


@query(f"with {LICENCES} select license_id, case when expires_at <= timestamp '{NOW}' then 'expired' when floor((epoch_us(expires_at) - epoch_us(timestamp '{NOW}')) / 86400000000) <= 30 then 'expiring' else 'valid' end as status from licences")
def licence_status_by_whole_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(spark, sf_dir).select("license_id", L.status_by_whole_days(F.col("expires_at"), now()).alias("status"))


@query(f"with {LICENCES}, {REVISIONS} select l.license_id as license_id, l.current_revision as current_revision, operation, issued_at, amount from licences l join revisions r on r.license_id = l.license_id and r.revision = l.current_revision")
def licence_current_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_revision(licences(spark, sf_dir), revisions(spark, sf_dir)).select("license_id", "current_revision", "operation", "issued_at", "amount")


@query(f"with {REVISIONS} select license_id, revision, operation, issued_at, amount from revisions qualify row_number() over (partition by license_id order by revision desc) = 1")
def licence_newest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.newest(revisions(spark, sf_dir), "license_id", "revision").select("license_id", "revision", "operation", "issued_at", "amount")


@query(f"with {REVISIONS} select license_id, array_to_string(list_sort(list_distinct(list(operation))), ',') as features from revisions group by license_id")
def licence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions(spark, sf_dir).groupBy("license_id").agg(F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("features"))


@query("select max(substr('LIC-' || lpad(o_orderkey::varchar, 8, '0'), 5)::bigint) + 1 as next_number from orders")
def licence_next_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(spark, sf_dir).agg(L.next_number(F.col("license_id"), "LIC-").alias("next_number"))


@query(f"with {LICENCES} select license_id, customer_name, expires_at from licences where expires_at > timestamp '{NOW}' and expires_at <= timestamp '{NOW}' + interval 30 days order by expires_at, license_id limit 10")
def licence_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(spark, sf_dir).where(L.within(F.col("expires_at"), now(), 30)).select("license_id", "customer_name", "expires_at").orderBy("expires_at", "license_id").limit(10)


@query(f"with {LICENCES} select license_id, greatest(expires_at, timestamp '{NOW}') + to_months(term_months) as renewed_until from licences")
def licence_renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(spark, sf_dir).select("license_id", L.add_months(F.greatest("expires_at", now()), F.col("term_months")).alias("renewed_until"))


@query(f"""with {LICENCES}, {REVISIONS}, f as (select license_id, list(operation order by revision) as features from revisions group by license_id), c as (select l.license_id as license_id,
  list_filter([case when not regexp_matches(l.license_id, '^LIC-[0-9]{{4,}}$') then 'license_id' end, case when not regexp_matches(machine_id, '^[A-F0-9]{{4}}(-[A-F0-9]{{4}}){{3}}$') then 'machine_id' end,
  case when not not_before < expires_at then 'dates' end, case when current_revision < 1 then 'revision' end, case when term_months not in (3, 6, 12) then 'term' end,
  case when features <> list_sort(list_distinct(features)) then 'features' end], lambda x: x is not null) as problems from licences l join f on f.license_id = l.license_id)
  select license_id, array_to_string(problems, ',') as problems from c""")
def licence_payload_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("revision", "operation"))), lambda x: x.operation)
    features = revisions(spark, sf_dir).groupBy("license_id").agg(listed.alias("features"))
    return L.payload_problems(licences(spark, sf_dir).join(features, "license_id")).select("license_id", F.array_join("problems", ",").alias("problems"))


@query(f"""with {LICENCES}, {REVISIONS}, f as (select license_id, list(distinct operation) as features from revisions group by license_id), s as (select license_id, {STATUS} as state from licences)
  select s.license_id as license_id, case when state not in ('valid', 'expiring') then state when not list_contains(coalesce(features, []), 'R') then 'feature_missing' else 'ok' end as access from s left join f on f.license_id = s.license_id""")
def licence_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = revisions(spark, sf_dir).groupBy("license_id").agg(F.collect_set("operation").alias("features"))
    rows = licences(spark, sf_dir).join(features, "license_id", "left").withColumn("state", L.status_of(F.col("expires_at"), now()))
    return rows.select("license_id", L.may_use(F.col("state"), F.coalesce("features", F.array().cast("array<string>")), "R").alias("access"))


@query(f"with {LICENCES} select customer_id, customer_name, count(*) as licences, max(expires_at) as last_expiry from licences group by 1, 2")
def customer_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(spark, sf_dir).groupBy("customer_id", "customer_name").agg(F.count("*").alias("licences"), F.max("expires_at").alias("last_expiry"))


@query(f"with {REVISIONS}, f as (select license_id, list_sort(list_distinct(list(operation))) as f from revisions group by license_id) select license_id, len(list_filter(f, lambda x: x not in ('A', 'N'))) = 0 as subset, array_to_string(list_filter(['A', 'N', 'R'], lambda x: not list_contains(f, x)), ',') as missing from f")
def licence_feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = revisions(spark, sf_dir).groupBy("license_id").agg(F.collect_set("operation").alias("f"))
    allowed, known = F.array(F.lit("A"), F.lit("N")), F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    return rows.select("license_id", (F.size(F.array_except("f", allowed)) == 0).alias("subset"), F.array_join(F.array_except(known, "f"), ",").alias("missing"))


@query(f"with {LICENCES}, {REVISIONS} select l.license_id as license_id from licences l anti join revisions r on r.license_id = l.license_id")
def licence_without_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(spark, sf_dir).join(revisions(spark, sf_dir), "license_id", "left_anti").select("license_id")


@query(f"with {REVISIONS} select license_id, revision, issued_at from revisions order by issued_at desc, license_id, revision desc limit 10")
def licence_recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions(spark, sf_dir).select("license_id", "revision", "issued_at").orderBy(F.desc("issued_at"), "license_id", F.desc("revision")).limit(10)
