"""Queries on the document library. Documents are its files, labels tell which are indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import asset_folder, fingerprint, html_escaped, json_for_html, safe_warning
from quirework.operators import library as B
from quirework.plans.registry import query, table

SEARCH = "the and"

RANKED = """tokens as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as words from documents),
 counted as (select doc_id, len(words) as size, len(list_filter(words, lambda x: starts_with(x, 'the'))) as tf0, len(list_filter(words, lambda x: starts_with(x, 'and'))) as tf1 from tokens),
 totals as (select count(*) as n, avg(size) as mean, count(*) filter (where tf0 > 0) as df0, count(*) filter (where tf1 > 0) as df1 from counted),
 ranked as (select doc_id, 0.0::double - greatest(ln((n::double - df0 + 0.5) / (df0 + 0.5::double)), 1e-6::double) * (tf0 * 2.2::double) / (tf0 + 1.2::double * (0.25::double + 0.75::double * size / mean))
   - greatest(ln((n::double - df1 + 0.5) / (df1 + 0.5::double)), 1e-6::double) * (tf1 * 2.2::double) / (tf1 + 1.2::double * (0.25::double + 0.75::double * size / mean)) as rank from counted, totals where tf0 > 0 and tf1 > 0)"""
STATUS = "case when l.quality = 0 then 'user_removed' when l.quality = 1 then 'available' end"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an availability status from their labels; unlabelled ones have none."""
    labels = table(spark, sf_dir, "labels")
    status = F.when(F.col("quality") == 0, B.REMOVED).when(F.col("quality") == 1, B.AVAILABLE)
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("availability_status", status)


@query(f"with {RANKED} select r.doc_id as doc_id, source, round(rank, 6) as rank from ranked r left join documents d on d.doc_id = r.doc_id left join labels l on l.doc_id = r.doc_id where l.quality is null or l.quality <> 0 order by round(r.rank, 6), r.doc_id limit 40")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = B.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", SEARCH)
    found = ranked.join(catalogue(spark, sf_dir).select("doc_id", "source", "availability_status"), "doc_id", "left")
    return found.where(B.shown(F.col("availability_status"))).select("doc_id", "source", F.round("rank", 6).alias("rank")).orderBy("rank", "doc_id").limit(40)


@query(f"with {RANKED}, top as (select * from ranked order by round(rank, 6), doc_id limit 50) select t.doc_id as doc_id, lang from top t join documents d on d.doc_id = t.doc_id where lang = 'en'")
def library_search_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type filter applies to the fifty best hits, not before them."""
    top = B.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", SEARCH).orderBy(F.round("rank", 6), "doc_id").limit(50)
    return top.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("lang = 'en'").select("doc_id", "lang")


@query("""with p as (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as parts from documents),
 a as (select *, coalesce(list_position(list_transform(parts, lambda x: regexp_matches(x, '(?i)^[^\\p{L}\\p{N}]*(?:idiot|worthless)')), true), 0) as hit from p),
 f as (select *, greatest(1, hit - 11) as first from a)
 select doc_id, (case when first > 1 then '...' else '' end) || array_to_string(list_transform(parts[first:first + 21], lambda x: case when regexp_matches(x, '(?i)^[^\\p{L}\\p{N}]*(?:idiot|worthless)') then '<mark>' || replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</mark>' else replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') end), ' ') || (case when len(parts) >= first + 22 then '...' else '' end) as snippet from f""")
def library_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", B.snippet(F.col("text"), ["idiot", "worthless"]).alias("snippet"))


@query("select token, count(*) as documents, sum(tf)::bigint as occurrences from (select doc_id, token, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as token from documents) group by 1, 2) group by token")
def library_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.postings(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("token").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


@query(f"select d.doc_id as doc_id, source, n_chars, {STATUS} as availability_status from documents d left join labels l on l.doc_id = d.doc_id where l.quality is null or l.quality <> 0 order by n_chars desc, d.doc_id limit 20")
def library_recents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue(spark, sf_dir).where(B.shown(F.col("availability_status")))
    return rows.select("doc_id", "source", "n_chars", "availability_status").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("select d.doc_id as doc_id, exists (select 1 from labels l where l.doc_id = d.doc_id) as indexed from documents d")
def library_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("indexed", F.lit(True))
    return table(spark, sf_dir, "documents").join(known, "doc_id", "left").select("doc_id", F.coalesce("indexed", F.lit(False)).alias("indexed"))


@query(f"with s as (select d.doc_id as doc_id, {STATUS} as status, p.page_id is not null as there from documents d left join labels l on l.doc_id = d.doc_id left join pages p on p.page_id = d.doc_id) select doc_id, case when not there and coalesce(status, case when there then 'available' else 'temporarily_unavailable' end) = 'available' then 'temporarily_unavailable' else coalesce(status, case when there then 'available' else 'temporarily_unavailable' end) end as status from s")
def library_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(True).alias("there"))
    rows = catalogue(spark, sf_dir).join(files, "doc_id", "left")
    return rows.select("doc_id", B.availability(F.col("availability_status"), F.coalesce("there", F.lit(False))).alias("status"))


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A catalogue of the documents with even ids, and writes to all: two for each id divisible by three."""
    row = [
        F.col("doc_id").alias("file_path"), F.col("source").alias("file_name"), F.col("n_chars").alias("file_size"), (F.col("n_chars") % 100).alias("page_count"), F.lit(0).cast("long").alias("last_page_read"),
        F.lit("1.0").alias("preferred_zoom"), F.lit("").alias("markdown_path"), F.lit(0).alias("is_converted"), F.col("doc_id").alias("last_accessed"), F.when(F.col("doc_id") % 10 == 0, B.REMOVED).otherwise(B.AVAILABLE).alias("availability_status"), F.lit("pending").alias("index_status"),
    ]
    documents = table(spark, sf_dir, "documents")
    old = documents.where("doc_id % 2 = 0").select(*row)
    new = documents.withColumn("seq", F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    new = new.select(
        F.col("doc_id").alias("file_path"), F.concat("source", F.lit("-"), "seq").alias("file_name"), F.when(F.col("doc_id") % 4 == 0, 0).otherwise(F.col("n_chars") + 1).cast("long").alias("file_size"), (F.col("n_chars") % 100 + F.col("seq")).alias("page_count"), F.col("seq").cast("long").alias("last_page_read"),
        F.lit("2.0").alias("preferred_zoom"), F.concat(F.lit("md/"), "doc_id").alias("markdown_path"), F.lit(1).alias("is_converted"), (F.col("doc_id") + 1000).alias("last_accessed"), F.lit(B.AVAILABLE).alias("availability_status"), F.lit("done").alias("index_status"), "seq",
    )
    return old, new


COLUMNS = ("file_name", "file_size", "page_count", "last_page_read", "preferred_zoom", "markdown_path", "is_converted", "last_accessed", "availability_status", "index_status")


def _upsert_sql(kind: str) -> str:
    def value(c: str) -> str:
        taken = f"n.{c}" if c in B.ON_CONFLICT[kind] else f"o.{c}"
        if kind == "metadata" and c == "file_size":
            taken = "case when n.file_size > 0 then n.file_size else o.file_size end"
        return f"case when o.file_path is null then n.{c} when n.file_path is null then o.{c} else {taken} end as {c}"

    return f"""with o as (select doc_id as file_path, source as file_name, n_chars as file_size, n_chars % 100 as page_count, 0::bigint as last_page_read, '1.0' as preferred_zoom, '' as markdown_path, 0 as is_converted, doc_id as last_accessed,
  case when doc_id % 10 = 0 then 'user_removed' else 'available' end as availability_status, 'pending' as index_status from documents where doc_id % 2 = 0),
 w as (select *, unnest(case when doc_id % 3 = 0 then [1, 2] else [1] end) as seq from documents),
 n as (select doc_id as file_path, source || '-' || seq as file_name, case when doc_id % 4 = 0 then 0 else n_chars + 1 end as file_size, n_chars % 100 + seq as page_count, seq::bigint as last_page_read, '2.0' as preferred_zoom, 'md/' || doc_id as markdown_path,
  1 as is_converted, doc_id + 1000 as last_accessed, 'available' as availability_status, 'done' as index_status from w qualify row_number() over (partition by doc_id order by seq desc) = 1)
 select coalesce(o.file_path, n.file_path) as file_path, {', '.join(map(value, COLUMNS))} from o full join n on o.file_path = n.file_path"""


@query(_upsert_sql("metadata"))
def upsert_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.upsert(*_files(spark, sf_dir), "metadata")


@query(_upsert_sql("full"))
def upsert_full_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.upsert(*_files(spark, sf_dir), "full")


@query(_upsert_sql("markdown"))
def upsert_markdown_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.upsert(*_files(spark, sf_dir), "markdown")


@query(_upsert_sql("failure"))
def upsert_index_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.upsert(*_files(spark, sf_dir), "failure")


@query(_upsert_sql("session"))
def upsert_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.upsert(*_files(spark, sf_dir), "session")


@query("select conv_id, turn, text from (select conv_id, turn, text from conversations qualify row_number() over (partition by conv_id, turn order by turn) = 1) join (select conv_id, count(*) as c from conversations group by 1) using (conv_id) where turn < c - 1")
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand for pages that are written one by one; the last page of each document is beyond its count."""
    turns = table(spark, sf_dir, "conversations")
    counts = turns.groupBy("conv_id").agg((F.count("*") - 1).alias("page_count"))
    return B.latest_pages(turns.select("conv_id", "turn", "text", F.col("turn").alias("seq")), counts, "conv_id", "turn").select("conv_id", "turn", "text")


@query("select conv_id, turn, left(replace(replace(replace(replace(text, chr(13), ' '), chr(10), ' '), '<', '&lt;'), '>', '&gt;'), 300) as title from conversations")
def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", safe_warning(F.col("text")).alias("title"))
    return rows.orderBy("conv_id", "turn")


@query("select doc_id, case when n = 1 then source else source || ' (' || n || ')' end as reserved from (select doc_id, source, row_number() over (partition by lower(source) order by doc_id) as n from documents)")
def reserved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.reserve_names(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "reserved")


@query("select page_id, left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) || '-' || left(sha1(url), 8) as folder, substr(sha256(html), 1, 16) as version from pages")
def asset_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", asset_folder(F.col("url")).alias("folder"), F.left(F.sha2("html", 256), F.lit(16)).alias("version"))


@query("select source, doc_id, n_chars from documents qualify row_number() over (partition by source order by n_chars desc, doc_id desc) <= 5")
def kept_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.struct("n_chars", "doc_id").alias("age"))
    return B.kept_copies(rows, "source", "age").drop("age")


@query("select d.doc_id as doc_id, l.doc_id is not null as found, coalesce(l.quality, 0) as last_page, case when l.quality is null then '1.0' else l.quality::varchar end as zoom from documents d left join labels l on l.doc_id = d.doc_id")
def session_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("known", F.lit(True))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return rows.select("doc_id", F.col("known").isNotNull().alias("found"), F.coalesce("quality", F.lit(0)).alias("last_page"), F.coalesce(F.col("quality").cast("string"), F.lit("1.0")).alias("zoom"))


@query("select doc_id, sha256(text) as sha256, octet_length(encode(text)) as bytes from documents order by doc_id")
def hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes")).orderBy("doc_id")


@query("select source, count(*) as files, sum(n_chars)::bigint as bytes from documents group by source")
def directory_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))


@query("""select page_id, replace(replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') as payload from pages""")
def html_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", json_for_html(html_escaped(F.col("html"))).alias("payload"))


@query("select lower(url) as url, min(page_id) as page_id from pages where url like 'http%' group by 1 order by page_id limit 100")
def ingress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred distinct addresses, whatever their case."""
    rows = table(spark, sf_dir, "pages").where(F.col("url").startswith("http")).groupBy(F.lower("url").alias("url")).agg(F.min("page_id").alias("page_id"))
    return rows.orderBy("page_id").limit(100)


@query("select c_custkey, upper(substr(sha256(c_name), 1, 4) || '-' || substr(sha256(c_name), 5, 4) || '-' || substr(sha256(c_name), 9, 4) || '-' || substr(sha256(c_name), 13, 4)) as machine from customer")
def machine_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", fingerprint(F.col("c_name")).alias("machine"))


@query("select case when doc_id % 4 = 0 and doc_id % 3 <> 0 then doc_id + 10000000 else doc_id end as file_path, source as file_name, case when doc_id % 6 = 0 or doc_id % 10 = 0 then 'user_removed' else 'available' end as status from documents where doc_id % 2 = 0")
def library_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft deletes of every third file, then moves; a move onto a path that is taken is refused."""
    files, _ = _files(spark, sf_dir)
    files = B.removed(files, files.where("file_path % 3 = 0").select("file_path"))
    moves = files.where("file_path % 4 = 0").select("file_path", F.when(F.col("file_path") % 3 == 0, F.col("file_path")).otherwise(F.col("file_path") + 10000000).alias("target"))
    return B.relocated(files, moves).select("file_path", "file_name", F.col("availability_status").alias("status"))
