"""URL filters: fixed rules, and a tree of path templates that is judged by labels. DataFrame functions only.

Each host's distinct paths are read segment by segment, as far down as branches have enough pages. A segment's
values that are frequent among their siblings stay as they are, and so do rarer ones whose share of
bad labels differs from that of their siblings; all others become a wildcard. Sibling branches whose
share of bad labels does not differ more than chance allows are merged, and a branch is rejected if
its share of bad labels, smoothed toward the share of all pages, reaches a limit.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import checkpointed

#: A branch with fewer pages is not read further, its rest is one wildcard; a value with fewer is never literal.
SUPPORT = 5
#: A value with support stays literal if one in SHARE of its siblings' pages has it, or if so many labels as SUPPORT set it apart.
SHARE = 50
#: Squared deviations, in variances of the share, beyond which a value differs from its siblings (5 %).
DEVIATION = 3.84
#: Labels that the smoothing counts for, and the share of bad ones from which a branch is blocked.
SMOOTHING, LIMIT = 10.0, 0.5

#: The last literal segment of a template, what stands before it and the wildcards after it.
LAST_LITERAL = r"^(.*)/([^/*][^/]*)((/[*]+)*)$"

#: Rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it, and begins the path; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for says, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _common(a: Column, b: Column) -> Column:
    """The segments that two lists begin with alike."""
    size = F.least(F.size(a), F.size(b))
    off = F.array_position(F.transform(F.sequence(F.lit(1), size), lambda k: F.element_at(a, k) == F.element_at(b, k)), F.lit(False)).cast("int")
    return F.when(size > 0, F.slice(a, F.lit(1), F.when(off > 0, off - 1).otherwise(size))).otherwise(F.array().cast("array<string>"))


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, n, labelled, bad, template) of distinct paths of (host, path, n, labelled, bad), n being their pages.

    The tree is read as a radix tree: a branch whose paths all go on alike takes the whole way that they share at once, so rounds
    follow where branches part, not how deep they are. A path leaves the tree where it ends or its branch has too few pages.
    """
    own = ["host", "path", "n", "labelled", "bad"]
    ended, going = [], paths.select(*own, F.filter(F.split("path", "/"), lambda s: s != "").alias("rest"), F.lit("").alias("template"))
    while True:
        rows = checkpointed(going)
        ended.append(rows.where(F.size("rest") == 0).select(*own, "template"))
        rows = rows.where(F.size("rest") > 0)
        if rows.isEmpty():
            break
        above = rows.groupBy("host", "template").agg(F.sum("n").alias("of"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        above = above.select("host", "template", "of", "all_labelled", "all_bad", F.when(F.col("of") >= SUPPORT, _common(F.col("lo"), F.col("hi"))).alias("way"))
        # Sums are written before they are joined: a join of two plain exchanges lets a hot branch's rows be split.
        rows = checkpointed(rows.join(checkpointed(above), ["host", "template"]))
        ended.append(rows.where("way is null").select(*own, F.concat("template", F.lit("/**")).alias("template")))
        step = lambda way: [F.slice("rest", F.size(way) + 1, F.size("rest")).alias("rest"), F.concat_ws("/", "template", way).alias("template")]
        alike = rows.where(F.size("way") > 0).select(*own, *step(F.col("way")))
        parting = rows.where(F.size("way") == 0).withColumn("segment", F.get("rest", F.lit(0)))
        counts = parting.groupBy("host", "template", "segment").agg(F.sum("n").alias("here"), F.sum("labelled").alias("labelled_here"), F.sum("bad").alias("bad_here"), *(F.first(c).alias(c) for c in ("of", "all_labelled", "all_bad")))
        p = F.try_divide(F.col("all_bad").cast("double"), F.col("all_labelled"))
        off = F.try_divide(F.col("bad_here").cast("double"), F.col("labelled_here")) - p
        apart = (F.col("labelled_here") >= SUPPORT) & (off * off * F.col("labelled_here") > DEVIATION * p * (1 - p))
        kept = counts.where((F.col("here") >= SUPPORT) & ((F.col("here") * SHARE >= F.col("of")) | apart)).select("host", "template", "segment", F.lit(True).alias("literal"))
        parted = parting.join(checkpointed(kept), ["host", "template", "segment"], "left")
        going = alike.unionByName(parted.select(*own, *step(F.array(F.when(F.col("literal"), F.col("segment")).otherwise("*")))))
    return functools.reduce(DataFrame.unionByName, ended)


def branches(rows: DataFrame) -> DataFrame:
    """(host, template, branch, n_labelled, n_bad, verdict) of each template of (host, template, labelled, bad), numbers of pages."""
    nodes = checkpointed(rows.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    total = nodes.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    share = float(total.bad) / total.labelled if total.labelled else 0.0
    nodes = nodes.withColumn("family", F.regexp_replace("template", LAST_LITERAL, "$1/{}$3"))
    families = nodes.groupBy("host", "family").agg(F.count("*").alias("siblings"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    nodes = nodes.join(families, ["host", "family"])
    p = F.try_divide(F.col("all_bad").cast("double"), F.col("all_labelled"))
    off = F.try_divide(F.col("bad").cast("double"), F.col("labelled")) - p
    alike = (F.col("labelled") == 0) | (off * off * F.col("labelled") <= DEVIATION * p * (1 - p))
    nodes = nodes.withColumn("branch", F.when((F.col("siblings") > 1) & alike, F.col("family")).otherwise(F.col("template")))
    merged = nodes.groupBy("host", "branch").agg(F.sum("labelled").alias("n_labelled"), F.sum("bad").alias("n_bad"))
    purity = (F.col("n_bad") + SMOOTHING * share) / (F.col("n_labelled") + SMOOTHING)
    merged = merged.withColumn("verdict", F.when(purity >= LIMIT, "block").otherwise("allow"))
    return nodes.select("host", "template", "branch").join(merged, ["host", "branch"])


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, branch, n_labelled, n_bad) of each row of (page_id, url).

    labels holds (page_id, bad), bad being 1 or 0; a page labelled more than once counts as bad if any
    label says so. The longest fitting rule decides, otherwise the branch. A template ends in "/**" where its
    branch has too few pages to be read further. A url that is null or has
    no "://" has an empty host and path, which are judged like any others. Rows stay as they are,
    repeated ones too; other columns are not read.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    marks = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    rows = rows.join(marks, "page_id", "left")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    found = checkpointed(templates(paths))
    judged = found.select("host", "path", "template").join(branches(found).withColumnRenamed("verdict", "judged"), ["host", "template"])
    rows = rows.join(judged, ["host", "path"])
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "judged").alias("verdict"), "template", "branch", "n_labelled", "n_bad")


def oracle_sql() -> str:
    """The same over DuckDB's tables pages and labels; a page is labelled by the document whose id ends its path."""
    fits = lambda domain, prefix: f"(host = '{domain}' or ends_with(host, '.{domain}')) and starts_with(path, '{prefix}')"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "case " + " ".join(f"when {fits(d, p)} then '{d}{p}'" for _, d, p in longest) + " end"
    verdict = "case " + " ".join(f"when {fits(d, p)} then '{v}'" for v, d, p in longest) + " end"
    return rf"""
with recursive parsed as (select page_id, coalesce(translate(regexp_extract(url, '{PARTS}', 1), '{UPPER}', '{LOWER}'), '') as host,
    coalesce(regexp_extract(url, '{PARTS}', 2), '') as path from pages)
, marks as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where doc_id is not null group by 1)
, pages_in as (select page_id, host, path, bad, list_filter(string_split(path, '/'), lambda s: s <> '') as segments
    from parsed left join marks on doc_id = try_cast(nullif(regexp_extract(path, '([0-9]+)[^/0-9]*/?$', 1), '') as bigint))
, tree as (select 0 as level, *, '' as template, len(segments) > 0 as going from pages_in
    union all select level + 1, page_id, host, path, bad, segments, template || case when above < {SUPPORT} then '/**'
    when n >= {SUPPORT} and (n * {SHARE} >= above or labelled >= {SUPPORT} and off * off * labelled > {DEVIATION}::double * p * (1 - p)) then '/' || segment else '/*' end,
    above >= {SUPPORT} and level + 1 < len(segments)
    from (select *, bad_here::double / nullif(labelled, 0) - p as off from (select *, all_bad::double / nullif(all_labelled, 0) as p from (
        select *, count(*) over one as n, count(bad) over one as labelled, coalesce(sum(bad) over one, 0) as bad_here,
            count(*) over every as above, count(bad) over every as all_labelled, coalesce(sum(bad) over every, 0) as all_bad
        from (select *, segments[level + 1] as segment from tree where going)
        window one as (partition by host, template, segment), every as (partition by host, template)))))
, rows as (select page_id, host, path, bad, template from tree where not going)
, nodes as (select host, template, count(bad) as labelled, coalesce(sum(bad), 0)::bigint as bad,
    regexp_replace(template, '{LAST_LITERAL}', '\1/{{}}\3') as family from rows group by host, template)
, families as (select *, count(*) over w as siblings, sum(labelled) over w as all_labelled, sum(bad) over w as all_bad from nodes window w as (partition by host, family))
, rates as (select *, all_bad::double / nullif(all_labelled, 0) as p, bad::double / nullif(labelled, 0) - all_bad::double / nullif(all_labelled, 0) as off from families)
, alike as (select host, template, labelled, bad, case when siblings > 1 and (labelled = 0 or off * off * labelled <= {DEVIATION}::double * p * (1 - p)) then family else template end as branch from rates)
, merged as (select host, branch, sum(labelled)::bigint as n_labelled, sum(bad)::bigint as n_bad from alike group by host, branch)
, base as (select coalesce(sum(bad)::double / nullif(sum(labelled), 0), 0) as share from nodes)
, judged as (select alike.host, template, branch, n_labelled, n_bad, case when (n_bad + {SMOOTHING}::double * share) / (n_labelled + {SMOOTHING}::double) >= {LIMIT} then 'block' else 'allow' end as judged
    from alike join merged using (host, branch), base)
select page_id, rows.host as host, path, {rule.replace("host", "rows.host")} as rule, coalesce({verdict.replace("host", "rows.host")}, judged) as verdict, rows.template as template, branch, n_labelled, n_bad
from rows join judged on rows.host = judged.host and rows.template = judged.template
"""
