"""Writes to licences, customers, users and terms, and the journals of batches.

Each write takes the tables as they are and gives their rows afterwards, with what it refused and the rows
that it appends to histories. Nothing is changed in place, so a write can be done again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Terms in months, the roles of users, and the word that confirms a change of device.
TERMS = (3, 6, 12)
ROLES = ("owner", "administrator", "operator", "auditor")
CONFIRMS = "TROCAR:"
MACHINE = r"^[A-F0-9]{4}(-[A-F0-9]{4}){3}$"


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def issued(requests: DataFrame, customers: DataFrame, licences: DataFrame) -> DataFrame:
    """(request_id, problem, license_id, customer_id, machine_id, issued_at, expires_at, term_months, current_revision, customer_reference) of each request.

    requests has (request_id, customer_id, term_months, machine_id, at, reference). Numbers go on within the year
    from the largest that licences has, in order of time and request. A request whose term, machine or customer
    isn't known gets no number but a problem.
    """
    known = customers.select("customer_id", F.lit(True).alias("_known"))
    rows = requests.withColumn("machine_id", F.upper(F.trim("machine_id"))).join(known, "customer_id", "left")
    problem = F.when(~F.coalesce(F.col("term_months").isin(*TERMS), F.lit(False)), "term").when(~F.coalesce(F.col("machine_id").rlike(MACHINE), F.lit(False)), "machine").when(F.col("_known").isNull(), "customer")
    rows = rows.withColumn("problem", problem).withColumn("_year", F.year("at"))
    parts = F.regexp_extract("license_id", r"^LIC-(\d{4})-(\d+)$", 1), F.regexp_extract("license_id", r"^LIC-(\d{4})-(\d+)$", 2)
    last = licences.select(parts[0].try_cast("int").alias("_year"), parts[1].try_cast("long").alias("_n")).where("_n is not null").groupBy("_year").agg(F.max("_n").alias("_last"))
    place = F.row_number().over(Window.partitionBy("_year", F.col("problem").isNull()).orderBy("at", "request_id"))
    rows = rows.withColumn("_place", place).join(last, "_year", "left")
    number = F.lpad((F.coalesce("_last", F.lit(0)) + F.col("_place")).cast("string"), 6, "0")
    fine = F.col("problem").isNull()
    rows = rows.withColumn("license_id", F.when(fine, F.concat(F.lit("LIC-"), F.col("_year").cast("string"), F.lit("-"), number)))
    return rows.select(
        "request_id", "problem", "license_id", "customer_id", "machine_id", F.col("at").alias("issued_at"), F.add_months(F.col("at").cast("date"), F.col("term_months")).alias("expires_at"), "term_months",
        F.when(fine, 1).alias("current_revision"), F.when(fine, F.upper(F.coalesce(blank_to_null(F.col("reference")), "license_id"))).alias("customer_reference"),
    )


def revised(licences: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(licences afterwards, a row for each operation).

    operations has (license_id, seq, operation, term_months, machine_id, confirmation, at), the operation being "renew",
    "replace" or "export". Of several for one licence that with the smallest seq is done, the others are refused as
    "later". A renewal counts from the old end if that is ahead, else from its own time. A replacement needs the
    confirmation with the licence's id and another, well-formed machine. An export changes nothing.
    """
    first = Window.partitionBy("license_id").orderBy("seq")
    at = licences.select("license_id", F.col("machine_id").alias("_machine"), F.col("expires_at").alias("_end"), F.col("current_revision").alias("_revision"))
    rows = operations.withColumn("_place", F.row_number().over(first)).withColumn("machine_id", F.upper(F.trim("machine_id"))).join(at, "license_id", "left")
    right = F.coalesce(F.col("confirmation") == F.concat(F.lit(CONFIRMS), "license_id"), F.lit(False))
    device = F.coalesce(F.col("machine_id").rlike(MACHINE) & (F.col("machine_id") != F.col("_machine")), F.lit(False))
    problem = (
        F.when(F.col("_revision").isNull(), "unknown")
        .when(F.col("_place") > 1, "later")
        .when((F.col("operation") == "renew") & ~F.coalesce(F.col("term_months").isin(*TERMS), F.lit(False)), "term")
        .when((F.col("operation") == "replace") & ~right, "confirmation")
        .when((F.col("operation") == "replace") & ~device, "machine")
    )
    rows = rows.withColumn("problem", problem)
    done = F.col("problem").isNull()
    changes = done & F.col("operation").isin("renew", "replace")
    end = F.when(done & (F.col("operation") == "renew"), F.add_months(F.greatest(F.col("at").cast("date"), "_end"), F.col("term_months"))).otherwise(F.col("_end"))
    machine = F.when(done & (F.col("operation") == "replace"), F.col("machine_id")).otherwise(F.col("_machine"))
    log = rows.select("license_id", "seq", "operation", "problem", F.when(changes, F.col("_revision") + 1).otherwise(F.col("_revision")).cast("int").alias("revision"), machine.alias("machine_id"), end.alias("expires_at"))
    new = log.where("problem is null and operation in ('renew', 'replace')").select("license_id", F.struct("revision", "machine_id", "expires_at").alias("_new"))
    after = licences.join(new, "license_id", "left")
    for name, field in (("current_revision", "revision"), ("machine_id", "machine_id"), ("expires_at", "expires_at")):
        after = after.withColumn(name, F.coalesce(F.col(f"_new.{field}"), F.col(name)))
    return after.drop("_new"), log


def created_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """(request_id, username, display_name, role, problem) of requests for users; names are unique in lower case, the first request for one counts."""
    rows = requests.withColumn("username", F.lower(F.trim("username"))).withColumn("display_name", F.trim("display_name"))
    taken = users.select(F.lower("username").alias("username"), F.lit(True).alias("_taken")).distinct()
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("username").orderBy("request_id"))).join(taken, "username", "left")
    problem = F.when(blank_to_null(F.col("username")).isNull() | blank_to_null(F.col("display_name")).isNull(), "empty").when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "role").when(F.col("_taken").isNotNull() | (F.col("_place") > 1), "taken")
    return rows.select("request_id", "username", "display_name", "role", problem.alias("problem"))


def terms_after(events: DataFrame, user: str, order: str, version: Column) -> DataFrame:
    """(user, accepted, accepted_version): the last acceptance of each user, and whether it is of this version."""
    last = events.groupBy(user).agg(F.max_by("version", order).alias("accepted_version"))
    return last.select(user, F.coalesce(F.col("accepted_version") == version, F.lit(False)).alias("accepted"), "accepted_version")


def resumable(journal: DataFrame, files: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, action) of each file of a batch: "skip" if it is done, "resume" if unchanged since, "restart" if not.

    journal and files have (key, size, modified); journal also done. A file that the journal lacks is "start", one that
    is gone is "missing".
    """
    before = journal.select(key, F.struct("size", "modified", "done").alias("_was"))
    now = files.select(key, F.struct("size", "modified").alias("_is"))
    same = (F.col("_was.size") == F.col("_is.size")) & (F.col("_was.modified") == F.col("_is.modified"))
    action = F.when(F.col("_is").isNull(), "missing").when(F.col("_was").isNull(), "start").when(~F.coalesce(same, F.lit(False)), "restart").when(F.col("_was.done"), "skip").otherwise("resume")
    return before.join(now, key, "full_outer").select(key, action.alias("action"))


def checkpointed_pages(pages: DataFrame, signatures: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The stored pages of (doc, page, signature, ...) whose document has all its pages under its signature of now; others count for nothing.

    Both tables grow with the documents, so neither is broadcast, whatever its estimated size.
    """
    now = signatures.select(doc, F.col("signature").alias("_now")).hint("merge")
    matched = pages.join(now, doc).withColumn("_same", F.col("signature") == F.col("_now"))
    stale = matched.where(~F.coalesce("_same", F.lit(False))).select(doc).distinct().hint("merge")
    return matched.drop("_same", "_now").join(stale, doc, "left_anti")


def controlled(pages: DataFrame, commands: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, state, pages_done): where each document stands after commands of (doc, page, command) that hold from the end of a page.

    The first stop ends it. A pause without a later run keeps it at that page; else it is done.
    """
    total = pages.groupBy(doc).agg(F.max("page").alias("_last"))
    stop = F.min(F.when(F.col("command") == "stop", F.col("page")))
    found = commands.groupBy(doc).agg(stop.alias("_stop"), F.max_by("command", "page").alias("_latest"), F.max("page").alias("_at"))
    rows = total.join(found, doc, "left")
    stopped = F.col("_stop").isNotNull() & (F.col("_stop") < F.col("_last"))
    paused = (F.col("_latest") == "pause") & (F.col("_at") < F.col("_last"))
    state = F.when(stopped, "stopped").when(F.coalesce(paused, F.lit(False)), "paused").otherwise("done")
    return rows.select(doc, state.alias("state"), F.when(stopped, F.col("_stop")).when(F.coalesce(paused, F.lit(False)), F.col("_at")).otherwise(F.col("_last")).alias("pages_done"))


def cached_reads(requests: DataFrame, cache: DataFrame, content: str, score: str) -> DataFrame:
    """Adds key and hit: whether what was read of this content with this least score is there; the key is a hash of both."""
    key = F.sha2(F.concat_ws(":", F.sha2(F.col(content), 256), F.format_number(score, 2)), 256)
    known = cache.select("key").distinct().withColumn("_hit", F.lit(True))
    return requests.withColumn("key", key).join(known, "key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def breaker_view(states: DataFrame, now: Column, open_seconds: float = 60.0) -> DataFrame:
    """Adds shown and retry_after to breakers of (state, opened): an open one is half-open when its time is over; seconds to one decimal."""
    left = F.greatest(F.lit(0.0), F.lit(open_seconds) - (now - F.col("opened")))
    is_open = F.col("state") == "open"
    return states.withColumn("shown", F.when(is_open & (left <= 0), "half_open").otherwise(F.col("state"))).withColumn("retry_after", F.when(is_open, F.bround(left, 1)).otherwise(0.0))


def retried(attempts: DataFrame, call: str, most: int, base: float, timeout: float) -> DataFrame:
    """(call, attempts, ok, seconds): what calls of (call, attempt, ok, took) come to with waits that double and one deadline.

    An attempt begins only before the deadline; a call counts once, as done or failed, however many attempts it took.
    """
    w = Window.partitionBy(call).orderBy("attempt")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    wait = F.when(F.col("attempt") > 1, F.lit(base) * F.pow(F.lit(2.0), F.col("attempt") - 2)).otherwise(0.0)
    rows = attempts.where(F.col("attempt") <= most).withColumn("_wait", wait).withColumn("_done", F.coalesce(F.max(F.col("ok").cast("int")).over(before), F.lit(0)))
    rows = rows.withColumn("_begins", F.coalesce(F.sum("took").over(before), F.lit(0.0)) + F.sum("_wait").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    made = rows.where((F.col("_done") == 0) & (F.col("_begins") < timeout))
    return made.groupBy(call).agg(F.count("*").alias("attempts"), F.bool_or("ok").alias("ok"), F.round(F.max(F.col("_begins") + F.col("took")), 6).alias("seconds"))


def anchors_merged(copies: DataFrame, key: str) -> DataFrame:
    """(key, observed, trusted, problem) of redundant copies of (key, observed, trusted, intact): the newest of intact ones, an error if all are corrupt."""
    fine = F.col("intact")
    merged = copies.groupBy(key).agg(F.max(F.when(fine, F.col("observed"))).alias("observed"), F.max(F.when(fine, F.col("trusted"))).alias("trusted"), F.bool_or(fine).alias("_any"))
    return merged.select(key, "observed", "trusted", F.when(~F.col("_any"), "no_intact_anchor").alias("problem"))


def clock_with_trust(rows: DataFrame, key: str, order: str, local: str, trusted: str, tolerance: str = "INTERVAL '5' MINUTE") -> DataFrame:
    """Adds tampered, effective and last_trusted to clock readings with, now and then, a trusted time.

    Both times raise the highest time. A reading with a trusted time is never tampered with; one without is if it
    is behind the highest by more than the tolerance, and as it is behind, it never raises the highest itself.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_high", F.max(F.greatest(local, trusted)).over(before))
    tampered = F.col(trusted).isNull() & F.coalesce(F.col(local) < F.col("_high") - F.expr(tolerance), F.lit(False))
    effective = F.when(F.col(trusted).isNotNull(), F.greatest(local, trusted)).otherwise(F.greatest(local, "_high"))
    return out.withColumn("tampered", tampered).withColumn("effective", effective).withColumn("last_trusted", F.max(trusted).over(upto)).drop("_high")


def migrated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of the new place with those intact ones of the old place that it lacks."""
    missing = old.where("intact").join(new.select(key), key, "left_anti")
    return new.unionByName(missing.select(*new.columns))


def newest_intact(backups: DataFrame, key: str) -> DataFrame:
    """(key, name, modified) of the newest intact backup of each key; of equal times the last name."""
    return backups.where("intact").groupBy(key).agg(F.max(F.struct("modified", "name")).alias("_b")).select(key, F.col("_b.name").alias("name"), F.col("_b.modified").alias("modified"))


def spaced_backups(backups: DataFrame, key: str, order: str = "modified", keep: int = 5) -> DataFrame:
    """The newest backups of each key that were made: a day at least after the one before, the first of all included.

    Whether a time counts depends on the last that did, so the times of a key are folded in order.
    """
    none = F.array().cast(f"array<{backups.schema[order].dataType.simpleString()}>")
    late = lambda made, t: F.coalesce(t >= F.try_element_at(made, F.lit(-1)) + F.expr("INTERVAL '1' DAY"), F.lit(True))
    made = F.aggregate(F.array_sort(F.collect_set(order)), none, lambda made, t: F.when(late(made, t), F.concat(made, F.array(t))).otherwise(made))
    return backups.groupBy(key).agg(made.alias("_made")).select(key, F.explode(F.slice(F.reverse("_made"), 1, keep)).alias(order))


def declaration(files: DataFrame) -> Column:
    """One text of (path, sha256) rows in order of path, a line each; an aggregate."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["sha256"], F.lit("  "), x["path"])), "\n")
