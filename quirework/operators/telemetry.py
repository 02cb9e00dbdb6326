"""Operational telemetry: summaries, log classes, clocks, audit chains, circuit breakers, batch control."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = ("native", "ocr", "fallback", "empty", "failed")
LOW_SCORE = 0.85

# What each class of log lines holds. Lines without a level of trouble count for none.
LOG_LEVELS = (" ERROR ", " CRITICAL ", " WARNING ")
LOG_CLASSES = {
    "pdf_or_conversion": ("pdf", "fitz", "conversion", "conversão", "document="),
    "memory_or_budget": ("memory", "memória", "memoryerror", "orçamento", "budget"),
    "onnx_or_ocr": ("onnx", "rapidocr", "ocr"),
    "external_service": ("edge-tts", "googletranslator", "tradução", "online service", "serviço online"),
    "permission_or_disk": ("permission", "permissionerror", "acesso negado", "somente leitura", "disco"),
    "sqlite_or_storage": ("sqlite", "integrity_check", "database", "banco", "acervo"),
}


def conversion_summary(pages: DataFrame, *groups: str) -> DataFrame:
    """One row a group, from pages of (seconds, status, score, warning, cache_hit, rss).

    Rates are 0 where nothing was measured, the mean score is null without scores. A score of 0 counts.
    """
    n, seconds = F.count("*"), F.sum(F.greatest("seconds", F.lit(0.0)))
    hits, lookups = F.count_if(F.col("cache_hit")), F.count("cache_hit")
    return pages.groupBy(*groups).agg(
        n.alias("pages"),
        F.round(seconds, 3).alias("seconds"),
        F.when(seconds > 0.001, F.round(n / seconds, 2)).otherwise(0.0).alias("pages_per_second"),
        *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES),
        F.round(F.avg("score"), 4).alias("mean_score"),
        F.count_if(F.col("score") < LOW_SCORE).alias("low_scores"),
        F.count_if(F.length("warning") > 0).alias("warnings"),
        F.coalesce(F.round(F.try_divide(hits, lookups), 3), F.lit(0.0)).alias("hit_ratio"),
        F.round(F.max("rss") / (1024 * 1024), 2).alias("peak_mb"),
    )


def log_classes(lines: DataFrame, line: str) -> DataFrame:
    """How many lines of trouble belong to each class; a line may belong to several."""
    trouble = lines.where(F.col(line).contains(LOG_LEVELS[0]) | F.col(line).contains(LOG_LEVELS[1]) | F.col(line).contains(LOG_LEVELS[2]))
    return trouble.agg(*(F.count_if(F.col(line).rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}_])")).alias(name) for name, words in LOG_CLASSES.items()))


def clock_check(rows: DataFrame, key: str, order: str, local: str, tolerance: str = "INTERVAL '5' MINUTE") -> DataFrame:
    """Adds highest, tampered and effective: a local time behind the highest so far by more than the tolerance is tampered with.

    A tampered time is below the highest, so it never raises it and one pass is exact.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    highest = F.max(local).over(before)
    out = rows.withColumn("highest", highest)
    return out.withColumn("tampered", F.coalesce(F.col(local) < F.col("highest") - F.expr(tolerance), F.lit(False))).withColumn("effective", F.greatest(local, "highest"))


SEPARATOR = "\x1f"


def event_hash(previous: Column, *fields: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, previous, *(f.cast("string") for f in fields)), 256)


def append_chain(events: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Adds previous_hash and event_hash: each event's hash covers the one before it in its chain.

    Hashes depend on each other in order, so a chain is one sequential fold. Rows come to Python in order
    and in batches, and only the last hash is kept between them; chains run side by side.
    """
    names = [key, order, *dict.fromkeys(f for f in fields if f not in (key, order))]
    texts = [F.col(f).cast("string").alias(f"_{k}") for k, f in enumerate(fields)]
    ordered = events.select(*names, *texts).repartition(F.col(key)).sortWithinPartitions(key, order)
    schema = ordered.select(*names).schema.add("previous_hash", "string").add("event_hash", "string")

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        chain, last = None, ""
        for batch in batches:
            before, after = [], []
            for row in batch[[key, *(f"_{k}" for k in range(len(fields)))]].itertuples(index=False, name=None):
                if row[0] != chain:
                    chain, last = row[0], ""
                before.append(last)
                last = hashlib.sha256(SEPARATOR.join([last, *row[1:]]).encode()).hexdigest()
                after.append(last)
            yield batch[names].assign(previous_hash=before, event_hash=after)

    return ordered.mapInPandas(run, schema)


def verify_chain(chain: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Adds valid: the event's own hash is right and it names the hash before it. No order dependence between rows."""
    before = F.lag("event_hash", 1, "").over(Window.partitionBy(key).orderBy(order))
    right = F.col("event_hash") == event_hash(F.col("previous_hash"), *(F.col(f) for f in fields))
    return chain.withColumn("valid", right & (F.col("previous_hash") == before))


#: Failures in a row that open a breaker, and seconds until it lets one call through.
FAILURES, OPEN_SECONDS = 3, 60.0


def breaker_step(state: tuple[str, int, float], at: float, ok: bool) -> tuple[tuple[str, int, float], bool]:
    """(state, whether the call was let through) after a call at this second. State: name, failures, opened at."""
    name, failures, opened = state
    if name == "open" and at - opened < OPEN_SECONDS:
        return state, False
    if ok:
        return ("closed", 0, 0.0), True
    failures += 1
    if name == "open" or failures >= FAILURES:
        return ("open", failures, at), True
    return ("closed", failures, 0.0), True


def breaker(calls: DataFrame, key: str, order: str, ts: str, ok: str) -> DataFrame:
    """(key, order, state, allowed, failures) after each call, for each key's calls in order.

    The state after a call depends on the one before it: rows come in order and in batches.
    """
    rows = calls.select(key, order, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_at"), F.col(ok).alias("_ok")).repartition(F.col(key)).sortWithinPartitions(key, order)
    schema = rows.select(key, order).schema.add("state", "string").add("allowed", "boolean").add("failures", "integer")

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        current, state = None, ("closed", 0, 0.0)
        for batch in batches:
            out = []
            for who, at, fine in zip(batch[key], batch["_at"], batch["_ok"], strict=True):
                if who != current:
                    current, state = who, ("closed", 0, 0.0)
                state, allowed = breaker_step(state, at, bool(fine))
                out.append((state[0], allowed, state[1]))
            yield batch[[key, order]].assign(state=[x[0] for x in out], allowed=[x[1] for x in out], failures=[x[2] for x in out])

    return rows.mapInPandas(run, schema)


def batch_report(rows: DataFrame, *groups: str) -> DataFrame:
    """Of (name, ok): how many went well and not, and the first ten failures by name."""
    failed = F.when(~F.col("ok"), F.col("name"))
    return rows.groupBy(*groups).agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.array_join(F.slice(F.array_sort(F.collect_set(failed)), 1, 10), ", ").alias("first_failures"))


def percent(done: Column, total: Column) -> Column:
    return F.when(total <= 0, 0).otherwise(F.bround(F.lit(100) * done / F.nullif(total, F.lit(0)))).cast("int")


def workers(files: Column, cpus: Column, free_bytes: Column) -> Column:
    """As many as there are files, processors and gibibytes, four at most and one at least."""
    return F.greatest(F.lit(1), F.least(files, F.lit(4), cpus, F.floor(free_bytes / (1 << 30)))).cast("int")


#: Limits of one document: pages, bytes, images, seconds, memory in MiB.
LIMITS = {"pages": 1000, "bytes": 512 << 20, "images": 25_000, "seconds": 1800, "rss_mb": 1536}


def over_limits(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds exceeded, the names of the limits that a row breaks."""
    return rows.withColumn("exceeded", F.filter(F.array(*(F.when(F.col(c) > LIMITS[name], name) for name, c in columns.items())), lambda x: x.isNotNull()))


def waits(base: float, factor: float, attempts: int, deadline: Column) -> Column:
    """The seconds waited before each attempt after the first, as long as all waits together stay within the deadline."""
    steps = [base * factor**k for k in range(attempts - 1)]
    sums = [sum(steps[: k + 1]) for k in range(len(steps))]
    each = F.array(*(F.struct(F.lit(w).alias("wait"), F.lit(s).alias("sum")) for w, s in zip(steps, sums, strict=True))).cast("array<struct<wait:double,sum:double>>")
    return F.transform(F.filter(each, lambda x: x["sum"] <= deadline), lambda x: x["wait"])


def batch_state(states: Column) -> Column:
    """A batch's state from an array of its active files': paused only if all are, the worst of the others else."""
    order = ("failed", "cancelling", "running", "queued")
    out = F.lit("idle")
    for name in reversed(order):
        out = F.when(F.array_contains(states, name), name).otherwise(out)
    return F.when((F.size(states) > 0) & F.forall(states, lambda x: x == "paused"), "paused").otherwise(out)


def page_problem_counts(pages: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, problem_documents, problem_pages, review_documents, review_pages) of pages of (batch, name, page, status, review).

    A page is a problem if it failed; review says that it should be read again by a person. A document with several such pages
    counts once, a page once however often it was tried. Batches without any have zeros.
    """
    tried = pages.groupBy(batch, "name", "page").agg(F.bool_or(F.col("status") == "failed").alias("failed"), F.bool_or("review").alias("review"))
    by_document = tried.groupBy(batch, "name").agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(c) for c in ("failed", "review")))
    return by_document.groupBy(batch).agg(
        F.count_if(F.col("failed") > 0).alias("problem_documents"), F.sum("failed").alias("problem_pages"), F.count_if(F.col("review") > 0).alias("review_documents"), F.sum("review").alias("review_pages")
    )


def retried_pages(pages: DataFrame, selected: DataFrame, again: DataFrame) -> DataFrame:
    """Pages of (name, page, status, text) after the selected ones of (name, page) were read again, and how they ended.

    A selected page takes what again has for it, if that was read; one that failed again, or isn't there, stays as it was. Pages
    that weren't selected stay, whatever again has for them. attempt is 2 for a page that was replaced, else 1.
    """
    second = again.join(selected.select("name", "page").distinct(), ["name", "page"], "left_semi").where(F.col("status").isNotNull() & (F.col("status") != "failed"))
    newest = second.groupBy("name", "page").agg(F.max(F.struct("status", "text")).alias("_second"))
    joined = pages.join(newest, ["name", "page"], "left")
    done = F.col("_second").isNotNull()
    return joined.select("name", "page", F.when(done, F.col("_second.status")).otherwise(F.col("status")).alias("status"), F.when(done, F.col("_second.text")).otherwise(F.col("text")).alias("text"), F.when(done, 2).otherwise(1).alias("attempt"))
