"""Licence and customer analytics: states, the search language, paging, dashboards, revisions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions.text import strip_accents, strip_accents_py

#: Days before the end in which a licence counts as expiring.
EXPIRING_DAYS = 30

# Words of the search language.
STATUS_WORDS = {
    "valid": ("valida", "ativa", "valid"),
    "expiring": ("expirando", "a_vencer"),
    "expired": ("expirada", "expired"),
}


def add_months(ts: Column, months: Column) -> Column:
    """So many calendar months later; a day that the month lacks becomes its last."""
    return ts + F.make_ym_interval(F.lit(0), months)


def within(expires: Column, now: Column, days: int) -> Column:
    return (expires > now) & (expires <= now + F.make_dt_interval(F.lit(days)))


def status_filter(expires: Column, now: Column, status: str) -> Column:
    if status == "valid":
        return expires > now + F.make_dt_interval(F.lit(EXPIRING_DAYS))
    return within(expires, now, EXPIRING_DAYS) if status == "expiring" else expires <= now


def status_of(expires: Column, now: Column) -> Column:
    return F.when(expires <= now, "expired").when(within(expires, now, EXPIRING_DAYS), "expiring").otherwise("valid")


def status_by_whole_days(expires: Column, now: Column) -> Column:
    """The status of one licence's page: remaining whole days, so that a part of the 31st day still counts as expiring."""
    left = F.unix_micros(expires.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    return F.when(left <= 0, "expired").when(F.floor(left / 86_400_000_000) <= EXPIRING_DAYS, "expiring").otherwise("valid")


def days_remaining(expires: Column, now: Column) -> Column:
    left = F.unix_micros(expires.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    return F.greatest(F.lit(1), F.ceil(left / 86_400_000_000))


def evaluate(licences: DataFrame, now: Column, machine: Column, tampered: Column) -> DataFrame:
    """Adds state and days_remaining. The first case that holds decides: machine, clock, start, end, days left."""
    days = days_remaining(F.col("expires_at"), now)
    state = (
        F.when(F.upper(F.trim(machine)) != F.col("machine_id"), "machine_mismatch")
        .when(tampered, "clock_tampered")
        .when(now < F.col("not_before"), "invalid")
        .when(now >= F.col("expires_at"), "expired")
        .when(days <= EXPIRING_DAYS, "expiring")
        .otherwise("valid")
    )
    out = licences.withColumn("state", state)
    left = F.when(F.col("state") == "expired", 0).when(F.col("state").isin("expiring", "valid"), days)
    return out.withColumn("days_remaining", left.cast("long"))


def parse_search(text: str, now: Column) -> Column | None:
    """The filter that a search says, on (license_id, machine_id, normalized_name, customer_reference, expires_at).

    Terms are joined by "and". None for an empty search, which finds nothing. ValueError for a status or
    period that the language lacks. Wildcards of LIKE in a term keep their meaning.
    """
    terms = text.split()
    if not terms:
        return None
    parts: list[Column] = []
    free: list[str] = []
    for term in terms:
        key, colon, value = term.partition(":")
        kind = f"{key.casefold()}{colon}"
        if kind == "status:":
            status = next((s for s, words in STATUS_WORDS.items() if value.casefold() in words), None)
            if status is None:
                raise ValueError("unknown status")
            parts.append(status_filter(F.col("expires_at"), now, status))
        elif kind == "maquina:":
            parts.append(F.col("machine_id").ilike(f"%{value.upper()}%"))
        elif kind == "cliente:":
            parts.append(F.col("normalized_name").ilike(f"%{normalized_name(value)}%"))
        elif kind == "expira:" and value.casefold().endswith("d"):
            if not re.fullmatch(r"[+-]?\d+", value[:-1]) or not 0 <= int(value[:-1]) <= 3650:
                raise ValueError("the period must look like expira:30d")
            parts.append(within(F.col("expires_at"), now, int(value[:-1])))
        else:
            free.append(term)
    if free:
        pattern = f"%{normalized_name(' '.join(free))}%"
        columns = ("license_id", "normalized_name", "machine_id", "customer_reference")
        parts.append(reduce(lambda a, b: a | b, (F.lower(c).ilike(pattern) for c in columns)))
    return reduce(lambda a, b: a & b, parts)


def normalized_name(name: str) -> str:
    return " ".join(strip_accents_py(name).casefold().split())


def normalized_name_column(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_accents(name)), r"\s+", " "))


def search(licences: DataFrame, text: str, now: Column, page: int = 1, page_size: int = 25) -> tuple[DataFrame, DataFrame]:
    """(the page of rows by end and id, the total as one row)."""
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("no such page")
    found = licences.where(F.lit(False) if (where := parse_search(text, now)) is None else where)
    rows = found.select("license_id", "customer_name", "machine_id", "expires_at", "current_revision", status_of(F.col("expires_at"), now).alias("effective_status"))
    return rows.orderBy("expires_at", "license_id").offset((page - 1) * page_size).limit(page_size), found.agg(F.count("*").alias("total"))


def dashboard(licences: DataFrame, now: Column) -> DataFrame:
    counts = (F.count_if(status_filter(F.col("expires_at"), now, s)).alias(s) for s in ("valid", "expiring", "expired"))
    return licences.agg(*counts)


def latest_revision(licences: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each licence with the revision that it names as current."""
    return licences.join(revisions, (revisions.license_id == licences.license_id) & (revisions.revision == licences.current_revision)).drop(revisions.license_id)


def newest(revisions: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest order value of each key; one partial aggregate, no window."""
    names = [c for c in revisions.columns if c != key]
    return revisions.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("row")).select(key, "row.*")


def with_revision(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("revision", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("int"))


def next_number(ids: Column, prefix: str) -> Column:
    """One more than the largest number behind the prefix; 1 without any. An aggregate."""
    return F.coalesce(F.max(F.when(ids.startswith(prefix), F.substring(ids, len(prefix) + 1, 20).try_cast("long"))), F.lit(0)) + 1


def payload_problems(rows: DataFrame) -> DataFrame:
    """Adds problems, an array of what a payload's checks find; empty if it is sound."""
    checks = {
        "license_id": ~F.col("license_id").rlike(r"^LIC-[0-9]{4,}$"),
        "machine_id": ~F.col("machine_id").rlike(r"^[A-F0-9]{4}(-[A-F0-9]{4}){3}$"),
        "dates": ~(F.col("not_before") < F.col("expires_at")),
        "revision": F.col("current_revision") < 1,
        "term": ~F.col("term_months").isin(3, 6, 12),
        "features": F.col("features") != F.array_sort(F.array_distinct("features")),
    }
    found = F.array(*(F.when(bad, name) for name, bad in checks.items()))
    return rows.withColumn("problems", F.filter(found, lambda x: x.isNotNull()))


def may_use(state: Column, features: Column, feature: str) -> Column:
    """"ok", or why a feature can't be used: the state if that isn't usable, else the missing feature."""
    usable = state.isin("valid", "expiring")
    return F.when(~usable, state).when(~F.array_contains(features, feature), "feature_missing").otherwise("ok")
