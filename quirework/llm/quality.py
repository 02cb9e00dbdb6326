"""Quality by hierarchical empirical Bayes: a document classifier's evidence with posteriors of its site.

Boosted trees on dense features give each text a calibrated probability of being good. Grouped sums of
labels, and of these probabilities where there are no labels, give a posterior for each host and for
each path of a host. A path is shrunk toward its host and a host toward the whole corpus, by
strengths that follow from how much the sites differ, so a sparse site stays near the global rate.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm import boost
from quirework.llm.chunks import Properties
from quirework.llm.common import checkpointed, id_and_text, map_batches, only_cache, small, texts_of
from quirework.llm.toxicity import held_out
from quirework.llm.urls import host_of, path_of

#: Labelled rows that the document classifier is fitted on: those with the smallest hash of their id.
FIT_ROWS = 12_000
#: What a row without a label counts toward its site's posterior, next to 1 for a label.
SOFT_WEIGHT = 0.25
#: How much of a site's log odds against the global rate goes into a document's.
SITE_WEIGHT = 0.5
#: A classifier's probability counts as no surer than this.
SUREST = 0.995
#: Documents are kept from this score on.
THRESHOLD = 0.5
#: Strengths of the shrinkage stay in these bounds, in rows.
STRENGTHS = (2.0, 1000.0)
#: Salts that the rows of one site are dealt over when posteriors are joined to them.
SALTS = 32

SIGNS = re.compile(r"([^\w\s])\1\1$")
WIDTH, N_FEATURES = 9, 18


def properties(chunk: str) -> tuple[float, ...]:
    letters = sum(c.isalpha() for c in chunk)
    upper = sum(c.isupper() for c in chunk)
    return (
        float(len(chunk)),
        float(letters),
        float(upper),
        float(upper == letters and letters > 1),
        float(SIGNS.search(chunk) is not None),
        float(letters == 0),
        float(sum(c.isdigit() for c in chunk)),
        float(len(chunk) <= 3 and letters == len(chunk)),
        float(chunk[-1] in ".,;:?!" and SIGNS.search(chunk) is None),
    )


_PROPERTIES = Properties(WIDTH, properties)


def features(text: str) -> np.ndarray:
    """Dense features of a whole text; zeros for one without words."""
    chunks = text.split()
    n = len(chunks)
    if not n:
        return np.zeros(N_FEATURES)
    size, letters, upper, caps, signs, empty, digits, short, stops = _PROPERTIES(chunks).sum(axis=0, dtype=np.float64)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = set(lines)
    return np.array([
        math.log1p(n), size / n, letters / size, upper / max(1.0, letters), caps / n, signs / n, empty / n, digits / size, short / n, stops / n,
        text.count("!") / n, text.count("|") / n, text.count("#") / n, len(set(chunks)) / n, len(lines) / n, 1 - len(distinct) / len(lines),
        sum(x.isupper() for x in lines) / len(lines), 1 - sum(map(len, distinct)) / sum(map(len, lines)),
    ])


def _matrix(texts: list[str]) -> np.ndarray:
    only_cache("quality", _PROPERTIES.clear)
    return np.stack([features(t) for t in texts])


def _labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y), one row an id; an id labelled more than once has its labels' mean, rounded down."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.floor(F.avg("quality")).cast("int").alias("y"))


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> boost.Model:
    """The document classifier, from labels.quality of a bounded sample of rows, none of them held out.

    Of rows that repeat an id one is learned from. Without labels of both kinds it gives every text
    the share of good rows.
    """
    chosen = _labels(labels).where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = id_and_text(documents).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(texts_of(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    one = map_batches(sample, run, "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("row"))
    rows = sorted(tuple(r) for r in one.select("doc_id", "row.*").collect())
    x = np.array([r[2] for r in rows]).reshape(-1, N_FEATURES)
    return boost.fit(x, np.array([r[1] for r in rows], int), np.arange(len(rows)) % 4 == 3)


def sites_of(pages: DataFrame) -> DataFrame:
    """(doc_id, host, path) of the documents that the urls of (url) name by the number that ends their path.

    path is the first segment of the url's path. Of several pages the first by host and path counts.
    """
    path = path_of(F.col("url"))
    number = F.regexp_extract(path, "([0-9]+)[^/0-9]*/?$", 1).try_cast("long")
    named = pages.select(number.alias("doc_id"), F.struct(host_of(F.col("url")).alias("host"), F.regexp_extract(path, "^/([^/]+)/", 1).alias("path")).alias("site")).where("doc_id is not null")
    return named.groupBy("doc_id").agg(F.min("site").alias("site")).select("doc_id", "site.*")


def classify(documents: DataFrame, model: boost.Model, sites: DataFrame | None = None) -> DataFrame:
    """(doc_id, host, path, p_doc, mark) of each row; mark is a hash of what the row is judged by.

    Host and path are those of sites, (doc_id, host, path), and where it has none the source and the
    language within it; nulls stay.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "host", "path", _mark("text", "host", "path").alias("mark"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = np.clip(model.probability(_matrix(texts_of(batch.column(4)))), 1 - SUREST, SUREST)
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(p, pa.float64())], ["doc_id", "host", "path", "mark", "p_doc"])

    out = map_batches(rows, run, "doc_id long, host string, path string, mark long, p_doc double")
    if sites is None:
        return out
    named = sites.select("doc_id", F.struct("host", "path").alias("site"))
    at = F.coalesce("site", F.struct("host", "path"))
    return out.join(named, "doc_id", "left").select("doc_id", at["host"].alias("host"), at["path"].alias("path"), "mark", "p_doc")


def _mark(*columns: str) -> F.Column:
    return F.xxhash64(*(F.struct(F.col(c).cast("string")) for c in columns))


@dataclass(frozen=True)
class Prior:
    """rate: of good rows in the corpus. host, path: strengths of the shrinkage toward the level above."""

    rate: float
    host: float
    path: float


def _strength(rate: float, within: float | None, between: float | None) -> float:
    """The beta prior's size whose variance is what the groups' variance exceeds sampling by (method of moments)."""
    excess = (between or 0.0) - (within or 0.0)
    if excess <= 0:
        return STRENGTHS[1]
    return min(STRENGTHS[1], max(STRENGTHS[0], rate * (1 - rate) / excess - 1))


def _evidence() -> tuple[F.Column, F.Column]:
    """What a row of (y, p_doc) counts in its site, and how much of it is good."""
    weight = F.when(F.col("y").isNotNull(), 1.0).otherwise(SOFT_WEIGHT)
    return weight, F.coalesce(F.col("y").cast("double"), F.col("p_doc")) * weight


def posteriors(rows: DataFrame) -> tuple[DataFrame, Prior]:
    """(host, path, n, good, n_host, good_host, p_host, p_path) of each site of (host, path, y, p_doc), and the prior they were shrunk with.

    Sums are partial before any shuffle, so a source with a third of all rows is one row a task.
    """
    weight, good = _evidence()
    paths = checkpointed(rows.groupBy("host", "path").agg(F.sum(weight).alias("n"), F.sum(good).alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), F.sum("good").alias("good_host"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = (total.good + 1) / (total.n + 2) if total.n else 0.5

    def moments(groups: DataFrame, n: str, good: str, mean: F.Column) -> tuple[float | None, float | None]:
        share = F.col(good) / F.col(n)
        r = groups.agg((F.sum(F.col(n) * (share - mean) ** 2) / F.sum(n)).alias("between"), (F.sum(mean * (1 - mean)) / F.sum(n)).alias("within")).first()
        return r.within, r.between

    of_host = _strength(rate, *moments(hosts, "n_host", "good_host", F.lit(rate)))
    hosts = hosts.withColumn("p_host", (F.col("good_host") + of_host * rate) / (F.col("n_host") + of_host))
    sites = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).drop(hosts.host)
    of_path = _strength(rate, *moments(sites, "n", "good", F.col("p_host")))
    sites = sites.withColumn("p_path", (F.col("good") + of_path * F.col("p_host")) / (F.col("n") + of_path))
    return sites.select("host", "path", "n", "good", "n_host", "good_host", "p_host", "p_path"), Prior(rate, of_host, of_path)


def _scored(documents: DataFrame, labels: DataFrame, model: boost.Model, sites: DataFrame | None) -> DataFrame:
    classified = checkpointed(classify(documents, model, sites).join(_labels(labels), "doc_id", "left"))
    found, prior = posteriors(classified)
    rows = classified.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)).cast("int"))
    found = found.drop("p_host", "p_path").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"host": "of_host", "path": "of_path"})
    near = F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")) & (rows.salt == found.salt)
    weight, good = _evidence()
    out = rows.join(found, near).withColumn("own", weight).withColumn("own_good", good)
    # What the row itself counts in its site is taken off, so that no label speaks for its own row.
    out = out.withColumn("p_host", (F.greatest(F.lit(0.0), F.col("good_host") - F.col("own_good")) + prior.host * prior.rate) / (F.greatest(F.lit(0.0), F.col("n_host") - F.col("own")) + prior.host))
    out = out.withColumn("p_path", (F.greatest(F.lit(0.0), F.col("good") - F.col("own_good")) + prior.path * F.col("p_host")) / (F.greatest(F.lit(0.0), F.col("n") - F.col("own")) + prior.path))
    odds = lambda p: F.log(p / (1 - p))
    sure = F.least(F.greatest(F.col("p_path"), F.lit(1e-6)), F.lit(1 - 1e-6))
    log_odds = odds(F.col("p_doc")) + SITE_WEIGHT * (odds(sure) - math.log(prior.rate / (1 - prior.rate)))
    return out.withColumn("score", 1 / (1 + F.exp(-log_odds))).withColumn("keep", F.col("score") >= THRESHOLD)


def score(documents: DataFrame, labels: DataFrame, model: boost.Model, sites: DataFrame | None = None) -> DataFrame:
    """(doc_id, host, path, p_doc, p_host, p_path, score, keep) of each row of the documents.

    sites gives hosts and paths by doc_id; elsewhere the source is the host and the language the path.
    p_host and p_path leave out the row's own label. A null or empty text is judged by its (zero)
    features, a null host or path is a site of its own. Rows stay as they are, repeated ones too; an
    empty table gives no rows; other columns are not read.
    """
    return _scored(documents, labels, model, sites).select("doc_id", "host", "path", "p_doc", "p_host", "p_path", "score", "keep")


def keep_good(documents: DataFrame, labels: DataFrame, model: boost.Model, sites: DataFrame | None = None) -> DataFrame:
    """The documents that the score keeps, with all their columns, whatever their names.

    Rows that repeat an id are each judged by their own text and site; rows without an id stay; an
    empty table gives no rows.
    """
    gone = small(_scored(documents, labels, model, sites).where("not keep and doc_id is not null").select("doc_id", "mark").distinct())
    own = [documents[c].cast("string") for c in ("text", "source", "lang")]
    mark = F.xxhash64(*(F.struct(c) for c in own))
    return documents.join(gone, (documents["doc_id"].cast("long") == gone["doc_id"]) & (mark == gone["mark"]), "left_anti").select(*documents.columns)
