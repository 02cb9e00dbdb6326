"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a lexicon, closeness to the second person, capitals, punctuation and
obfuscation. The lexicon holds words and parts of words that are far more frequent in texts labelled
toxic than in the others, next to a short fixed list.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm import boost
from quirework.llm.chunks import CHUNKS_KEPT, Properties
from quirework.llm.common import id_and_text, map_batches, only_cache, texts_of

#: Labelled rows that the model is fitted on: those with the smallest hash of their id.
FIT_ROWS = 12_000
#: A document counts as toxic from this score on.
THRESHOLD = 0.3

# Fixed values.
SEED_WORDS = frozenset("idiot idiots moron stupid dumb loser trash scum pathetic worthless disgusting clown shit fuck fucking bitch bastard asshole".split())
SECOND_PERSON = frozenset("you your yours yourself u ur youre du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
LEET = str.maketrans("0134578@$€", "oieastbase")

#: Evidence in nats that an entry of the lexicon needs, and the least share of toxic texts among those that hold it.
LEAST_EVIDENCE, LEAST_SHARE = 12.0, 0.6
LEXICON_SIZE = 3000
#: Parts of the sample; each has its features from a lexicon of the others.
FOLDS = 4
PARTS = (4, 5, 6)
NEAR = 5
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’¿¡…–—"
INNER = re.compile(r"[^\W\d_][*.\-_@$0-9]+[^\W\d_]")
RUN = re.compile(r"(\w)\1\1")


def plain(chunk: str) -> str:
    """The word that a chunk spells: lower case, digits and signs that stand for letters read as those, signs within it gone."""
    word = chunk.strip(EDGES).lower()
    if word.isalpha() or not word:
        return word
    if not any(c.isalpha() for c in word):
        return ""
    return "".join(c for c in word.translate(LEET) if c.isalpha())


def parts(word: str) -> list[str]:
    """The word itself, its first and its last letters."""
    out = [f"={word}"]
    for n in PARTS:
        if len(word) > n:
            out += [f"^{word[:n]}", f"${word[-n:]}"]
    return out


def properties(chunk: str, lexicon: dict[str, float]) -> tuple[float, ...]:
    word = plain(chunk)
    score = max((lexicon.get(p, 0.0) for p in parts(word)), default=0.0) if word else 0.0
    letters = sum(c.isalpha() for c in chunk)
    upper = sum(c.isupper() for c in chunk)
    marks = sum(unicodedata.category(c)[0] in "PS" for c in chunk)
    return (
        score,
        float(score > 0),
        float(word in SEED_WORDS),
        float(word in SECOND_PERSON),
        float(upper == letters and letters > 1),
        float(upper),
        float(letters),
        float(chunk.count("!")),
        float(marks),
        float(INNER.search(chunk) is not None),
        float(RUN.search(chunk) is not None),
        float(chunk.isdigit()),
    )


@dataclass
class Toxicity:
    lexicon: dict[str, float]
    model: boost.Model

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.model.probability(_matrix(texts, self.lexicon))


def features(rows: np.ndarray) -> np.ndarray:
    """Dense features of a text from the properties of its chunks; zeros for a text without any."""
    n = len(rows)
    if not n:
        return np.zeros(N_FEATURES)
    total = rows.sum(axis=0, dtype=np.float64)
    score, hits, seeds, second, caps, upper, letters, shouts, marks, obfuscated, runs, numbers = total
    near = 0.0
    if hits and second:
        said = np.flatnonzero(rows[:, 3])
        for k in np.flatnonzero(rows[:, 1]):
            at = np.searchsorted(said, k)
            near += (at < len(said) and said[at] - k <= NEAR) or (at > 0 and k - said[at - 1] <= NEAR)
    return np.array([
        math.log1p(n), hits / n, math.log1p(hits), score / n, float(rows[:, 0].max()), seeds / n, math.log1p(seeds), second / n, near / n, near / max(1.0, hits),
        caps / n, upper / max(1.0, letters), shouts / n, marks / n, obfuscated / n, runs / n, numbers / n,
    ])


N_FEATURES = 17

_PROPERTIES: dict[int, tuple[dict[str, float], Properties]] = {}


def _matrix(texts: list[str], lexicon: dict[str, float], slot: int = 0) -> np.ndarray:
    """Features of each text. A worker keeps the properties for the last lexicon that it saw in a slot."""
    only_cache("toxicity", _PROPERTIES.clear)
    kept = _PROPERTIES.get(slot)
    if kept is None or kept[0] != lexicon:
        kept = _PROPERTIES[slot] = (lexicon, Properties(12, lambda chunk: properties(chunk, lexicon), CHUNKS_KEPT // (1 if slot == 0 else FOLDS)))
    return np.stack([features(kept[1](t.split())) for t in texts])


def held_out(id_column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_column).cast("string")) % 4 == 2


def _sample(documents: DataFrame, labels: DataFrame, label: str, fit_rows: int) -> DataFrame:
    """(doc_id, text, y, fold) of the bounded sample of labelled rows that may be learned from; equal texts share a fold."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = id_and_text(documents).join(F.broadcast(chosen), "doc_id")
    return rows.select("doc_id", "text", "y", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Words and parts of words by their log odds; each text counts once for each.

    The first lexicon is of the whole sample. Then comes one for each fold, from the other folds, so
    that a model is fitted on features of texts that their lexicon has not seen.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for text, y, fold in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = {w for c in set(text.split()) if (w := plain(c))}
            seen.update((p, fold, y > 0) for p in {p for w in words for p in parts(w)})
        columns = list(zip(*((p, fold, n if toxic else 0, 0 if toxic else n) for (p, fold, toxic), n in seen.items()), strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["part", "fold", "toxic", "other"])

    sums = lambda c: [F.sum(c), *(F.coalesce(F.sum(F.when(F.col("fold") != f, F.col(c))), F.lit(0)) for f in range(FOLDS))]
    totals = sample.select((F.col("y") > 0).cast("int").alias("toxic"), (F.col("y") <= 0).cast("int").alias("other"), "fold").agg(*(c.alias(f"{n}{k}") for n in ("toxic", "other") for k, c in enumerate(sums(n)))).first()
    counts = map_batches(sample, run, "part string, fold int, toxic long, other long").groupBy("part").agg(*(c.alias(f"{n}{k}") for n in ("toxic", "other") for k, c in enumerate(sums(n))))
    counts = counts.where(F.col("toxic0") >= LEAST_SHARE * (F.col("toxic0") + F.col("other0")) * 0.9).cache()
    out = []
    for k in range(FOLDS + 1):
        toxic, other = totals[f"toxic{k}"] or 0, totals[f"other{k}"] or 0
        if not toxic or not other:
            out.append({})
            continue
        rate = toxic / (toxic + other)
        a, b = F.col(f"toxic{k}"), F.col(f"other{k}")
        share = F.try_divide(a, a + b)
        evidence = a * F.log(share / rate) + F.when(b > 0, b * F.log((1 - share) / (1 - rate))).otherwise(0.0)
        found = counts.where(share >= LEAST_SHARE).withColumn("evidence", evidence).where(F.col("evidence") >= LEAST_EVIDENCE)
        best = found.orderBy(F.desc("evidence"), "part").limit(LEXICON_SIZE).select("part", a.alias("a"), b.alias("b")).collect()
        out.append({r.part: math.log((r.a + 0.5) / (r.b + 0.5) * (1 - rate) / rate) for r in best})
    counts.unpersist()
    return out


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Toxicity:
    """A model from labels.toxic of a bounded sample of rows, none of them held out.

    A document labelled more than once counts as toxic if any label says so. Without labels of both
    kinds the model gives every text the share of toxic rows (with half a row of either kind added).
    """
    sample = _sample(documents, labels, "toxic", fit_rows)
    lexicon, *others = learn_lexicons(sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        folds, texts = batch.column(3).to_numpy(), np.array(texts_of(batch.column(1)), object)
        x = np.zeros((len(texts), N_FEATURES))
        for f in np.unique(folds).tolist():
            x[folds == f] = _matrix(texts[folds == f].tolist(), others[f], f + 1)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    one = map_batches(sample, run, "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("row"))
    rows = sorted(tuple(r) for r in one.select("doc_id", "row.*").collect())
    x = np.array([r[2] for r in rows]).reshape(-1, N_FEATURES)
    return Toxicity(lexicon, boost.fit(x, np.array([r[1] for r in rows], int), np.arange(len(rows)) % 4 == 3))


def score(documents: DataFrame, toxicity: Toxicity) -> DataFrame:
    """(doc_id, score, predicted) of each row of (doc_id, text), from the whole text alone.

    A null text counts as empty. Rows stay as they are, repeated ones too; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = toxicity.scores(texts_of(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(id_and_text(documents), run, "doc_id long, score double, predicted int")


def keep_clean(documents: DataFrame, toxicity: Toxicity) -> DataFrame:
    """The documents whose score stays under the threshold, with all their columns, whatever their names.

    Each row is judged by its own text alone, rows that repeat an id and those without one too. A null text
    counts as empty. An empty table gives no rows.
    """
    at_text = documents.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = toxicity.scores(texts_of(batch.column(at_text)))
        return batch.filter(pa.array(p < THRESHOLD))

    return map_batches(documents, run, documents.schema)
