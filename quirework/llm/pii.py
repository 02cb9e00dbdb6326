"""Personal data: patterns for the plain forms, and a skip-chain conditional random field for the others.

Every match of a base pattern is a node with a known label. Other mentions that look like a number,
an address or a network address are nodes with an unknown label. Neighbouring nodes share a chain
potential, and mentions whose normalised forms are equal or similar share a skip potential, however
far apart they stand. Loopy message passing then gives every unknown node its label, so that a
number that is written once in full and once in another way is one entity in both places.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import id_and_text, map_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

#: Documents whose mentions the field's weights are fitted on: those with the smallest hash of their id.
FIT_DOCUMENTS = 2000

# The base patterns.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Other mentions: groups of digits, and addresses whose signs are spelled out.
NUMBER = re.compile(r"[+(]?[0-9](?:[\x20()./:_-]{0,3}[0-9]){6,}")
AT_SIGN = re.compile(r"\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20|\x20@\x20?|@\x20|＠|@", re.I)
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]+)+", re.I)
SPELLED_DOT = re.compile(r"\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20", re.I)
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Words before a mention that speak for a kind.
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "login", "from"),
    "card": ("card", "visa", "credit", "payment", "paid", "mastercard"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "telephone"),
}
CHAIN_REACH = 60
ROUNDS, DAMPING = 25, 0.5
#: A mention that every base pattern has tested and passed over is nothing by this much in log odds, and
#: its own features change that by so much at most: only a similar mention of a known kind outweighs it.
PASSED_OVER, FEATURES_AT_MOST = 4.0, 2.5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _local_start(text: str, at: int, floor: int) -> int:
    """Where the run of local-part characters before this place begins, not before floor."""
    width = 64
    while True:
        low = max(floor, at - width)
        part = text[low:at]
        run = len(part) - len(part.rstrip(LOCAL))
        if run < len(part) or low == floor:
            return at - run
        width *= 4


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The matches of the base patterns; those that fail the further tests are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            if (start := _local_start(text, m.start(), last)) < m.start():
                found["email"].append((start, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found["phone"].append(m.span())
    return found


@dataclass
class Node:
    start: int
    end: int
    label: int  # of LABELS; -1: unknown
    key: str
    features: np.ndarray


def _key(text: str) -> str:
    """Equal for mentions of one entity: the address in plain form, or the last eight digits."""
    if sign := AT_SIGN.search(text):
        plain = text[: sign.start()] + "@" + SPELLED_DOT.sub(".", text[sign.end() :])
        return "m" + plain.lower()
    return "d" + NOT_DIGIT.sub("", text)[-8:]


N_FEATURES = 12 + len(KINDS)


def _features(text: str, start: int, end: int) -> np.ndarray:
    mention = text[start:end]
    digits = sum(c.isdigit() for c in mention)
    before = re.findall(r"[A-Za-z-]+", text[max(0, start - 40) : start].lower())[-3:]
    out = np.zeros(N_FEATURES)
    out[0] = 1
    out[1 + min(4, max(0, (digits - 4) // 3))] = 1
    out[6] = mention[0] == "+"
    out[7] = "@" in mention
    out[8] = mention.count(".") == 3
    out[9] = any(c in mention for c in " -")
    out[10] = any(c in mention for c in "()/:_")
    out[11] = any(c.isalpha() for c in mention)
    for k, kind in enumerate(KINDS):
        out[12 + k] = any(w in CUES[kind] for w in before)
    return out


def nodes_of(text: str, base: dict[str, list[tuple[int, int]]]) -> list[Node]:
    """The mentions in order. Unknown ones never overlap a base match or each other."""
    known = sorted((s, e, LABELS.index(kind)) for kind in KINDS for s, e in base[kind])
    spans = [(s, e, -1) for s, e in (m.span() for m in NUMBER.finditer(text)) if len(NOT_DIGIT.sub("", text[s:e])) <= 19]
    last = 0
    for sign in AT_SIGN.finditer(text):
        domain = SPELLED_DOMAIN.match(text, sign.end())
        start = _local_start(text, sign.start(), last)
        if domain and start < sign.start():
            spans.append((start, domain.end(), -1))
            last = domain.end()
    out: list[Node] = []
    reach, k = 0, 0  # reach: the end of all base matches that begin before this place
    for s, e, label in sorted(known + spans, key=lambda x: (x[0], -x[2])):
        if label < 0:
            while k < len(known) and known[k][0] < e:
                reach, k = max(reach, known[k][1]), k + 1
            if reach > s or (out and out[-1].end > s):
                continue
        out.append(Node(s, e, label, _key(text[s:e]), _features(text, s, e)))
    return out


@dataclass(frozen=True)
class Field:
    """weights: features by labels. skip, chain: log factors for equal labels of two nodes."""

    weights: np.ndarray
    skip: float
    chain: float


def default_field() -> Field:
    """Without any base match to learn from: mentions are nothing unless a similar one is known."""
    weights = np.zeros((N_FEATURES, len(LABELS)))
    weights[0, 0] = 2.0
    return Field(weights, 7.0, 0.2)


def edges_of(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, whether it is a skip edge).

    An unknown mention is linked with the known mentions of its key, wherever they stand, and with the
    unknown one of its key before it. Known mentions of one key and label are alike, so one edge to the
    first of them stands for all: marginals() takes it as many times as there are such mentions, and a
    key with many has no quadratic cost.
    """
    a, b, skip = [], [], []
    first: dict[str, dict[int, int]] = {}
    for k, node in enumerate(nodes):
        if node.label >= 0:
            first.setdefault(node.key, {}).setdefault(node.label, k)
    last: dict[str, int] = {}
    for k, node in enumerate(nodes):
        if k and node.start - nodes[k - 1].end <= CHAIN_REACH:
            a.append(k - 1), b.append(k), skip.append(False)
        if node.label < 0:
            for other in [*first.get(node.key, {}).values(), *([last[node.key]] if node.key in last else [])]:
                a.append(min(other, k)), b.append(max(other, k)), skip.append(True)
            last[node.key] = k
    return np.array(a, int), np.array(b, int), np.array(skip, bool)


def marginals(nodes: list[Node], field: Field) -> np.ndarray:
    """Loopy sum-product in logarithms; a row of label probabilities for each node."""
    width = len(LABELS)
    local = np.stack([x.features for x in nodes]) @ field.weights
    local = np.clip(local - local[:, :1], -FEATURES_AT_MOST, FEATURES_AT_MOST) - PASSED_OVER
    local[:, 0] = 0.0
    label = np.array([x.label for x in nodes])
    a, b, skip = edges_of(nodes)
    alike = Counter((x.key, x.label) for x in nodes if x.label >= 0)
    strength = np.where(skip, field.skip, field.chain)
    # A known label is fixed, so its edges only add to the other end, and no number of repeats outvotes it.
    for end, other in ((a, b), (b, a)):
        one = np.flatnonzero((label[end] >= 0) & (label[other] < 0))
        times = [alike[nodes[i].key, nodes[i].label] if s else 1 for i, s in zip(end[one], skip[one], strict=True)]
        np.add.at(local, (other[one], label[end[one]]), strength[one] * times)
    local[label >= 0] = -np.inf
    local[np.flatnonzero(label >= 0), label[label >= 0]] = 0.0
    free = (label[a] < 0) & (label[b] < 0)
    a, b, strength = a[free], b[free], strength[free]
    if len(a):
        tail, head = np.concatenate([a, b]), np.concatenate([b, a])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        same = np.exp(np.tile(strength, 2))[:, None]
        message = np.zeros((len(tail), width))
        for _ in range(ROUNDS):
            belief = local.copy()
            np.add.at(belief, head, message)
            out = belief[tail] - message[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(out.sum(axis=1, keepdims=True) + (same - 1) * out)
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - message).max()
            message = DAMPING * message + (1 - DAMPING) * new
            if change < 1e-4:
                break
        belief = local.copy()
        np.add.at(belief, head, message)
    else:
        belief = local
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find(text: str, field: Field) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """The base matches, and the spans that the field adds to them."""
    base = base_spans(text)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    nodes = nodes_of(text, base)
    if any(x.label < 0 for x in nodes):
        best = marginals(nodes, field).argmax(axis=1)
        for node, label in zip(nodes, best.tolist(), strict=True):
            if node.label < 0 and label:
                added[LABELS[label]].append((node.start, node.end))
    return base, added


def fit(documents: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Field:
    """Weights from the base matches of a bounded sample of documents.

    The matches' kinds are the labels of a multinomial regression on the mentions' features, with
    mentions that no base pattern matches as "none". Pairs of labelled mentions with one key, and
    pairs of neighbours, give the two factors for equal labels. All mentions of the sample count; the
    executors count them by features and label. An empty sample gives fixed weights.
    """
    docs = id_and_text(documents)
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents).distinct()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter[tuple[str, tuple[float, ...], int]] = Counter()
        for text in texts_of(batch.column(1)):
            nodes = nodes_of(text, base_spans(text))
            counts.update(("mention", tuple(x.features.tolist()), max(0, x.label)) for x in nodes)
            last: dict[str, int] = {}
            before = None
            for x in sorted((x for x in nodes if x.label >= 0), key=lambda x: (x.start, x.label)):
                if x.key in last:
                    counts["similar", (), int(last[x.key] == x.label)] += 1
                if before and x.start - before.start <= 2 * CHAIN_REACH:
                    counts["near", (), int(before.label == x.label)] += 1
                last[x.key], before = x.label, x
        kinds = (pa.string(), pa.list_(pa.float64()), pa.int32(), pa.int64())
        columns = list(zip(*((what, list(f), label, n) for (what, f, label), n in counts.items()), strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["what", "features", "label", "n"])

    sample = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text")
    counted = map_batches(sample, run, "what string, features array<double>, label int, n long").groupBy("what", "features", "label").agg(F.sum("n").alias("n"))
    # Features are 0 or 1, so the counts are a few thousand rows at most, whatever the number of mentions.
    rows = sorted(counted.collect())
    mentions = [r for r in rows if r.what == "mention"]
    if not any(r.label for r in mentions):
        return default_field()
    x = np.array([r.features for r in mentions])
    n = np.array([[r.n] for r in mentions], float)
    weights, target = np.zeros((N_FEATURES, len(LABELS))), np.eye(len(LABELS))[[r.label for r in mentions]]
    for _ in range(400):
        p = x @ weights
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights -= 0.5 * (x.T @ (n * (p - target)) / n.sum() + 2e-2 * weights)

    def factor(what: str, most: float) -> float:
        of = {r.label: r.n for r in rows if r.what == what}
        return float(np.clip(np.log((of.get(1, 0) + 1) * (len(LABELS) - 1) / (of.get(0, 0) + 1)), 0.1, most))

    # Equal forms always get equal labels from the patterns, so their factor has a floor even in small samples.
    return Field(weights, max(7.0, factor("similar", 9.0)), factor("near", 0.5))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def detect(documents: DataFrame, field: Field) -> DataFrame:
    """(doc_id, spans) of each row of (doc_id, text): base spans and added ones, by kind and then start.

    Places count code points, the end is exclusive. A null text counts as empty and has no spans.
    Rows stay as they are, repeated ones too; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = []
        for text in texts_of(batch.column(1)):
            base, added = find(text, field)
            spans.append([{"kind": kind, "start": s, "end": e, "base": is_base} for kind in KINDS for s, e, is_base in sorted([(*x, True) for x in base[kind]] + [(*x, False) for x in added[kind]])])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return map_batches(id_and_text(documents), run, f"doc_id long, spans {SPANS}")


def mask(text: str, field: Field) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    base, added = find(text, field)
    out, last = [], 0
    for s, e, kind in sorted((s, -e, kind) for found in (base, added) for kind, spans in found.items() for s, e in spans):
        if s >= last:
            out += [text[last:s], f"<{kind.upper()}>"]
        elif -e > last:
            pass  # the rest of a span that overlaps the one before goes with it
        last = max(last, -e)
    return "".join(out) + text[last:] if out else text


def redact(documents: DataFrame, field: Field) -> DataFrame:
    """Rows of the documents' columns with the personal data in text masked and n_chars counted anew.

    A null text stays null. Other columns pass through as they are.
    """
    names = documents.columns
    at_text, at_count = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        texts = [None if t is None else mask(t, field) for t in columns[at_text].to_pylist()]
        columns[at_text] = pa.array(texts, columns[at_text].type)
        if at_count >= 0:
            columns[at_count] = pa.array([None if t is None else len(t) for t in texts], columns[at_count].type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_batches(documents, run, documents.schema)
