"""Spelling variants, filter interactions and licence scans against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import audit, license_scan, variants

DOCS = "doc_id long, text string, source string, word string, n long, mask int, part string"


def frame(spark, rows):
    """Documents with further columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(d, t, s, "x", 7, 3, "q") for d, t, s in rows], DOCS)


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_vocabulary(rows, dropped):
    n = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lowered(text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if dropped and h % dropped == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (n[w], form[w], form[w] and n[form[w]], len(near[w]), root(w)) for w in n}


def found(words):
    return {r.word: (r.n, r.form, r.form_n, r.n_near, r.root) for r in words.collect()}


@pytest.mark.parametrize(("seed", "dropped"), [(1, 97), (2, 3), (3, None)])
def test_variants_equal_brute_force(spark, seed, dropped):
    random_ = random.Random(seed)
    letters = "abcéÀ×ÿD"
    stems = ["".join(random_.choice(letters) for _ in range(random_.choice((5, 6, 7, 12)))) for _ in range(25)]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(40):
            w = random_.choice(stems[: random_.choice((3, 25))])
            for _ in range(random_.choice((0, 0, 0, 1, 2))):
                k = random_.randrange(len(w))
                w = random_.choice((w[:k] + w[k + 1 :], w[:k] + random_.choice(letters) + w[k:], w[:k] + random_.choice(letters) + w[k + 1 :]))
            words += [w] * random_.choice((1, 1, 3))
        rows.append((random_.choice((doc, 7, None)), random_.choice((" ", "-", "1", "ā")).join(words), "s"))
    rows += [(90, None, None), (91, "", "s"), (92, "x" * 50_000 + " " + "x" * 49_999, "s")] + [(93, "x" * 50_000, "s")] * 3 + [(94, "x" * 49_999, None)] * 2
    expected = brute_groups(brute_vocabulary(rows, dropped))
    assert sum(v[1] is not None for v in expected.values()) > 20 and max(v[3] for v in expected.values()) > 2
    assert found(variants.group(variants.vocabulary(frame(spark, rows), dropped=dropped))) == expected


def test_variant_chains_ties_and_nothing(spark):
    words = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "ccccc": 5, "cccccd": 10, "cccccb": 10, "zzzzz": 3, "zzzzy": 5}
    made = spark.createDataFrame([(w, n, None) for w, n in words.items()] + [(None, 9, None)], "word string, n long, form string")
    assert found(variants.group(made)) == brute_groups(words)
    assert brute_groups(words)["aaaaa"][4] == "bbbbb" and brute_groups(words)["ccccc"][1] == "cccccb" and brute_groups(words)["zzzzz"][1] is None
    assert variants.group(variants.vocabulary(frame(spark, []))).count() == 0


def test_masks_of_one_edit_leave_a_band(spark):
    random_ = random.Random(8)
    letters = [*map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))]
    pairs = []
    for _ in range(300):
        w = "".join(random_.choice(letters) for _ in range(8))
        k = random_.randrange(8)
        pairs.append((w, random_.choice((w[:k] + w[k + 1 :], w[:k] + random_.choice(letters) + w[k:], w[:k] + random_.choice(letters) + w[k + 1 :]))))
    both = spark.createDataFrame(pairs, "a string, b string")
    for r in both.select(*(m.alias(f"a{k}") for k, m in enumerate(variants.bands(both.a))), *(m.alias(f"b{k}") for k, m in enumerate(variants.bands(both.b)))).collect():
        assert sum(r[k] == r[k + 3] for k in range(3)) >= 1 and sum((r[k] ^ r[k + 3]).bit_count() for k in range(3)) <= 2


def brute_audit(rows, labels):
    good, toxic = ({d for d, *marks in labels if marks[k] == 1 and d is not None} for k in (0, 1))
    fails = []
    for doc, text, source in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails.append((source or "", doc, {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": any((t or "") == text and d is not None and doc is not None and d < doc for d, t, _ in rows),
        }))
    out = defaultdict(lambda: [0] * 7)
    everything = ["".join(p) for p in itertools.permutations("ABCDE")]
    shapley = Counter()
    for order in everything:
        for part, doc, failed in fails:
            gone = False
            for step, f in enumerate(order, 1):
                row = out[part, order, step]
                row[0] += not gone and not failed[f]
                row[1] += not gone and failed[f]
                row[2] += gone and failed[f]
                row[3] += failed[f] and sum(failed.values()) == 1
                row[4] += not gone and failed[f] and doc in good
                row[5] += not gone and failed[f] and doc in toxic
                shapley[part, f] += not gone and failed[f]
                gone |= failed[f]
    return {k: (*v[:6], shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, seed):
    """One text has a third of all rows, so that its ids lie in several tasks."""
    random_ = random.Random(seed)
    texts = ["", None, "a b", "x " * 60, " ".join(f"w{k}" for k in range(60)), "A" * 3 + "b" * 57, "A" * 3 + "b" * 56, "é" * 60 + "ABC", "c#\x0bd\x1ce\xa0f", " \n\t"]
    texts += [" ".join(random_.choice(("Aa", "b", "c$", "dd", f"u{random_.randrange(90)}")) for _ in range(random_.choice((49, 50, 51, 90)))) for _ in range(25)]
    rows = [(random_.choice((k, k, k, 5, None)), texts[4] if k % 3 == 0 else random_.choice(texts), random_.choice(("s", "s", "t", None, ""))) for k in range(150)]
    labels = [(k, random_.choice((0, 1, None)), random_.choice((0, 1, None))) for k in random_.choices(range(160), k=120)] + [(None, 1, 1)]
    given = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = audited(audit.audit(frame(spark, rows), given))
        edges = audit.masks(frame(spark, [(k, "the same", "s") for k in range(100)]).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_audit(rows, labels)
    assert len(edges) == 100 and [r.doc_id for r in edges if not r.mask & audit.COPY] == [0]


def test_audit_of_texts_with_one_fingerprint(spark):
    """Texts of equal fingerprints in a task are told apart, and each is joined with its own beginning in another task."""
    import pyarrow as pa

    def batch(rows):
        return pa.RecordBatch.from_pylist([{"doc_id": d, "part": "s", "text": t, "fingerprint": x} for x, t, d in rows])

    first = list(audit._compared([batch([(1, b"a", 1), (7, b"b", 2)]), batch([(7, b"b", 3), (7, b"c", None), (7, b"c", 1)])]))
    second = list(audit._compared([batch([(7, b"b", 4), (7, b"c", 5), (8, b"b", 2)])]))
    rows = [r for b in first + second for r in b.to_pylist()]
    assert [(r["doc_id"], bool(r["mask"] & audit.COPY)) for r in rows if r["mask"] >= 0] == [(1, False), (2, False), (3, True), (None, False), (1, False), (4, False), (5, False), (2, False)]
    began = {r["edge"]: r["doc_id"] for b in first for r in b.to_pylist() if r["mask"] < 0}
    assert sorted(began.values()) == [1, 2] and {began.get(r["edge"]) for b in second for r in b.to_pylist() if r["doc_id"] in (4, 5)} == {1, 2}
    assert list(audit._compared([])) == []


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(frame(spark, []), labels).count() == 0
    only = audited(audit.audit(frame(spark, [(None, None, None)]), labels))
    assert only == brute_audit([(None, None, None)], []) and len(only) == 600


def brute_places(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text or ""))
    phrases = {p: (label, True) for p, label in license_scan.BASE.items()} | {p: (label, False) for p, (label, _) in license_scan.NOTICES.items()}
    return len(words), sorted((k, *kind) for p, kind in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())


def test_scans_equal_brute_force(spark):
    random_ = random.Random(3)
    pool = [w for p in (*license_scan.BASE, *license_scan.NOTICES) for w in (p, p.upper())] + ["under", "the", "cc", "by", "nc", "x", "é", "4", "İ", "\x85"]
    rows = [(random_.choice((k, 3, None)), "".join(x for _ in range(random_.choice((0, 1, 5, 40))) for x in (random_.choice(pool), random_.choice((" ", "-", "\n", "...", "\x00", "é", "")))), "s") for k in range(200)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "cc by nc " * 20_000, None), (903, "cc-by-nc" * 3, "s"), (904, "under the MIT license under the mit LICENSE", "s")]
    got = sorted((str(r.doc_id), r.n_words, sorted((p.word, p.label, p.base) for p in r.places)) for r in license_scan.scan(frame(spark, rows)).collect())
    assert got == sorted((str(d), *brute_places(t)) for d, t, _ in rows)
    assert sum(len(x[2]) for x in got) > 20_100 and license_scan.scan(frame(spark, [])).count() == 0


def test_scan_of_tags(spark):
    text = "// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND CC-BY-NC-4.0 */\nThis is under the MIT License.\nLicense-Expression: Apache-2.0 WITH LLVM-exception\n spdx-license-identifier: (mit and\nSPDX License Identifier none"
    row = license_scan.scan(frame(spark, [(1, text, "s")])).first()
    assert row.labels == ["apache-2", "cc-by-nc", "gpl-3", "mit"] and 0.99 < row.score < 1
    assert [(e.plain, e.valid, e.admitted) for e in row.expressions] == [("(MIT OR GPL-3.0-only) AND CC-BY-NC-4.0", True, False), ("Apache-2.0 WITH LLVM-exception", True, True), (None, False, None)]
    assert row.expressions[1].exceptions == ["llvm-exception"] and [(p.label, p.base) for p in row.places] == [("cc-by-nc", True), ("mit", True)]
    plain = license_scan.scan(frame(spark, [(2, "nothing of the kind", "s")])).first()
    assert (plain.labels, plain.score, plain.places, plain.expressions) == ([], 0.0, [], [])


@pytest.mark.parametrize(
    ("text", "plain", "ok"),
    [
        ("MIT", "MIT", True),
        ("mit or gpl-2.0+ and cc-by-nd-4.0", "mit OR gpl-2.0+ AND cc-by-nd-4.0", True),
        ("(MIT or GPL-2.0) and ISC", "(MIT OR GPL-2.0) AND ISC", True),
        ("((MIT)) This file is", "MIT", True),
        ("GPL-2.0 with Classpath-exception-2.0 or MIT", "GPL-2.0 WITH Classpath-exception-2.0 OR MIT", True),
        ("GPL-3.0-or-later", "GPL-3.0-or-later", False),
        ("MIT and", None, None),
        ("(MIT or ISC", None, None),
        ("(MIT or ISC) with X", None, None),
        ("MIT with A with B", None, None),
    ],
)
def test_expressions(text, plain, ok):
    found = license_scan.evaluate(text)
    assert (found.plain, found.admitted, found.valid) == (plain, ok, plain is not None)


def test_no_expression():
    assert license_scan.evaluate("") is None and license_scan.evaluate(") x") is None and license_scan.evaluate("\nMIT") is None
    assert [license_scan.label_of(x) for x in ("Apache-2.0", "GPL-2.0-only", "LGPL-2.1-or-later", "CC-BY-NC-4.0", "CC0-1.0", "BSD-3-Clause")] == ["apache-2", "gpl-2", "lgpl-2", "cc-by-nc", "cc0", "bsd-3-clause"]


trees = st.recursive(st.sampled_from(["MIT", "ISC", "GPL-3.0-only", "CC-BY-NC-4.0"]), lambda x: st.tuples(st.sampled_from(["AND", "or"]), x, x), max_leaves=12)


@given(trees)
@settings(max_examples=150, deadline=None)
def test_any_expression_is_read_as_it_was_made(tree):
    def written(t):
        return t if isinstance(t, str) else f"({written(t[1])} {t[0]} {written(t[2])})"

    def truth(t):
        if isinstance(t, str):
            return t in ("MIT", "ISC")
        return truth(t[1]) and truth(t[2]) if t[0] == "AND" else truth(t[1]) or truth(t[2])

    found = license_scan.evaluate(written(tree))
    assert found.valid and found.admitted == truth(tree)
    again = license_scan.evaluate(found.plain)
    assert again.valid and again[1:] == (found.plain, *found[2:])
