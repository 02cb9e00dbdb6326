"""Operators over whole tables: joins, packing, classifiers, URL filters, chats, the pipeline."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quirework.llm import boost, chat, common, graph, jaccard, packing, quality, toxicity, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(300)]


def components_of(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    random_ = random.Random(4)
    edges = [(random_.randrange(400), random_.randrange(400)) for _ in range(220)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if x is not None}
    expected = components_of(nodes, [e for e in edges if None not in e])
    assert {n: got.get(n, n) for n in nodes} == expected
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_sets(texts, width):
    out = {}
    for doc, text in texts.items():
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ")
        words = [w for w in words if w]
        out[doc] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    return out


def brute_classes(texts, width, percent):
    sets = shingle_sets(texts, width)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = components_of(sets, links)
    return {d: (len(s), found[d]) for d, s in sets.items()}, links


def corpus(seed):
    """Texts with copies at every distance around the threshold, ties, short texts and odd ones."""
    random_ = random.Random(seed)
    texts = {}
    for k in range(24):
        words = [random_.choice(WORDS) for _ in range(random_.choice((1, 2, 3, 4, 8, 12, 25, 60, 150, 400)))]
        for copy in range(random_.randrange(1, 6)):
            changed = list(words)
            for _ in range(random_.randrange(0, 1 + len(words) // 20)):
                changed[random_.randrange(len(changed))] = random_.choice(WORDS)
            if random_.random() < 0.3:
                changed += [random_.choice(WORDS) for _ in range(random_.randrange(len(words) // 8 + 1))]
            texts[len(texts)] = random_.choice((" ", "\n", "\t", "  ")).join(changed).upper() if random_.random() < 0.2 else " ".join(changed)
    passage = " ".join(random_.choice(WORDS) for _ in range(60))
    for _ in range(12):
        texts[len(texts)] = " ".join(random_.choice(WORDS) for _ in range(20)) + " " + passage
    texts[len(texts)] = None
    texts[len(texts)] = ""
    texts[len(texts)] = " \n\t "
    texts[len(texts)] = "É é\xa0x"
    return texts


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (3, 90, 2), (5, 80, 3), (5, 80, 4), (2, 60, 5)])
def test_classes_equal_brute_force(spark, width, percent, seed):
    texts = corpus(seed)
    frame = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, key string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(frame, width, percent).collect()}
    expected, links = brute_classes(texts, width, percent)
    assert len(links) > 10 and got == expected


def test_classes_in_several_blocks_and_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    monkeypatch.setattr(jaccard, "TASK_ROWS", 8)
    monkeypatch.setattr(jaccard, "HELD_KEYS", 50)
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    random_ = random.Random(9)
    words = [random_.choice(WORDS) for _ in range(100)]
    texts = {k: " ".join(words[:50] + [f"u{k}"] + words[50:]) for k in range(30)} | {k: " ".join([*words, *(f"v{k}-{j}" for j in range(k))]) for k in range(30, 60)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(frame, 3, 90).collect()}
    assert got == brute_classes(texts, 3, 90)[0]


@pytest.mark.parametrize(("partners", "frequent"), [(1, 10**9), (2, 2)])
def test_chains_of_near_copies(spark, monkeypatch, partners, frequent):
    """Texts that are linked with their neighbours only, so that no segment's smallest text is linked with most of it."""
    monkeypatch.setattr(jaccard, "PARTNERS", partners)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 10)
    random_ = random.Random(6)
    words = [f"c{k}" for k in range(400)]
    texts = {}
    order = list(range(48))
    random_.shuffle(order)
    for at, doc in enumerate(order):
        texts[doc] = " ".join(words[3 * at : 3 * at + 60])
    for k in range(40):
        texts[100 + k] = " ".join([*words[:30], *(f"o{k}-{j}" for j in range(30))])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(frame, 5, 80).collect()}
    expected, links = brute_classes(texts, 5, 80)
    assert got == expected and len({v[1] for k, v in expected.items() if k < 100}) < 4 < len(links)


def test_equal_first_halves_are_told_apart():
    sets = [np.unique(np.random.default_rng(k).integers(0, 2**63, 30).astype(np.uint64)) for k in range(3)]
    clash = frozenset([jaccard.set_hash(sets[0])[0]])
    assert jaccard.identity(sets[1], clash) == jaccard.set_hash(sets[1])
    assert jaccard.identity(sets[0], clash)[0] not in clash and jaccard.identity(sets[0], clash)[1] == jaccard.set_hash(sets[0])[1]


def test_unique_texts_of_a_repeated_id_stay(spark):
    random_ = random.Random(8)
    a, b = (" ".join("".join(random_.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(2))
    docs = spark.createDataFrame([(5, a, "en", "s", 1, "p"), (5, b, "en", "s", 1, "q"), (3, a + " end", "en", "s", 1, "r"), (None, a, "en", "s", 1, None)], DOCS + ", class string")
    assert sorted((r.text, r["class"]) for r in jaccard.keep_one(docs).where("doc_id is not null").collect()) == sorted([(a + " end", "r"), (b, "q")])
    assert jaccard.keep_one(docs.where("false")).columns == docs.columns and jaccard.keep_one(docs.where("false")).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(20, 900))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, len(a) // 12)))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 1))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        apart = len(a) + len(b) - 2 * shared
        x, y = (np.frombuffer(jaccard.bits(s), np.uint8)[None, :] for s in (a, b))
        x, y = (jaccard.folded(s, min(x.shape[1], y.shape[1])) for s in (x, y))
        assert int(np.bitwise_count(x ^ y).sum()) <= apart
        if 100 * shared >= 90 * (len(a) + len(b) - shared):
            of_a, of_b = ({band: (key, spare) for band, key, spare in jaccard.sketch_keys(s, 90)} for s in (a, b))
            band = max(int(np.searchsorted(jaccard._STARTS, max(len(a), len(b)), "right")) - 1, 0)
            if band in of_a and apart:
                assert len(np.intersect1d(of_a[band][0], of_b[band][0])) > max(of_a[band][1], of_b[band][1])


def test_repeated_ids_and_missing_ids(spark):
    text = " ".join(WORDS[:20])
    rows = [(3, text), (3, text), (None, text), (2, text + " end"), (9, None)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()), key=repr)
    assert got == sorted([(3, 2), (3, 2), (None, None), (2, 2), (9, 9)], key=repr)
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    assert sorted((r.doc_id for r in jaccard.keep_one(docs).collect()), key=repr) == sorted([2, 9, None], key=repr)


@pytest.mark.parametrize("same", [True, False])
def test_a_round_leaves_out_only_ends_of_pairs_that_it_did_not_give(same):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 256, 32, np.uint8)
    alike = [(base ^ (np.arange(32) == k).astype(np.uint8)).tobytes() for k in range(20)]
    sketches = alike + [rng.integers(0, 256, 32, np.uint8).tobytes() for _ in range(60)]
    n = len(sketches)
    classes, parts, sizes, first = np.arange(n) + 1000, np.arange(n) // 2, np.full(n, 100), np.arange(n) % 2 == 0
    pairs, left = jaccard.near_in_block(classes, parts, sizes, sketches, first, same, 80, 3)
    wanted = {(i, j) for i in range(n) for j in range(i) if parts[i] != parts[j] and (same or first[i] != first[j]) and jaccard.may_link(sketches[i], sketches[j], 200, 80)}
    given = {(max(a, b) - 1000, min(a, b) - 1000) for a, b in pairs}
    assert given < wanted and all(left[i] and left[j] for i, j in wanted - given)
    assert set(np.flatnonzero(left)) <= set(range(20))


@pytest.mark.parametrize("shuffled", [False, True])
def test_one_id_with_several_texts(spark, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    random_ = random.Random(4)
    texts = [" ".join("".join(random_.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(6)]
    rows = [(5, texts[0]), (5, texts[1]), (7, texts[0] + " end"), (9, texts[1] + " end"), (11, texts[2]), (12, texts[2] + " end")]
    rows += [(20, texts[3]), (20, texts[3] + " end"), (21, texts[3] + " end here"), (30, texts[4]), (30, texts[4]), (31, texts[4] + " end"), (40, texts[5])]
    got = {(r.doc_id, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11), (12, 11), (20, 20), (21, 20), (30, 30), (31, 30), (40, 40)}
    kept = jaccard.keep_one(spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({r for r in rows if r[0] in (5, 11, 20, 30, 40)})


def brute_vectors(rows, threshold):
    units = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            units.setdefault(i, np.asarray(v) / np.linalg.norm(v))
    links = [(a, b) for a in units for b in units if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold]
    ids = {i for i, _ in rows if i is not None}
    found, count = components_of(ids, links), defaultdict(int)
    for e in links:
        for x in e:
            count[x] += 1
    return {(i, count[i], found[i], found[i] == i) for i in ids}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "TILE", 16)
    monkeypatch.setattr(vectors, "GROUP_BYTES", 8 * 8 * 30)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        v = rng.normal(size=8)
        rows += [(len(rows) + k, (v * rng.uniform(0.1, 9) + rng.normal(size=8) * rng.uniform(0, 0.5)).astype("f4").astype(float).tolist()) for k in range(int(rng.integers(1, 7)))]
    base = rng.normal(size=8)
    rows += [(1000 + k, (base + rng.normal(size=8) * 0.02).astype("f4").astype(float).tolist()) for k in range(50)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [float("inf")] + [1.0] * 7), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (5, rows[5][1]), (None, [1.0] * 8), (2008, [1e-30] * 8)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n_links string")
    got = {tuple(r) for r in vectors.near_duplicates(frame, 0.9).collect()}
    assert got == brute_vectors(rows, 0.9)
    assert vectors.near_duplicates(frame.where("false")).count() == 0


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(200, 64)), rng.normal(size=(150, 64))
    b[:50] = a[:50] + rng.normal(size=(50, 64)) * 0.4
    qa, qb = vectors.quantise(a), vectors.quantise(b)
    exact = qa.units @ qb.units.T
    for threshold in (0.2, 0.5, 0.9):
        assert not ((exact >= threshold) & ~vectors.possible(qa, qb, threshold)).any()
        i, j = vectors.linked(qa, qb, threshold)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(exact >= threshold))))


def least_bins(sizes, capacity):
    """The fewest bins, by trying everything; for few pieces."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_plans_are_packings_and_near_the_least():
    over = 0
    for seed in range(60):
        rng = np.random.default_rng(seed)
        sizes = sorted(rng.integers(1, 41, int(rng.integers(1, 10))).tolist(), reverse=True)
        counts = np.bincount(sizes, minlength=41)
        plan = packing.plan(counts, 40)
        used = np.zeros(41, int)
        for pattern, times in plan:
            assert sum(length * many for length, many in pattern) <= 40
            for length, many in pattern:
                used[length] += many * times
        assert (used == counts).all()
        n = sum(times for _, times in plan)
        assert n <= sum(t for _, t in packing.best_fit_decreasing(counts, 40))
        over += n - least_bins(sizes, 40)
    assert over == 0


def dominated(filling, counts, room):
    """Whether a piece left over could take the place of some of the filling's pieces, as one longer or for several as long."""
    free = room - sum(filling)
    left = counts - np.bincount(filling, minlength=len(counts))
    for bits in range(1 << len(filling)):
        chosen = [x for k, x in enumerate(filling) if bits >> k & 1]
        t = sum(chosen)
        if left[t + 1 : t + free + 1].any() or (len(chosen) > 1 and left[t]):
            return True
    return False


def test_fillings_are_the_undominated_ones():
    for seed in range(80):
        rng = np.random.default_rng(seed)
        room = int(rng.integers(1, 24))
        counts = np.bincount(rng.integers(1, 24, int(rng.integers(0, 9))), minlength=60)
        pieces = [x for x in range(room, 0, -1) for _ in range(counts[x])]
        every = {tuple(x for k, x in enumerate(pieces) if bits >> k & 1) for bits in range(1 << len(pieces))}
        expected = {f for f in every if sum(f) <= room and not dominated(np.array(f, int), counts, room)}
        found = list(packing.fillings(counts, room, packing.Budget(10**9)))
        assert len(found) == len(set(found)) and set(found) == expected
        assert [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True)


def test_search_betters_best_fit_on_a_histogram():
    rng = np.random.default_rng(0)
    counts = np.bincount(np.clip(rng.lognormal(5.5, 1.0, 40_000).astype(int), 1, 2048), minlength=2049) * 5
    best_fit = sum(t for _, t in packing.best_fit_decreasing(counts, 2048))
    assert sum(t for _, t in packing.plan(counts)) == packing.lower_bound(counts, 2048) < best_fit
    assert sum(t for _, t in packing.plan(counts, steps=0)) == best_fit and packing.plan(np.zeros(2049, int)) == []


def test_packing_rows(spark):
    import public_tokenizers

    rows = [(k, " ".join(["word"] * (37 * k % 500)), "x") for k in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "a b " * 1600, "x"), (5, "again", "x"), (None, "no id", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(frame, public_tokenizers.path("word_bpe_49k.json"), 512).toPandas()
    by = got.sort_values("offset").groupby("sequence_id")
    assert (by.length.sum() <= 512).all() and (by.length.cumsum() - got.length == got.offset).all()
    assert len(by) <= -(-got.length.sum() // 512) + 1
    assert sorted(got[got.doc_id == 102].length) == [129, 512, 512, 512, 512, 512, 512] and got[got.doc_id == 100].length.tolist() == [1]
    assert len(got[got.doc_id == 5]) == 2


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=3000) * 0.3 > 0.8).astype(int)
    model = boost.fit(x, y, np.arange(3000) % 4 == 3)
    fresh = rng.normal(size=(2000, 5))
    p, truth = model.probability(fresh), fresh[:, 0] + fresh[:, 1] * fresh[:, 2] > 0.8
    assert ((p > 0.5) == truth).mean() > 0.85 and (np.diff(model.steps[1]) >= 0).all() and 0 <= p.min() <= p.max() <= 1
    assert boost.fit(np.zeros((0, 5)), np.zeros(0, int), np.zeros(0, bool)).probability(x[:2]).tolist() == [0.5, 0.5]


def labelled(spark, seed=0, n=700):
    """Texts of which some are toxic (insults) and some of low quality (signs behind the words)."""
    random_ = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = [random_.choice(WORDS) for _ in range(random_.randrange(20, 120))]
        toxic, good = k % 5 == 0, k % 4 != 1
        if toxic:
            for _ in range(3):
                words.insert(random_.randrange(len(words)), random_.choice(("zorgblat", "quxfoul", "you")))
            words.insert(0, "zorgblat")
        if not good:
            words = [w + "***" for w in words]
        docs.append((k, " ".join(words), ("en", "de")[k % 2], f"src{k % 7 if k % 3 else 0}", len(words)))
        if k % 2 == 0 or k % 5 == 1:
            labels.append((k, int(good), int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d[0]: d[0] % 5 == 0 for d in docs}, {d[0]: d[0] % 4 != 1 for d in docs}


def test_toxicity_on_held_out_rows(spark):
    docs, labels, toxic, _ = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert "=zorgblat" in model.lexicon
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", None, None, None), (None, "zorgblat", None, None, None), (9003, "x " * 50_000, None, None, None)], DOCS)
    rows = toxicity.score(docs.unionByName(odd), model).withColumn("held", toxicity.held_out()).collect()
    assert len(rows) == 704 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held and r.doc_id in toxic]
    assert sum((r.predicted == 1) == toxic[r.doc_id] for r in held) / len(held) > 0.95
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {r.doc_id for r in rows if r.doc_id in toxic and r.predicted == 0}
    # the held-out rows' labels are never learned from
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - labels.toxic).otherwise(labels.toxic))
    assert sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, flipped)).collect())) == sorted(map(tuple, toxicity.score(docs, model).collect()))


def test_toxicity_reads_obfuscated_words():
    assert [toxicity.plain(w) for w in ("(Idiot!)", "1d1ot", "i.d.i.o.t", "st*pid", "2024", "--")] == ["idiot", "idiot", "idiot", "stpid", "", ""]


def test_quality_keeps_good_texts(spark):
    docs, labels, _, good = labelled(spark, 1)
    rows = quality.score(docs, labels, quality.fit(docs, labels)).collect()
    assert len(rows) == 700 and sum(r["keep"] == good[r.doc_id] for r in rows) / len(rows) > 0.98
    by_site = {(r.host, r.path): r for r in rows}
    assert all(0 < r.p_path < 1 and 0 < r.p_host < 1 for r in by_site.values())
    odd = docs.unionByName(spark.createDataFrame([(None, WORDS[0] * 3, None, None, None), (9001, None, None, "new", None)], DOCS))
    model = quality.fit(docs, labels)
    assert quality.score(odd, labels, model).count() == 702
    assert any(r.doc_id is None for r in quality.keep_good(odd, labels, model).collect())


def test_quality_judges_each_row_and_never_by_its_own_label(spark):
    docs, labels, _, good = labelled(spark, 5)
    model = quality.fit(docs, labels)
    bad = next(r.text for r in docs.collect() if not good[r.doc_id])
    fine = next(r.text for r in docs.collect() if good[r.doc_id])
    twice = spark.createDataFrame([(8000, bad, "en", "src0", 1), (8000, fine, "en", "src0", 1), (8000, fine, "en", "src0", 1)], DOCS).withColumn("mark", quality.F.lit("x"))
    kept = quality.keep_good(docs.withColumn("mark", quality.F.lit("y")).unionByName(twice), labels, model).where("doc_id = 8000").collect()
    assert [r.text for r in kept] == [fine, fine] and {r.mark for r in kept} == {"x"}
    flipped = labels.withColumn("quality", quality.F.when(labels.doc_id == 0, 1 - labels.quality).otherwise(labels.quality))
    before, after = ({r.doc_id: r.p_path for r in quality.score(docs, each, model).collect()} for each in (labels, flipped))
    assert abs(before[0] - after[0]) < 0.02 < max(abs(before[d] - after[d]) for d in before if d != 0) + 0.02
    held = quality.F.when(quality.held_out(), 1 - labels.quality).otherwise(labels.quality)
    assert quality.fit(docs, labels.withColumn("quality", held)).probability(np.zeros((1, quality.N_FEATURES))) == model.probability(np.zeros((1, quality.N_FEATURES)))
    sites = quality.sites_of(spark.createDataFrame([("http://A.x/en/3?q",), ("http://a.x/de/3",), ("http://b.y/7",), ("nothing/9",), (None,)], "url string"))
    assert sorted(map(tuple, sites.collect())) == [(3, "a.x", "de"), (7, "b.y", "")]
    scored = {r.doc_id: (r.host, r.path) for r in quality.score(docs, labels, model, sites).collect()}
    assert scored[3] == ("a.x", "de") and scored[7] == ("b.y", "") and scored[4] == ("src4", "en")


def test_sparse_sites_stay_near_the_prior(spark):
    rows = [(k, "big", "p", 0.9) for k in range(500)] + [(1000 + k, "bad", "p", 0.1) for k in range(500)] + [(5000, "tiny", "p", 0.05)]
    sites, prior = quality.posteriors(spark.createDataFrame([(*r, None) for r in rows], "doc_id long, host string, path string, p_doc double, y int"))
    p = {r.host: r.p_path for r in sites.collect()}
    assert p["big"] > 0.85 and p["bad"] < 0.15 and 0.25 < p["tiny"] < prior.rate


URLS = [
    (1, "http://A.Example.NET/en/1?x"), (2, "https://example.com/de/2#t"), (3, "https://example.com/en/3"), (4, "http://x.org/fr/1"), (5, "http://x.org"), (6, "x.org/no/scheme"), (7, None), (8, "http://net/"),
    (9, "HTTP://u@B.org:80/fr/9"), (10, "http://badexample.com/de/1"), (11, "ftp://é.NET/x"), (12, "http://a.net"), (12, "http://a.net"), (13, "://?q"), (14, ""),
]


def test_url_rules(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(URLS, "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/2", "example.com/de/", "block")
    assert got[3] == ("example.com", "/en/3", None, "allow")
    assert got[4] == ("x.org", "/fr/1", "org/fr/", "allow") and got[5] == ("x.org", "", None, "allow")
    assert got[6] == got[7] == got[14] == ("", "", None, "allow") and got[13] == ("", "", None, "allow")
    assert got[8] == ("net", "/", "net/", "block") and got[12] == ("a.net", "", None, "allow")
    assert got[9] == ("u@b.org:80", "/fr/9", None, "allow") and got[10][2] is None and got[11] == ("é.net", "/x", "net/", "block")


def sites(seed=0):
    """Pages of a site with bad and good branches, and labels of half of them."""
    random_ = random.Random(seed)
    pages, labels = [], []
    for k in range(600):
        host = ("one.info", "two.info")[k % 2]
        branch = random_.choice(("spam", "junk", "news", "blog", "wiki"))
        pages.append((k, f"http://{host}/{branch}/{random_.randrange(10**6)}/{random_.choice(('a', 'b'))}.html"))
        if random_.random() < 0.5:
            labels.append((k, int(random_.random() < (0.95 if branch in ("spam", "junk") else 0.03))))
    return pages, labels


def test_url_templates(spark):
    pages, labels = sites()
    rows = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert all((r.verdict == "block") == (r.path.split("/")[1] in ("spam", "junk")) for r in rows)
    assert {r.template for r in rows} == {f"/{b}/*/{x}.html" for b in ("spam", "junk", "news", "blog", "wiki") for x in "ab"}
    assert {r.branch for r in rows} == {f"/{b}/*/{{}}" for b in ("spam", "junk", "news", "blog", "wiki")}


def deep_and_rare_sites():
    """A host with many values of a level, one of them rare and bad, and one far down a long path."""
    pages = [(k, f"http://big.info/s{k % 150}/p{k}") for k in range(6000)]
    labels = [(k, int(k % 150 == 7 or k % 211 == 0)) for k in range(6000)]
    for k in range(200):
        pages.append((7000 + k, f"http://deep.info/2024/05/12/en/{('news', 'spam')[k % 2]}/x/p{k}"))
        labels.append((7000 + k, k % 2))
    pages += [(8000 + k, f"http://few{k}.info/" + "a/" * 40) for k in range(3)]
    return pages, labels


def test_rare_and_deep_branches_are_judged(spark):
    pages, labels = deep_and_rare_sites()
    rows = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    verdicts = {r.page_id: r.verdict for r in rows}
    assert len(rows) == len(pages) and all((verdicts[k] == "block") == (k % 150 == 7) for k in range(6000))
    assert all((verdicts[7000 + k] == "block") == (k % 2 == 1) for k in range(200))
    templates = {r.page_id: r.template for r in rows}
    assert templates[7] == "/s7/*" and templates[7001] == "/2024/05/12/en/spam/x/*" and templates[8000] == "/**"


def duck(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return sorted((tuple(map(str, r)) for r in con.execute(sql).fetchall()), key=repr)


def test_url_sql(spark):
    pages, _ = sites(3)
    marks = [(int(u.rsplit("/", 2)[1]), random.Random(k).randrange(2), 0) for k, u in pages[:400]]
    pages += [(k + 1000, u) for k, u in URLS] + [(k + 2000, u.replace("/p", "/9000")) for k, u in deep_and_rare_sites()[0]]
    marks += [(int(f"9000{k}"), int(k % 150 != 7), 0) for k in range(3000)]
    p, m = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    number = urls.F.regexp_extract(urls.path_of(urls.F.col("url")), "([0-9]+)[^/0-9]*/?$", 1)
    labels = p.select("page_id", number.try_cast("long").alias("doc_id")).join(m, "doc_id").select("page_id", urls.F.when(m.quality == 0, 1).otherwise(0).alias("bad"))
    out = urls.judge(p, labels)
    got = sorted((tuple(map(str, r)) for r in out.collect()), key=repr)
    assert got == duck(f"select {', '.join(out.columns)} from ({urls.oracle_sql()})", pages=p.toPandas(), labels=m.toPandas())


def test_deep_ways_are_one_step(spark, monkeypatch):
    """Forty levels that all pages share, with pages that end within them, take as many rounds as six, and equal the SQL."""
    written = {}
    for depth in (40, 6):
        rounds = []
        monkeypatch.setattr(urls, "checkpointed", lambda df, rounds=rounds: rounds.append(1) or common.checkpointed(df))
        way = [f"s{k}" for k in range(depth)]
        half = "/".join(way[: depth // 2])
        paths = ["/".join(way + [f"p{k % 3}", f"x{k}"]) for k in range(30)] + [half] * 7 + ["other/" + "/".join(way)] * 9 + ["", "other", "//" + half]
        p = spark.createDataFrame([(k, f"http://h.com/{x}/{k}" if k % 2 else f"http://h.com/{x}", "z") for k, x in enumerate(paths)], "page_id long, url string, template string")
        m = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(40)], "doc_id long, quality int, toxic int")
        number = urls.F.regexp_extract(urls.path_of(urls.F.col("url")), "([0-9]+)[^/0-9]*/?$", 1)
        bad = ((urls.F.col("quality") == 0) | (urls.F.col("toxic") == 1)).cast("int")
        labels = p.select("page_id", number.try_cast("long").alias("doc_id")).join(m, "doc_id").select("page_id", bad.alias("bad"))
        out = urls.judge(p, labels)
        got = sorted((tuple(map(str, r)) for r in out.collect()), key=repr)
        assert got == duck(f"select {', '.join(out.columns)} from ({urls.oracle_sql()})", pages=p.toPandas(), labels=m.toPandas())
        assert any(f"/s{depth - 1}" in r[5] for r in got)
        written[depth] = len(rounds)
    assert written[40] == written[6]



CHAT = [
    (1, 0, "user", "How do I sort a list in Python?\nIt has numbers."),
    (1, 1, "assistant", "Use the sorted function for that."),
    (1, 2, "user", "On Monday someone wrote:\n> How do I sort a list in Python?\nI meant backwards."),
    (1, 3, "assistant", "> > How do I sort a list in Python?\n> I meant backwards.\nThen pass reverse=True."),
    (1, 4, "user", "> Use the sorted  FUNCTION for that.\nWhat about methods?"),
    (1, 5, "assistant", "> nobody wrote this line here\nThere is list.sort too."),
    (1, 5, "assistant", "> nobody wrote this line here\nThere is list.sort too."),
    (2, 0, None, "hello there my friend"),
    (2, 3, "user", ""),
    (2, 7, "user", None),
    (3, 1, "user", ">only quoted text here\n>in two lines"),
    (3, 2, "user", "b"),
    (3, 2, "assistant", "a"),
    (None, 1, "user", "lost"),
    (4, 0, "user", "Is it on?"),
    (4, 1, "assistant", "No."),
    (4, 2, "user", "Look, no.\nReally."),
    (4, 3, "assistant", "> No.\nWhy not?"),
    (4, 4, "user", "> No.\n> 👍\n> really\nWhat else?"),
    (4, 5, "assistant", "👍"),
    (4, 6, "user", "> 👍\nThanks"),
    (4, None, "user", "lost"),
]


@pytest.mark.parametrize("block", [512, 2])
def test_conversations_by_quotation(spark, block):
    frame = spark.createDataFrame([(*r, "x") for r in CHAT], "conv_id long, turn long, role string, text string, branch string")
    out = chat.conversations(frame, block)
    got = {(r.conv_id, r.branch, r.piece): (r.reply_to, r.n_messages, r.text) for r in out.collect()}
    assert all(">" not in v[2] for v in got.values())
    if block == 512:
        assert got[1, 0, 0] == (None, 2, "user: How do I sort a list in Python?\nIt has numbers.\n\nassistant: Use the sorted function for that.")
        assert got[1, 2, 0] == (0, 2, "user: I meant backwards.\n\nassistant: Then pass reverse=True.")
        assert got[1, 4, 0] == (1, 2, "user: What about methods?\n\nassistant: There is list.sort too.")
        assert got[2, 0, 0] == (None, 3, "user: hello there my friend\n\nuser: \n\nuser: ")
        assert got[4, 3, 0] == (1, 1, "assistant: Why not?") and got[4, 4, 0] == (1, 3, "user: What else?\n\nassistant: 👍\n\nuser: Thanks")
        assert got[3, 1, 0] == (None, 3, "user: \n\nassistant: a\n\nuser: b")
    columns = ", ".join(out.columns)
    rows = sorted((tuple(map(str, r)) for r in out.collect()), key=repr)
    assert rows == duck(f"select {columns} from ({chat.oracle_sql(block)})".replace("conversations where", "chats where"), chats=frame.drop("branch").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels, toxic, good = labelled(spark, 2, 400)
    copies = docs.where("doc_id % 10 = 3").withColumn("doc_id", docs.doc_id + 10_000)
    docs.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, f"http://h{k % 5}.net/en/{3 * k}") for k in range(100)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == kept.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = {d for d in toxic if good[d] and not toxic[d]}
    assert not any(d >= 10_000 for d in ids) and len(ids & clean) > 0.97 * len(clean) and len(ids - clean) < 0.05 * len(ids)
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == ids
    nothing = kept.where("false")
    assert all(stage(spark, nothing, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_near_misses_are_verified_once(spark, monkeypatch):
    """Texts just below the threshold take several rounds; no round verifies a pair again, or compares a segment that is done."""
    from quirework.llm import jaccard

    base = " ".join(f"w{k}" for k in range(93))
    rows = [(i, base + "".join(f" t{i}x{k}" for k in range(12))) for i in range(40)]
    rows += [(100, rows[0][1] + " end"), (101, "other " * 3 + rows[0][1])]
    seen, rounds = [], []
    verified, residual = jaccard._verified, jaccard._residual

    def recorded(pairs, *others):
        seen.extend(tuple(sorted(p)) for p in pairs.distinct().collect())
        return verified(pairs, *others)

    def counted(rare, *others):
        near, still = residual(rare, *others)
        rounds.append((still.count(), near.select("a", "b").distinct().count()))
        return near, still

    monkeypatch.setattr(jaccard, "_verified", recorded)
    monkeypatch.setattr(jaccard, "_residual", counted)
    made = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert made == {i: i for i in range(40)} | {100: 0, 101: 0}
    assert len(rounds) > 1 and rounds[-1][1] > 100 and len(seen) == len(set(seen))
