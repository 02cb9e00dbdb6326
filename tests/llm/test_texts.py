"""Operators on single texts: BPE, media, personal data, word ids."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quirework.llm import bpe, mpeg, pii, queries, wordbpe
from quirework.llm.wordbpe import WordBpe

SCHEMA = "extra string, doc_id long, text string, ids string, spans string, media string"
ODD = [
    ("x", 1, "The idiot's 3 words, 'll don't\n\n  more  ", "a", "b", "c"),
    ("x", 1, "The idiot's 3 words, 'll don't\n\n  more  ", "a", "b", "c"),
    (None, 2, None, None, None, None),
    ("x", 3, "", "", "", ""),
    ("x", None, "no id é字\x1c\x85", "a", "b", "c"),
    ("x", 5, "ab" * 30_000 + "z" * 20_000, "a", "b", "c"),
    ("x", 6, "\N{NO-BREAK SPACE}<|endoftext|> 💥\r\n\t", "a", "b", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes(odd):
    encoding = reference()
    out = bpe.decode(bpe.encode(odd, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    got = rows_of(out)
    expected = [(r[1], np.array(encoding.encode_ordinary(r[2] or ""), "<u4").tobytes(), (r[2] or "").encode()) for r in ODD]
    assert got == sorted(expected, key=repr) == rows_of(bpe.round_trip(odd, PATH, public_tokenizers.PATTERN))


def test_bpe_on_random_texts():
    encoding, random_ = reference(), random.Random(7)
    merges = bpe.merges(PATH, public_tokenizers.PATTERN)
    parts = ["a", "b", "ab", " ", "  ", "\n", "é", "1", "'s", "!", "the", "aaa", "\x1c", "字", "́", "ing", "\t", "\xa0", "\u2003"]
    texts = ["".join(random_.choice(parts) for _ in range(random_.randrange(120))) for _ in range(400)]
    texts += [" ".join("".join(random_.choice(parts) for _ in range(random_.randrange(9))).strip() or "x" for _ in range(30)) for _ in range(300)] + [" ", " a", "a ", "  a", "a\n b", "a \nb"]
    assert merges.encode(texts) == [np.array(encoding.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_bpe_keeps_its_words_bounded():
    merges = bpe.Merges(bpe.read_ranks(PATH), public_tokenizers.PATTERN, words_kept=3)
    for text in ("one two three four", "five six", "one two"):
        assert merges.decode(merges.encode([text])[0]) == text.encode()
    assert len(merges.recent) + len(merges.older) <= 10


@pytest.mark.parametrize("size", [0, 1, 63, 64, 100, 936, 937, 938, 5000])
def test_audio_gives_the_payload_back(size):
    payload = random.Random(size).randbytes(size)
    media = mpeg.encode(payload)
    found = mpeg.probe(media)
    assert mpeg.decode(media) == payload
    assert found.crc_failed == found.skipped == 0 and found.crc_checked == found.frames == found.table_frames
    assert found.samples == 1152 * found.frames and found.rate == 48000
    assert found.table_bytes == len(media) - (found.offsets[0] - 192)
    assert all(mpeg.header(media[at : at + 4]) for at in found.offsets)


def test_audio_resynchronises_and_finds_damage():
    payload = random.Random(1).randbytes(4000)
    media = bytearray(mpeg.encode(payload))
    found = mpeg.probe(bytes(media))
    second = found.offsets[1]
    with_junk = bytes(media[:second]) + b"\xff\xfbjunk" * 3 + bytes(media[second:])
    again = mpeg.probe(with_junk)
    assert again.skipped == 18 and again.frames == found.frames and b"".join(again.bodies).startswith(payload)
    media[second + 10] ^= 1  # in the protected part
    assert mpeg.probe(bytes(media)).crc_failed == 1
    with pytest.raises(ValueError):
        mpeg.decode(bytes(media))
    tagged = mpeg.encode(payload) + b"TAG" + b"song".ljust(30, b"\0") + bytes(95)
    assert mpeg.probe(tagged).tags["title"] == "song" and mpeg.decode(tagged) == payload
    assert mpeg.probe(b"no audio at all").frames == 0


def test_audio_headers_of_other_kinds():
    assert mpeg.header(bytes((0xFF, 0xFB, 0x90, 0x00))).size == 417  # 128 kbit/s at 44.1 kHz
    assert mpeg.header(bytes((0xFF, 0xFB, 0x92, 0x00))).size == 418
    assert mpeg.header(bytes((0xFF, 0xF3, 0x80, 0x00))).samples == 576
    assert mpeg.header(bytes((0xFF, 0xFF, 0x90, 0x00))).layer == 1
    assert mpeg.header(b"\xff\xff\xff\xff") is None and mpeg.header(b"\xff") is None


def test_media_columns(odd):
    got = {}
    for r in mpeg.read(mpeg.store(odd)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for _, doc, text, *_ in ODD:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert {(r.n_bytes, bytes(r.payload)) for r in got[doc]} == {(len(data), payload)}
    assert len(got[1]) == 2 and got[1][0] == got[1][1]
    assert got[5][0].duration_s == pytest.approx(got[5][0].frames * 0.024)


def plain_spans(text):
    """The contract's patterns as they stand."""
    found = {}
    found["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0

    found["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return found


def test_base_patterns_on_random_texts():
    random_ = random.Random(3)
    parts = ["a", "@", ".", "x.y", "+", "-", "(", ")", " ", "4111111111111111", "4111 1111-1111 1111", "1", "25", "255", "256", "٣", "@a.b", "+49 171 2345678", "1.2.3.4"]
    for _ in range(4000):
        text = "".join(random_.choice(parts) for _ in range(random_.randrange(25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_patterns_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 50_000, "+1" + " " * 100_000, "1.1." * 50_000):
        pii.find(text, pii.default_field())


def test_similar_mentions_share_a_label():
    field = pii.default_field()
    text = "Call +49 171 2345678. Much later: 0171-2345678. Not 9999999999. a.b@x.org, or A.B (at) x (dot) org."
    base, added = pii.find(text, field)
    written = {k: [text[s:e] for s, e in v] for k, v in added.items()}
    assert base == plain_spans(text)
    assert written == {"email": ["A.B (at) x (dot) org"], "ip": [], "card": [], "phone": ["0171-2345678"]}
    clean = "In 1999 there were 12345678 things, 555-123-4567 of them at home."
    assert not any(x for found in pii.find(clean, field) for x in found.values())


@pytest.mark.parametrize("repeats", [2, 5, 100])
@pytest.mark.parametrize("gap", [" ", " and then some more words of the story that nobody else had told them "])
@pytest.mark.parametrize("chain", [0.0, 0.2])
def test_every_repeat_of_a_known_mention_shares_its_label(repeats, gap, chain):
    fields = [pii.Field(pii.default_field().weights, 7.0, chain), pii.Field(np.zeros((pii.N_FEATURES, 5)), 7.0, chain)]
    fields[0].weights[0, 0] = 2.5  # the most that features may speak against it
    for field in fields:
        other = gap.join(["0171-2345678;"] * repeats)
        for text in (f"+49 171 2345678;{gap}{other}", f"{other}{gap}+49 171 2345678;", f"{other}{gap}+49 171 2345678;{gap}{other}"):
            base, added = pii.find(text, field)
            assert base == plain_spans(text)
            assert {text[s:e] for s, e in added["phone"]} == {"0171-2345678"} and len(added["phone"]) == text.count("0171-")
            assert not added["email"] and not added["ip"] and not added["card"]
        clean = other.replace("0171", "0172")
        assert not any(x for found in pii.find(clean, field) for x in found.values())


def test_known_mentions_of_one_key_are_counted():
    """Against the sum over all labellings, with an edge for every pair with a known mention."""
    field = pii.Field(np.zeros((pii.N_FEATURES, 5)), 1.3, 0.0)
    nodes = [pii.Node(s, s + 9, label, "d12345678", np.zeros(pii.N_FEATURES)) for s, label in ((0, 4), (100, 4), (200, 3), (300, -1))]
    weight = np.exp(np.array([0, -4, -4, -4 + 1.3, -4 + 2.6]))
    assert np.abs(pii.marginals(nodes, field)[3] - weight / weight.sum()).max() < 1e-9
    assert {int(k) for k in pii.marginals(nodes, field)[:3].argmax(axis=1)} == {3, 4}


def test_many_mentions_of_one_key_are_linear():
    text = "+49 171 2345678; 0171-2345678; " * 5_000
    nodes = pii.nodes_of(text, pii.base_spans(text))
    assert len(nodes) == 10_000 and len(pii.edges_of(nodes)[0]) < 30_000
    _, added = pii.find(text, pii.default_field())
    assert len(added["phone"]) == 5_000


def test_message_passing_is_exact_on_a_tree():
    """Against the sum over all labellings of a chain of three mentions."""
    rng = np.random.default_rng(2)
    field = pii.Field(rng.normal(size=(pii.N_FEATURES, 5)), 1.3, 0.4)
    text = "+49 171 2345678 and 0171 2345678 then 99 88 77 66"
    nodes = pii.nodes_of(text, pii.base_spans(text))
    got = pii.marginals(nodes, field)
    local = np.clip((x := np.stack([n.features for n in nodes]) @ field.weights) - x[:, :1], -pii.FEATURES_AT_MOST, pii.FEATURES_AT_MOST) - pii.PASSED_OVER
    local[:, 0] = 0
    for k, n in enumerate(nodes):
        if n.label >= 0:
            local[k] = -50
            local[k, n.label] = 0
    a, b, skip = pii.edges_of(nodes)
    expected = np.zeros_like(got)
    for labels in np.ndindex(*[5] * len(nodes)):
        weight = sum(local[k, v] for k, v in enumerate(labels)) + sum((field.skip if s else field.chain) for i, j, s in zip(a, b, skip) if labels[i] == labels[j])
        for k, v in enumerate(labels):
            expected[k, v] += np.exp(weight)
    expected /= expected.sum(axis=1, keepdims=True)
    # Two edges between one pair of nodes make a loop, so this is close instead of equal.
    assert np.abs(got - expected).max() < 0.02


def test_pii_rows(spark, odd):
    field = pii.fit(odd)
    got = {(r.doc_id, len(r.spans)) for r in pii.detect(odd, field).collect()}
    assert got == {(r[1], 0) for r in ODD}
    docs = spark.createDataFrame([(1, "mail a@b.cd or +49 171 2345678", "en", "s", 5), (2, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    redacted = {r.doc_id: r for r in pii.redact(docs, field).collect()}
    assert redacted[1].text == "mail <EMAIL> or <PHONE>" and redacted[1].n_chars == len(redacted[1].text) and redacted[2].text is None
    empty = docs.where("false")
    assert pii.redact(empty, pii.fit(empty)).count() == 0


def test_fit_counts_all_mentions_of_the_sample(spark):
    numbers = ", then ".join(str(1000000 + k) for k in range(100))
    late = numbers + ". Call +49 171 2345678, call +49 171 2345678"
    frame = lambda *texts: spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    none = pii.default_field()
    fields = [pii.fit(frame(late)), pii.fit(frame(numbers, numbers, late), 3)]
    for field, copies in zip(fields, (1, 3), strict=True):
        assert not np.array_equal(field.weights, none.weights) and field.chain == 0.5
        nodes = pii.nodes_of(text := late, pii.base_spans(text)) + (copies - 1) * pii.nodes_of(numbers, pii.base_spans(numbers))
        x, target = np.stack([n.features for n in nodes]), np.eye(5)[[max(0, n.label) for n in nodes]]
        weights = np.zeros((pii.N_FEATURES, 5))
        for _ in range(400):
            p = np.exp(x @ weights)
            weights -= 0.5 * (x.T @ (p / p.sum(axis=1, keepdims=True) - target) / len(x) + 2e-2 * weights)
        assert np.allclose(field.weights, weights)


def test_word_ids_equal_the_library(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, random_ = Tokenizer.from_file(path), WordBpe(path), random.Random(5)
    letters = [chr(c) for c in (*range(9, 14), *range(32, 0x250), *range(0x2010, 0x205F), *range(0x20A0, 0x20C0))] + list("the's'll'd ") * 20 + ["\x1c", "Σ", "é", "é", "字", "<|endoftext|>", "<|StartOfText|>"]
    texts = ["".join(random_.choice(letters) for _ in range(random_.randrange(80))) for _ in range(1500)] + ["", "".join(f"{c}a{c} " for c in letters)]
    assert own.separable
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode(texts) == expected
    monkeypatch.setattr(wordbpe, "CHUNKS_KEPT", 50)
    assert [x for k in range(0, len(texts), 7) for x in own.encode(texts[k : k + 7])] == expected
    assert own.encode(["a <|startoftext|>"])[0] == np.array([320, 49406], "<u4").tobytes()


def test_queries_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string"), ("embeddings", "vec_id long, embedding array<float>"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in sorted(queries.queries()):
        assert queries.queries()[name](spark, str(tmp_path)).count() == 0, name


def test_query_digests(spark, tmp_path):
    spark.createDataFrame([(1, "hi a@b.cd", "en", "s", 9), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    r = {x.doc_id: x for x in queries.op4_pii(spark, str(tmp_path)).collect()}
    assert (r[1].n_email, r[1].n_phone, r[1].spans) == (1, 0, "email:3:9") and r[1].base_sha256 == hashlib.sha256(b"email:3:9").hexdigest()
    assert r[2].spans == "" and r[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    m = {x.doc_id: x for x in queries.op8_mpeg_audio(spark, str(tmp_path)).collect()}
    assert m[2].payload_bytes == 64 and m[2].n_bytes == 0 and m[2].tail_crc32 == zlib.crc32(bytes(64))
    assert m[1].payload_sha256 == hashlib.sha256(b"hi a@b.cd".ljust(64, b"\0")).hexdigest()
