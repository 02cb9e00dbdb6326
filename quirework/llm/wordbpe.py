"""Ids of a tokenizers file for many texts, with the ids of each distinct chunk worked out once a worker."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
import regex

from quirework.llm.common import only_cache, quiet_threads

#: Distinct chunks whose ids a worker keeps as the recent ones; as many older ones stay until these are full.
CHUNKS_KEPT = 150_000

#: What a file says whose chunks between white space can be encoded one by one.
SEPARABLE = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
#: Characters that composition leaves as they are, that have one lower-case form everywhere, and that
#: str.split treats as the file's patterns do. Texts with others are encoded whole by the library.
UNUSUAL = re.compile("[^\t-\r\x20-ɏ‐-⁞₠-₿]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class WordBpe:
    def __init__(self, path: str):
        quiet_threads()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.whole = Tokenizer.from_file(path)
        kinds = lambda part, key: [x["type"] for x in (spec.get(part) or {}).get(key, [])]
        self.separable = (kinds("normalizer", "normalizers"), kinds("pre_tokenizer", "pretokenizers")) == SEPARABLE and spec["model"]["end_of_word_suffix"] == "</w>"
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        if self.separable:
            self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[[v for k, v in spec["model"]["vocab"].items() if k.endswith("</w>")]] = True
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            self.letters = _byte_letters()
            self.recent: dict[str, bytes] = {}
            self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _known(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """The ids of those chunks that are known."""
        recent, older, found = self.recent, self.older, {}
        for c in chunks:
            if (ids := recent.get(c)) is None and (ids := older.get(c)) is not None:
                recent[c] = ids
            if ids is not None:
                found[c] = ids
        return found

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of single words, which the library works out many at a time."""
        spelled = [w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(self.letters) for w in words]
        found: list[bytes] = []
        for encoding in self.bare.encode_batch([" ".join(spelled[k : k + 200]) for k in range(0, len(spelled), 200)], add_special_tokens=False):
            ids = np.array(encoding.ids, "<u4")
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            data = ids.tobytes()
            found += [data[a:b] for a, b in pairwise(cuts)]
        return dict(zip(words, found, strict=True))

    def _ids(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of each chunk. A word is a chunk too, with the same ids, so both are kept as one."""
        found = self._known(chunks)
        new = chunks - found.keys()
        if new:
            parts = {c: self.pattern.findall(c) for c in new if not c.isalpha()}
            words = {w for p in parts.values() for w in p} | (new - parts.keys())
            of = self._known(words - new)
            of |= self._words(list(words - of.keys()))
            for chunk in new:
                of[chunk] = b"".join([of[w] for w in parts[chunk]]) if len(parts.get(chunk, "1")) != 1 else of[chunk]
            if len(self.recent) + len(of) > CHUNKS_KEPT:
                self.older, self.recent = self.recent, {}
            self.recent.update(of)
            found |= {c: of[c] for c in new}
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the library gives them, as little-endian unsigned 32-bit integers."""
        if not self.separable:
            return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch(texts, add_special_tokens=False)]
        split = [None if UNUSUAL.search(t) or any(s in t for s in self.special) else t.lower().split() for t in texts]
        get = self._ids(set().union(*(chunks for chunks in split if chunks))).__getitem__
        return [self._whole(t) if chunks is None else b"".join(map(get, chunks)) for t, chunks in zip(texts, split, strict=True)]


_MADE: dict[str, WordBpe] = {}


def _forget() -> None:
    for made in _MADE.values():
        made.recent, made.older = {}, {}


def word_bpe(path: str) -> WordBpe:
    """One object for each file in each worker."""
    only_cache("word_bpe", _forget)
    if path not in _MADE:
        _MADE[path] = WordBpe(path)
    return _MADE[path]
