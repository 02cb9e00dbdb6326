"""Byte-level BPE encoding and decoding by merge replay over the distinct words of each block of documents.

The words of a block that no earlier block had are laid out as one sequence of byte tokens. An
inverted index leads from the rank of a token pair to the places of that pair in all the words.
Ranks are taken in order, each merge is done at all its places, and only the neighbours of a place
get new entries. Documents are then joined with their words' ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quirework.llm.common import id_and_text, map_batches, only_cache, texts_of

#: Distinct words whose ids a worker keeps as the recent ones; as many older ones stay until these are full.
WORDS_KEPT = 600_000
#: Rows of a block, whose new words are replayed together.
BLOCK_ROWS = 2048
#: Tokens that are decoded at once.
DECODED = 500_000
#: Texts whose pattern gives runs of letters with at most one space before them as single words can be cut at
#: spaces first; this is the test text for that, with the words it must give.
SPACED, SPACED_WORDS = "ab cd'x é1 ,y", ["ab", " cd", "'", "x", " é", "1", " ,", "y"]


def read_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """Ranks, the words encoded so far, and their decoding table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, words_kept: int = WORDS_KEPT):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.spaced = self.split(SPACED) == SPACED_WORDS
        self.words_kept = words_kept
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens])
        self.places = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.byte_ids = np.array([ranks[bytes((b,))] for b in range(256)], np.int64)
        self.byte_pairs = np.array([ranks.get(bytes((x, y)), -1) for x in range(256) for y in range(256)], np.int64)
        halves = ((ranks.get(t[:k]), ranks.get(t[k:]), rank) for t, rank in ranks.items() for k in range(1, len(t)))
        pairs = np.array([(a << 32 | b, rank) for a, b, rank in halves if a is not None and b is not None], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pair_keys, self.pair_ranks = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], -1)

    def _ranks_of(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """The ranks of tokens that stand side by side, or -1."""
        key = np.asarray(left, np.int64) << 32 | np.asarray(right, np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, by merges in rank order over all words at once.

        A word whose merge makes a pair of lower rank waits with its other places until that is merged.
        """
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        starts = ends - size
        token = self.byte_ids[data]
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[ends - 1], before[starts] = -1, -1
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            firsts = [0, *cuts.tolist()]
            for rank, s, e in zip(ranks[firsts].tolist(), firsts, [*firsts[1:], len(ranks)], strict=True):
                if rank in index:
                    index[rank].append(places[s:e])
                else:
                    index[rank] = [places[s:e]]
                    heapq.heappush(queue, rank)

        first = np.flatnonzero(after >= 0)
        ranks = self.byte_pairs[data[first].astype(np.int64) << 8 | data[np.minimum(first + 1, len(data) - 1)]]
        if (ranks >= 0).any():
            add(first[ranks >= 0], ranks[ranks >= 0])
        while queue:
            rank = heapq.heappop(queue)
            p = np.unique(np.concatenate(index.pop(rank)))
            # What stood at a place when it was indexed had the token's bytes; it still has if the lengths fit.
            q = after[p]
            live = (token[p] >= 0) & (q >= 0)
            p, q = p[live], q[live]
            live = self.lengths[token[p]] + self.lengths[token[q]] == self.lengths[rank]
            p, q = p[live], q[live]
            if not len(p):
                continue
            chained = q[:-1] == p[1:]
            if chained.any():  # of places that overlap in a row, every second one is gone when its turn comes
                at = np.arange(len(p))
                head = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), at, 0))
                p, q = p[(at - head) % 2 == 0], q[(at - head) % 2 == 0]
            r, o = after[q], before[p]
            left = token[o]
            joined = np.concatenate([[False], o[1:] == q[:-1]])  # the left neighbour is merged at the same time
            o[joined], left[joined] = p[:-1][joined[1:]], rank
            right_rank = np.where(r >= 0, self._ranks_of(rank, token[r]), -1)
            left_rank = np.where(o >= 0, self._ranks_of(left, rank), -1)
            lower = ((right_rank >= 0) & (right_rank < rank)) | ((left_rank >= 0) & (left_rank < rank))
            if lower.any():
                word, at = np.searchsorted(starts, p, "right"), np.flatnonzero(lower)
                held, which = np.unique(word[at], return_index=True)
                place = np.minimum(np.searchsorted(held, word), len(held) - 1)
                waits = (held[place] == word) & (np.arange(len(p)) > at[which][place])
                if waits.any():
                    add(p[waits], np.full(int(waits.sum()), rank))
                    p, q, r, o, right_rank, left_rank = (x[~waits] for x in (p, q, r, o, right_rank, left_rank))
            token[p], token[q], after[p] = rank, -1, r
            inner = r >= 0
            before[r[inner]] = p[inner]
            right_rank[:-1][r[:-1] == p[1:]] = -1  # that pair is the left one of the next place
            places, ranks = np.concatenate([p, o]), np.concatenate([right_rank, left_rank])
            if (new := ranks >= 0).any():
                add(places[new], ranks[new])
        live = token >= 0
        kept = np.cumsum(live)
        cuts = [0, *(kept[ends - 1] * 4).tolist()] if len(words) else [0]
        out = token[live].astype("<u4").tobytes()
        return [out[s:e] for s, e in pairwise(cuts)]

    def _known(self, keys: Iterable[str]) -> dict[str, bytes]:
        """The ids of those words that are known."""
        recent, older, found = self.recent, self.older, {}
        for k in keys:
            if (ids := recent.get(k)) is None and (ids := older.get(k)) is not None:
                recent[k] = ids
            if ids is not None:
                found[k] = ids
        return found

    def _keep(self, words: dict[str, bytes]) -> None:
        if len(self.recent) + len(words) > self.words_kept:
            self.older, self.recent = self.recent, {}
        self.recent.update(words)

    def ids_of_words(self, keys: set[str]) -> dict[str, bytes]:
        """The ids of words, each by its key_of()."""
        found = self._known(keys)
        new, rest, spelled = {}, [], []
        for key in keys - found.keys():
            data = (key[1:] if key[0] == " " else " " + key).encode("utf-8")
            if (whole := self.ranks.get(data)) is not None:
                new[key] = whole.to_bytes(4, "little")
            else:
                rest.append(key)
                spelled.append(data)
        new.update(zip(rest, self.replay(spelled), strict=True))
        self._keep(new)
        return found | new

    def ids_of_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of chunks, each with a space before it; those that are empty or have white space at an end are left out.

        Words of the pattern end before a space that stands between two characters other than white
        space. A word that begins with a space is a chunk too, with the same key.
        """
        found = self._known(chunks)
        new = [c for c in chunks if c not in found and c and not c[0].isspace() and not c[-1].isspace()]
        parts = {c: [key_of(w) for w in self.split(" " + c)] for c in new if not c.isalpha()}
        of = self.ids_of_words({k for p in parts.values() for k in p}.union(c for c in new if c not in parts))
        joined = {c: b"".join([of[k] for k in p]) for c, p in parts.items() if len(p) > 1}
        self._keep(joined)
        found.update((c, of[c]) for c in new if c not in joined)
        return found | joined

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [t.split(" ") if self.spaced else [""] for t in texts]
        heads = [c[0] if self.spaced else t for c, t in zip(cut, texts, strict=True)]
        for c in cut:
            del c[0]
        distinct = set().union(*cut)
        of = self.ids_of_chunks(distinct)
        if odd := distinct - of.keys():
            for k, c in enumerate(cut):
                if not odd.isdisjoint(c):
                    cut[k], heads[k] = [], texts[k]  # by the pattern alone
        words = [[key_of(w) for w in self.split(t)] for t in heads]
        get_word, get = self.ids_of_words(set().union(*words)).__getitem__, of.__getitem__
        return [b"".join([*map(get_word, w), *map(get, c)]) for w, c in zip(words, cut, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids that are little-endian unsigned 32-bit integers."""
        out, all_ids = [], np.frombuffer(ids, "<u4")
        for k in range(0, len(all_ids), DECODED):
            part = all_ids[k : k + DECODED]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            out.append(self.flat[np.repeat(self.places[part] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def key_of(word: str) -> str:
    """A word's key: what follows the space before it, or a space and the word if it has none or is white space."""
    return word[1:] if word[0] == " " and not word.isspace() else " " + word


_MERGES: dict[tuple[str, str], Merges] = {}


def merges(path: str, pattern: str) -> Merges:
    """One object for each vocabulary in each worker."""
    only_cache("bpe", _MERGES.clear)
    if (path, pattern) not in _MERGES:
        _MERGES[path, pattern] = Merges(read_ranks(path), pattern)
    return _MERGES[path, pattern]


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each row of (doc_id, text); ids is binary, four little-endian bytes an id.

    path: a vocabulary file that every executor has. A null text counts as empty and has no ids.
    Rows stay as they are, repeated ones too; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(merges(path, pattern).encode(texts_of(batch.column(1))), pa.binary())], ["doc_id", "ids"])

    return map_batches(id_and_text(documents), run, "doc_id long, ids binary", BLOCK_ROWS)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of each row of (doc_id, ids); null ids decode to null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode_one = merges(path, pattern).decode
        decoded = [None if x is None else decode_one(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of each row of (doc_id, text): decode() of encode() in one pass, with the same rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = merges(path, pattern)
        ids = own.encode(texts_of(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return map_batches(id_and_text(documents), run, "doc_id long, ids binary, decoded binary", BLOCK_ROWS)
