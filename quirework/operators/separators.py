"""Spaces and hyphens between letters put right by what the source of the same page has between them.

Pages meet their sources by an equality join. Letters and digits of the source are an index of contexts: so many of them
around each boundary, with what stands at it. A boundary of the text takes what its context has in the source if that is one
thing; contexts that are ambiguous are looked up again with a wider radius, up to the whole page, and what is ambiguous even then
stays as it is. Where a page's letters are those of its source, one after the other, a boundary's context has at least what stands
there, so only boundaries that differ are looked up.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import markup as M

# Letters and digits on either side, widening, and how many a context has at least.
RADII, LEAST_CONTEXT = (18, 36, 72, 144), 20
HYPHENS = "-‐‑"
#: Searches of a source that take as long as an index of its contexts: so many places found for a letter, and a search counts as so many.
STEP, LOOK = 4, 8
#: Between passages of one source, so that no context spans two of them.
EDGE = "\0"
_GAP = re.compile(rf"[{HYPHENS} \t\n]*")
_GAP_CODES = np.array([ord(c) for c in HYPHENS + " \t\n"], np.uint32)
_URL = re.compile(r"https?://[^\s<>)]+")
_CUT_WORD = re.compile(rf"(?<![^\W\d_])([^\W\d_]++)([{HYPHENS}])\s*\n\s*([^\W\d_]+)")
_CLOSING = re.compile(r"(?:</[^>]+>)*")


class Source:
    """Passages of a page, with an index of contexts for each radius that is asked for."""

    def __init__(self, passages: list[str], together: frozenset[str]):
        def join(m: re.Match) -> str:
            before = m.string[m.string.rfind("\n", 0, m.start()) + 1 : m.start()]
            in_url = re.search(r"https?://\S*$", before)
            return m[1] + ("" if m[1] + m[3] in together and not in_url else "-" if in_url else m[2]) + m[3]

        self.text = EDGE.join(passages)
        if "\n" in self.text:
            self.text = _CUT_WORD.sub(join, self.text)
        self.codes, kinds = _taken(self.text)
        self.at = np.flatnonzero((kinds != OTHER) | (self.codes == ord(EDGE)))
        self.units = _UNITS[self.codes[self.at]]
        self.indexes: dict[int, dict[str, set[str]]] = {}
        self.steps: dict[int, int] = defaultdict(int)

    @cached_property
    def letters(self) -> str:
        return _text_of(self.units)

    @cached_property
    def between(self) -> list[str]:
        return [self.text[a + 1 : b] for a, b in pairwise(self.at.tolist())]

    def gap(self, k: int) -> str:
        """What stands at a boundary."""
        return self.text[self.at[k - 1] + 1 : self.at[k]]

    def places(self, radius: int, context: str, boundary: int) -> set[str] | None:
        """What stands at a context's boundary, found by a search of the letters; null once searches of a radius would take longer than an index."""
        found, k = set(), -1
        while (k := self.letters.find(context, k + 1)) >= 0:
            found.add(self.gap(k + boundary))
            self.steps[radius] += 1
            if self.steps[radius] * STEP > len(self.letters):
                return None
        self.steps[radius] += LOOK
        return found

    def at_context(self, radius: int, context: str, boundary: int) -> set[str]:
        """What stands at a context's boundary, so many letters from its beginning, wherever the context occurs."""
        if len(context) == 2 * radius and boundary == radius:
            if radius not in self.indexes:
                if self.steps[radius] * STEP <= len(self.letters) and (found := self.places(radius, context, boundary)) is not None:
                    return found
                index = self.indexes[radius] = defaultdict(set)
                for k in range(radius, len(self.letters) - radius + 1):
                    if k <= len(self.between):
                        index[self.letters[k - radius : k + radius]].add(self.between[k - 1])
            return self.indexes[radius].get(context, set())
        # A context that the page's edge cuts short: a few hundred a page.
        found, k = set(), self.letters.find(context)
        while k >= 0 and len(found) < 2:
            if 0 < k + boundary < len(self.at):
                found.add(self.gap(k + boundary))
            k = self.letters.find(context, k + 1)
        return found

    def at_wider(self, letters: str, boundaries: list[int]) -> dict[int, str]:
        """What stands at boundaries of a page's letters whose contexts the radii leave ambiguous, where a wider one settles it.

        Radii double until a context is the whole page. Contexts of one radius are named by naming pairs of halves, so no context is
        ever kept; those that the page's edge cuts short begin or end the page, and are told by how far the source goes on like it.
        """
        n, m, r = len(letters), len(self.letters), 2 * RADII[-1]
        kinds = {c: i for i, c in enumerate(dict.fromkeys(self.between))}
        names, what = list(kinds), np.array([kinds[c] for c in self.between], np.int64)
        codes, width = np.concatenate([_codes(letters), _codes(self.letters)]), 1
        starts = _alike(letters, self.letters, min(n, r))
        ends = _alike(letters[::-1], self.letters[::-1], min(n, r))
        out, left = {}, np.array(boundaries, np.int64)
        while len(left):
            least, most = np.full(len(left), len(names)), np.full(len(left), -1)
            inner = (r <= left) & (left <= n - r)
            if inner.any() and m >= 2 * r:
                while width < 2 * r:
                    step = min(width, _below(2 * r, width) - width)
                    codes, width = np.unique(codes[:-step] * (codes.max() + 1) + codes[step:], return_inverse=True)[1], width + step
                at = codes[n : n + m - width + 1]
                low, high = np.full(codes.max() + 1, len(names)), np.full(codes.max() + 1, -1)
                np.minimum.at(low, at, what[r - 1 : r - 1 + len(at)])
                np.maximum.at(high, at, what[r - 1 : r - 1 + len(at)])
                least[inner], most[inner] = low[codes[left[inner] - r]], high[codes[left[inner] - r]]
            for i in np.flatnonzero(~inner):
                k = left[i]
                (size, place), length = (starts, min(n, k + r)) if k < r else (ends, n - k + r)
                place = place[: np.searchsorted(-size, -length, "right")]
                for some in (place[:64], place):  # most are told apart by a few
                    found = what[some + k - 1 if k < r else m - some - (n - k) - 1]
                    least[i], most[i] = found.min(initial=len(names)), found.max(initial=-1)
                    if least[i] != most[i]:
                        break
            out |= {int(k): names[v] for k, v in zip(left[least == most], least[least == most], strict=True)}
            left = left[least < most] if r < n else left[:0]
            r *= 2
        return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


#: What a character is and what it compares as, learned when it is first met.
OTHER, DIGIT, LETTER, UNKNOWN = range(4)
_KINDS, _UNITS = np.full(sys.maxunicode + 1, UNKNOWN, np.uint8), np.zeros(sys.maxunicode + 1, np.uint32)


def _taken(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, kinds) of a text's characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _KINDS[codes]
    if (kinds == UNKNOWN).any():
        for code in np.unique(codes[kinds == UNKNOWN]).tolist():
            c = chr(code)
            _KINDS[code], _UNITS[code] = LETTER if c.isalpha() else DIGIT if c.isalnum() else OTHER, ord(_unit(c))
        kinds = _KINDS[codes]
    return codes, kinds


def _text_of(units: np.ndarray) -> str:
    return units.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _alone(units: np.ndarray, boundaries: np.ndarray) -> np.ndarray:
    """Whether the narrowest context of a boundary is whole and occurs but once. Sums tell contexts apart: those of one sum may differ, and don't count as alone."""
    r, width = RADII[0], 1
    out = (r <= boundaries) & (boundaries <= len(units) - r)
    if not out.any():
        return out
    factor, sums = 0x9E3779B97F4A7C15, units.astype(np.uint64)
    while width < 2 * r:
        step = min(width, _below(2 * r, width) - width)
        sums, width = sums[:-step] * np.uint64(factor) + sums[step:], width + step
        factor = (factor * factor + 2) % 2**64
    own, ordered = sums[boundaries[out] - r], np.sort(sums)
    first = np.searchsorted(ordered, own)
    out[out] = (first + 1 == len(ordered)) | (ordered[np.minimum(first + 1, len(ordered) - 1)] != own)
    return out


def _below(size: int, width: int) -> int:
    """The next length on the way from a width to a size, each at most twice the one before."""
    while size > 2 * width:
        size = (size + 1) // 2
    return size


def _alike(text: str, source: str, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, places) of the source where it begins like a text for so many characters at least, longest first."""
    places, k = [], source.find(text[:least])
    while k >= 0:
        places.append(k)
        k = source.find(text[:least], k + 1)

    def size(place: int) -> int:
        low, high = least, min(len(text), len(source) - place)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if source.startswith(text[low:middle], place + low) else (low, middle - 1)
        return low

    sizes = np.array([size(k) for k in places], np.int64)
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], np.array(places, np.int64)[order]


def _unit(c: str) -> str:
    lower = c.lower()
    return lower if len(lower) == 1 else c


def edits(text: str, plain: str, runs: list[dict] | None, source: Source) -> list[tuple[int, int, str]]:
    """(start, end, instead) of each boundary of a page's text that the source settles otherwise, in order. Without runs the plain text is the text."""
    codes, kinds = _taken(plain)
    at = np.flatnonzero(kinds != OTHER)
    if len(at) < 2:
        return []
    units, gaps = _UNITS[codes[at]], np.diff(at) - 1
    asked = (kinds[at[:-1]] == LETTER) & (kinds[at[1:]] == LETTER)
    same = np.array_equal(units, source.units)
    out: list[tuple[int, int, str]] = []
    if same:
        theirs, sign, their_sign = np.diff(source.at) - 1, codes[at[:-1] + 1], source.codes[source.at[:-1] + 1]
        equal = (gaps == theirs) & ((gaps == 0) | (gaps == 1) & (sign == their_sign) & (sign != ord("\n")) & (sign != ord("\t")))
        boundaries = np.flatnonzero(asked & ~equal) + 1
        alone = _alone(units, boundaries)
        if runs is None and "://" not in plain:
            # Spaces alone: nothing but the boundary is to be looked at.
            k = boundaries - 1
            spaces = alone & (gaps[k] + theirs[k] == 1) & (np.where(gaps[k] == 1, sign[k], their_sign[k]) == ord(" "))
            swapped = k[spaces]
            out = [(a + 1, b, " " if n else "") for a, b, n in zip(at[swapped].tolist(), at[swapped + 1].tolist(), theirs[swapped].tolist(), strict=True)]
            boundaries, alone = boundaries[~spaces], alone[~spaces]
    else:
        boundaries, alone = np.flatnonzero(asked) + 1, np.zeros(int(asked.sum()), bool)
    # The rest begin like a gap that may be changed, or are none.
    likely = (gaps[boundaries - 1] == 0) | np.isin(codes[at[boundaries - 1] + 1], _GAP_CODES)
    boundaries, alone = boundaries[likely], alone[likely]
    if len(boundaries):
        out += _edits_at(text, plain, runs, source, units, at, boundaries.tolist(), alone.tolist())
    return sorted(out)


def _edits_at(text: str, plain: str, runs: list[dict] | None, source: Source, units: np.ndarray, places: np.ndarray, boundaries: list[int], alone: list[bool]) -> list[tuple[int, int, str]]:
    """Edits of some boundaries; those whose context is alone in the source have what stands there at the same letters."""
    at, letters = places.tolist(), _text_of(units)
    starts = [r["at"] for r in runs or ()]
    urls = [m.span() for m in _URL.finditer(plain)]

    def place(k: int) -> int:
        if runs is None:
            return k
        run = runs[bisect_right(starts, k) - 1]
        return run["source"] + k - run["at"]

    settled, wider = [], []
    for k, once in zip(boundaries, alone, strict=True):
        left, right = at[k - 1], at[k]
        gap = plain[left + 1 : right]
        if not _GAP.fullmatch(gap) or "\n\n" in gap:
            continue
        if once:
            settled.append((k, source.gap(k)))
            continue
        for radius in RADII:
            first, last = max(0, k - radius), min(len(letters), k + radius)
            found = source.at_context(radius, letters[first:last], k - first) if last - first >= LEAST_CONTEXT else set()
            if len(found) == 1:
                settled.append((k, *found))
                break
        else:
            if found:
                wider.append(k)
    if wider:
        settled = sorted([*settled, *source.at_wider(letters, wider).items()])
    out = []
    for k, instead in settled:
        left, right = at[k - 1], at[k]
        gap = plain[left + 1 : right]
        if not _GAP.fullmatch(instead) or (instead := re.sub(r"\s+", " ", instead)) == gap:
            continue
        if any(a <= left and right < b for a, b in urls) and (gap, instead) != ("", "-"):
            continue
        start, end = place(left) + 1, place(right)
        between = text[start:end]
        if "<!--" in between or re.search(r"<br\b", between, re.IGNORECASE):
            continue
        seen = {place(left + 1 + i) for i in range(len(gap))}
        styles = "".join(c for i, c in enumerate(between, start) if i not in seen)
        cut = _CLOSING.match(styles).end()
        out.append((start, end, styles[:cut] + instead + styles[cut:]))
    return out


def edited(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with edits made, which are in order and apart."""
    ends = [0, *(end for _, end, _ in found)]
    return "".join([part for (start, _, instead), end in zip(found, ends, strict=False) for part in (text[end:start], instead)]) + text[ends[-1] :]


def repaired_separators(pages: DataFrame, sources: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), together: str | None = None) -> DataFrame:
    """(keys, text, n_repaired) of pages of (keys, text) by sources of (keys, passages), an array of texts.

    Letters, digits and other signs never change; marks of style stay at their letters. A word that the source cuts at a line end
    keeps its hyphen unless together, a column of the sources with an array of words, has it whole. Pages without a source, null
    texts and places in addresses stay. Sources have one row for a page; repeated pages are repaired each by itself.
    """
    wanted = sources.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("passages").alias("_passages"), (F.col(together) if together else F.lit(None)).cast("array<string>").alias("_together"))
    # Merged, as a task takes long for the texts that it has: pages of a file that Spark doesn't split would stay in one task beside a broadcast.
    joined = pages.join(wanted.hint("merge"), [pages[k].eqNullSafe(wanted[f"_{k}"]) for k in keys], "left").drop(*(f"_{k}" for k in keys))
    # A text that no sign is in is its own plain text.
    marked = F.col("text").rlike(M.MARKED)
    rows = joined.select(*keys, "text", F.when(marked, M.plain(F.col("text"))).alias("plain"), F.when(marked, M.runs(F.col("text"))).alias("runs"), "_passages", "_together")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, plain, runs, passages, together in zip(*(batch.column(c).to_pylist() for c in ("text", "plain", "runs", "_passages", "_together")), strict=True):
                found = edits(text, text if plain is None else plain, runs, Source([p for p in passages if p], frozenset(together or ()))) if text and passages else []
                texts.append(edited(text, found) if found else text)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[*keys, "text", "n_repaired"])

    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    made = rows.mapInArrow(run, f"{kinds}, text string, n_repaired int")
    return made.select(*keys, F.when((F.col("n_repaired") > 0) & F.col("text").rlike(M.MARKED), M.clean_styles(F.col("text"))).otherwise(F.col("text")).alias("text"), "n_repaired")
