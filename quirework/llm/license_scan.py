"""Licences of texts: notice phrases and identifier tags by one automaton, expressions behind tags by a parser.

A text's words are put into a line with single spaces, in which an Aho-Corasick automaton finds every
phrase at once. Where it finds the words of an identifier tag, a second automaton finds the tags
themselves in the text, and the expression behind each is turned into postfix order by a shunting yard
and evaluated: which licences it names, how it is written plainly, and whether a policy admits it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import map_batches

# Base phrases and labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notice phrases with their labels, and how sure a phrase alone makes that the text is under that licence.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "licensed under the apache license": ("apache-2", 0.8),
    "apache org licenses license 2 0": ("apache-2", 0.9),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license v2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu general public license v3": ("gpl-3", 0.9),
    "under the terms of the gnu general public license": ("gpl", 0.8),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license version 2": ("mpl-2", 0.9),
    "mozilla public license v 2": ("mpl-2", 0.9),
    "eclipse public license": ("epl", 0.8),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd", 0.9),
    "under the bsd license": ("bsd", 0.8),
    "under the isc license": ("isc", 0.9),
    "boost software license": ("bsl-1", 0.8),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "dedicated to the public domain": ("public-domain", 0.7),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by 4 0": ("cc-by", 0.8),
    "cc by 3 0": ("cc-by", 0.8),
    "cc0 1 0": ("cc0", 0.8),
    "creative commons attribution 4 0": ("cc-by", 0.8),
    "creative commons attribution sharealike": ("cc-by-sa", 0.8),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.8),
    "all rights reserved": ("all-rights-reserved", 0.5),
}
BASE_SURE, TAG_SURE = 0.9, 0.95

#: Tags in lower case, before an expression. Their words lead to a search of the text itself.
TAGS = ("spdx-license-identifier:", "license-expression:", "packagelicensedeclared:", "packagelicenseconcluded:")

#: Licences, by the beginnings of their labels, that let anyone use a text if they are named.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "bsl", "cc-by", "cc0", "unlicense", "zlib", "0bsd", "public-domain")
RESTRICTED = ("cc-by-nc", "cc-by-nd")

# All but digits, letters and what lies beyond ASCII ends a word; A-Z are lower-cased.
_WORDS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_BINDS = {"or": 1, "and": 2, "with": 3}


class Expression(NamedTuple):
    """written: the text read; plain: with as few parentheses as it needs; valid: formed as it must be; admitted: by the policy."""

    written: str
    plain: str | None
    licences: list[str]
    exceptions: list[str]
    valid: bool
    admitted: bool | None


def label_of(identifier: str) -> str:
    """An identifier's label: in lower case, without what follows the version's first number, and without "only" or "or later"."""
    name = re.sub(r"(?:-only|-or-later|\+)$", "", identifier.lower())
    return re.sub(r"^(gpl|lgpl|agpl|mpl|apache|epl|bsl|cc0|cc-by(?:-nc|-sa|-nd)*)-?(\d+)(?:\.\d+)*$", lambda m: m[1] if m[1].startswith("cc") else f"{m[1]}-{m[2]}", name)


def admitted(label: str) -> bool:
    return label.startswith(PERMISSIVE) and not label.startswith(RESTRICTED)


def tokens_of(text: str) -> tuple[list[str], int]:
    """The tokens of the expression that text begins with, and where it ends: at the line's end, or where no expression can go on."""
    line = re.match(r"[^\r\n]*", text)[0]
    out, at, depth, operand = [], 0, 0, True
    while m := _TOKEN.match(line, at):
        sign, word = m.groups()
        if operand:  # an identifier or an opening parenthesis comes next
            if sign == ")" or (word and word.lower() in _BINDS):
                break
            depth += sign == "("
            operand = sign == "("
        elif sign == ")" and depth:
            depth -= 1
        elif word and word.lower() in _BINDS:
            word, operand = word.lower(), True
        else:
            break
        out.append(sign or word)
        at = m.end()
    return out, at


def postfix(tokens: Iterable[str]) -> list[str] | None:
    """The shunting yard: tokens in postfix order; null if parentheses don't match."""
    out, waiting = [], []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token in _BINDS:
            while waiting and _BINDS.get(waiting[-1], 0) >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    while waiting:
        if (token := waiting.pop()) == "(":
            return None
        out.append(token)
    return out


def evaluate(text: str) -> Expression | None:
    """The expression that text begins with; null if there is none.

    "or" admits what either side does, "and" what both do; an exception ("with") is only valid behind one licence, and only adds
    permissions. An expression that breaks off or leaves parentheses open is not valid, names no licences and admits nothing.
    """
    tokens, end = tokens_of(text)
    if not tokens:
        return None
    written = text[:end].strip()
    broken = Expression(written, None, [], [], False, None)
    order = postfix(tokens)
    if order is None:
        return broken
    # (written plainly, how it binds, licences, exceptions, admitted)
    stack: list[tuple[str, int, list[str], list[str], bool]] = []
    for token in order:
        if token not in _BINDS:
            label = label_of(token)
            stack.append((token, 4, [label], [], admitted(label)))
            continue
        if len(stack) < 2:
            return broken
        (b, b_binds, b_names, b_more, b_ok), (a, a_binds, a_names, a_more, a_ok) = stack.pop(), stack.pop()
        binds = _BINDS[token]
        if token == "with":
            if a_binds < 4 or b_binds < 4:
                return broken
            stack.append((f"{a} WITH {b}", binds, a_names, [b.lower()], a_ok))
            continue
        a, b = (f"({x})" if x_binds < binds else x for x, x_binds in ((a, a_binds), (b, b_binds)))
        stack.append((f"{a} {token.upper()} {b}", binds, a_names + b_names, a_more + b_more, a_ok and b_ok if token == "and" else a_ok or b_ok))
    if len(stack) != 1:
        return broken
    plain, _, names, more, ok = stack[0]
    return Expression(written, plain, sorted(set(names)), sorted(set(more)), True, ok)


def _automaton(words: dict[str, object]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word, value in words.items():
        automaton.add_word(word, (len(word), value))
    automaton.make_automaton()
    return automaton


#: By phrase: (label, base, sure); a tag has no label.
_PHRASES = _automaton(
    {f" {tag} ": (None, False, 0.0) for tag in (t.encode().translate(_WORDS).decode().strip() for t in TAGS)}
    | {f" {phrase} ": (label, False, sure) for phrase, (label, sure) in NOTICES.items()}
    | {f" {phrase} ": (label, True, BASE_SURE) for phrase, label in BASE.items()}
)
_TAGS = _automaton({tag: tag for tag in TAGS})


def expressions(text: str) -> list[Expression]:
    """The expressions behind all tags of a text, in order."""
    lowered = text.encode("utf-8").lower().decode("utf-8")  # A-Z only, so places stay
    return [found for end, _ in _TAGS.iter(lowered) if (found := evaluate(text[end + 1 :][:MOST_EXPRESSION]))]


#: Characters behind a tag in which its expression is read; a longer one breaks off and so isn't valid.
MOST_EXPRESSION = 4096

PLACE = "struct<label: string, base: boolean, word: long>"
FOUND = "struct<written: string, plain: string, licences: array<string>, exceptions: array<string>, valid: boolean, admitted: boolean>"


def scan_text(text: bytes) -> tuple[int, list[tuple[str, bool, int]], list[Expression], float]:
    """(words, places of phrases as (label, base, first word), expressions, score) of a whole text."""
    words = text.translate(_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    hits = [(end - size + 1, *value) for end, (size, value) in _PHRASES.iter(line.decode("latin-1"))]
    if not hits:
        return len(words), [], [], 0.0
    starts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    at = np.searchsorted(starts, [h[0] for h in hits]).tolist()
    places = sorted((word, label, base) for word, (_, label, base, _) in zip(at, hits, strict=True) if label)
    found = expressions(text.decode("utf-8", "replace")) if any(label is None for _, label, _, _ in hits) else []
    sure: dict[str, float] = {}
    for _, label, _, p in hits:
        if label:
            sure[label] = max(p, sure.get(label, 0.0))
    for e in found:
        sure |= {name: max(TAG_SURE, sure.get(name, 0.0)) for name in e.licences}
    score = 1.0 - float(np.prod([1.0 - sure[name] for name in sorted(sure)]))
    return len(words), [(label, base, word) for word, label, base in places], found, score


def scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, places, expressions, labels, score) of each row.

    Every place of every phrase counts, also of those that overlap; labels are those of phrases and of
    valid expressions, distinct and in order. The score is the chance that at least one label is right,
    each counted once with its surest evidence; 0 without any. A null text is empty; rows that repeat an
    id are scanned each by itself, rows without one too. Other columns are not read; an empty table has no rows.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [scan_text(t) for t in batch.column(1).to_pylist()]
        places = [[{"label": label, "base": base, "word": word} for label, base, word in p] for _, p, _, _ in out]
        found = [[e._asdict() for e in x] for _, _, x, _ in out]
        labels = [sorted({p[0] for p in places_} | {name for e in x for name in e.licences}) for _, places_, x, _ in out]
        place = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64())])
        names = pa.list_(pa.string())
        expression = pa.struct([("written", pa.string()), ("plain", pa.string()), ("licences", names), ("exceptions", names), ("valid", pa.bool_()), ("admitted", pa.bool_())])
        columns = [batch.column(0), pa.array([n for n, *_ in out], pa.int64()), pa.array(places, pa.list_(place)), pa.array(found, pa.list_(expression)), pa.array(labels, names), pa.array([s for *_, s in out], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "places", "expressions", "labels", "score"])

    return map_batches(rows, run, f"doc_id long, n_words long, places array<{PLACE}>, expressions array<{FOUND}>, labels array<string>, score double")
