"""Rules on titles, texts, numbers and sets as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.markup import SPACE, WORD, let, visible
from quirework.functions.text import strip_accents, strip_accents_py

# Names of branches of law.
BRANCHES = (
    "DIREITO CONSTITUCIONAL", "DIREITO ADMINISTRATIVO", "DIREITO CIVIL", "DIREITO PROCESSUAL CIVIL", "DIREITO PREVIDENCIÁRIO",
    "DIREITO DA CRIANÇA E DO ADOLESCENTE", "DIREITO DIGITAL", "DIREITO INTERNACIONAL", "DIREITO AMBIENTAL", "DIREITO EMPRESARIAL",
    "EXECUÇÃO PENAL", "DIREITO PENAL", "DIREITO PROCESSUAL PENAL", "DIREITO TRIBUTÁRIO", "DIREITO DO CONSUMIDOR", "DIREITO ELEITORAL",
)
# Beginnings of citations, without accents.
INSTRUMENT = r"^(?:CONSTITUICAO FEDERAL|(?:LEI|CODIGO)\b)"
# Signs of ordinals, words of articles, and signs that close clauses.
ORDINALS, ARTICLES, CLOSING_SIGNS = ("º", "°", "o"), ("Art", "art"), (",", ".", ";", ":", "!", "?")
# Characters from which a numbered title is a sentence, and verbs that make it one.
LONGEST_SENTENCE = 150
VERBS = ("é", "são", "deve", "devem", "será", "serão", "não", "há", "pode", "podem", "considera-se")
# Resolutions and limits of rendering.
LEAST_DPI, MOST_DPI, MOST_PIXELS = 36, 300, 25_000_000


def plain_title(title: Column) -> Column:
    """A title without marks of bold type, colons at its ends and repeated white space."""
    bare = F.regexp_replace(title, r"\*\*|__", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^[\s:]+|[\s:]+$", ""), r"\s+", " ")


def branch(title: Column) -> Column:
    """Whether a title is the name of a branch of law in capitals, whatever its accents."""
    plain = plain_title(title)
    return F.upper(strip_accents(plain)).isin([strip_accents_py(name) for name in BRANCHES]) & (plain == F.upper(plain))


def heading_level(title: Column) -> Column:
    """1 for the name of a branch in capitals, 3 for the citation of a law, else 2."""
    cites = F.upper(strip_accents(plain_title(title))).rlike(INSTRUMENT)
    return F.when(branch(title), 1).when(cites, 3).otherwise(2)


def prose_heading(title: Column) -> Column:
    """Whether a title is a paragraph: a label in bold with words after its colon, or a numbered sentence, that is a long one or one with a verb.

    What counts is what a reader sees; titles in capitals are none.
    """
    bold = F.split(title, r"\*\*")
    labelled = (F.get(bold, F.lit(0)) == "") & F.get(bold, F.lit(1)).rlike("^[^*]+:$") & F.get(bold, F.lit(2)).rlike(rf"^{SPACE}+[^\s]")
    seen = visible(title)
    first = F.get(F.split(seen, SPACE), F.lit(0))
    numbered = first.rlike(r"^\d+\.$") & (F.length(seen) > F.length(first))
    in_capitals = (seen == F.upper(seen)) & seen.rlike(r"\p{Lu}")
    words = F.regexp_extract_all(F.lower(seen), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))
    # A verb may be a part of a word with hyphens.
    verb = F.exists(words, lambda w: reduce(Column.__or__, (F.concat(F.lit("-"), w, F.lit("-")).contains(f"-{v}-") for v in VERBS)))
    return F.coalesce(labelled, F.lit(False)) | (numbered & ~in_capitals & ((F.length(seen) > LONGEST_SENTENCE) | verb))


def legal_spacing(text: Column) -> Column:
    """No spaces between the hyphen of an article's or paragraph's number and its letter, nor between a word and a closing sign."""
    gap = r"-[ \t]+"
    number = rf"(?:§\s*\d+[{''.join(ORDINALS)}]?|(?<!{WORD})(?:{'|'.join(ARTICLES)})\.\s*\d+)$"
    letter = rf"^[A-Z](?!{WORD})"

    def joined_parts(parts: Column, gaps: Column) -> Column:
        def with_gap(part: Column, k: Column) -> Column:
            cited = part.rlike(number) & F.get(parts, k + 1).rlike(letter)
            return F.concat(part, F.when(k >= F.size(gaps), F.lit("")).when(cited, F.lit("-")).otherwise(F.get(gaps, k)))

        return F.array_join(F.transform(parts, with_gap), "")

    gaps = F.regexp_extract_all(text, F.lit(gap), F.lit(0))
    joined = F.when(text.rlike(gap), let(F.split(text, gap, -1), lambda parts: let(gaps, lambda found: joined_parts(parts, found)))).otherwise(text)
    for sign in CLOSING_SIGNS:
        joined = let(F.split(joined, f"[{sign}]", -1), _joined_by(sign))
    return joined


def _joined_by(sign: str) -> Callable[[Column], Column]:
    """Joins pieces by a sign, without the blanks that stand between a word, or a mark of its style, and the sign."""
    tight = lambda piece: F.when(F.rtrim(F.translate(piece, "\t", " ")).rlike(rf"({WORD}|[*>)])$"), F.regexp_replace(piece, r"[ \t]+$", "")).otherwise(piece)
    return lambda pieces: F.array_join(F.transform(pieces, lambda piece, k: F.when(k < F.size(pieces) - 1, tight(piece)).otherwise(piece)), sign)


def letters_and_digits(text: Column) -> Column:
    """Only letters and digits, without accents and in lower case, for comparing values that are written differently."""
    return F.regexp_replace(F.lower(strip_accents(text)), r"[^\p{L}\p{N}]+", "")


def utc_text(time: Column) -> Column:
    """A time to the second, as text that ends in Z."""
    return F.date_format(F.date_trunc("second", time), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_time(text: Column) -> Column:
    """The time of such a text; null for any other."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.try_to_timestamp(F.translate(text, "TZ", " "), F.lit("yyyy-MM-dd HH:mm:ss")))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def render_problem(dpi: Column, width: Column, height: Column) -> Column:
    """"dpi", "pixels" or null: a whole number in bounds, and no more pixels than a page of points may have at it."""
    whole = finite(dpi) & (dpi == F.floor(dpi)) & dpi.between(LEAST_DPI, MOST_DPI)
    return F.when(~whole, "dpi").when(width * dpi / 72 * (height * dpi / 72) > MOST_PIXELS, "pixels")


def canonical_signature(text: Column) -> Column:
    """Whether a text is what 64 bytes are as unpadded base64 with "-" and "_"."""
    formed = F.coalesce(text.rlike(r"^[A-Za-z0-9_-]{86}$"), F.lit(False))
    data = F.try_to_binary(F.concat(F.translate(text, "-_", "+/"), F.lit("==")), F.lit("base64"))
    again = F.translate(F.base64(data), "+/=\r\n", "-_")
    return formed & F.coalesce((F.octet_length(data) == 64) & (again == text), F.lit(False))


def missing_and_extra(have: Column, wanted: Column) -> tuple[Column, Column]:
    """What a set lacks and what it has beyond the wanted one, each in order."""
    return F.array_sort(F.array_except(wanted, have)), F.array_sort(F.array_except(have, wanted))


def same_characters(a: Column, b: Column) -> Column:
    """Whether two texts have the same characters equally often, in any order."""
    return F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))


def first_and_rest(items: Column, most: int = 20) -> tuple[Column, Column]:
    """The first items, and how many more there are."""
    return F.slice(items, 1, most), F.greatest(F.lit(0), F.size(items) - most)


def page_range(pages: Column, start: Column, count: Column) -> tuple[Column, Column]:
    """(first, past the last) of a range of pages from 0 on, kept within the document."""
    first = F.greatest(F.lit(0), start)
    return first, F.greatest(first, F.least(pages, first + count))


def first_filled(*texts: Column) -> Column:
    """The tokens of the first text that has any."""
    tokens = (F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "") for t in texts)
    return F.coalesce(*(F.when(F.size(t) > 0, t) for t in tokens), F.array().cast("array<string>"))


def edge_trimmed(text: Column) -> Column:
    """White space taken off both ends, also inside of marks and tags that stand there; the marks stay."""
    opening, closing = r"^((?:<[A-Za-z]+>|\*\*|__)*)\s+", r"\s+((?:</[A-Za-z]+>|\*\*|__)*)$"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), opening, "$1"), closing, "$1")
