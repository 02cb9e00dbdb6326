"""Text functions as column expressions, so that they stay in generated code."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose decomposition is a base letter with combining marks, from a rule instead of a table.
_ACCENTED = [c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFKD", c)) > 1 and unicodedata.combining(d[1])]
ACCENTED = "".join(_ACCENTED)
PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)

WORD = r"[\p{L}\p{N}]+"


def strip_accents_py(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def strip_accents(text: Column) -> Column:
    """Letters without their accents; combining marks that stand alone go."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{M}", "")


def canonical(text: Column) -> Column:
    """For comparing titles: no accents, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), r"\s+", " "))


_ACCENTS = str.maketrans(ACCENTED, PLAIN)


def canonical_py(text: str) -> str:
    """canonical of one text."""
    if not text.isascii():
        text = "".join(c for c in text.translate(_ACCENTS) if unicodedata.category(c)[0] != "M")
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def suspicious(text: Column) -> Column:
    """How many characters are replacement signs, or control and unassigned ones but for white space."""
    return F.length(F.regexp_replace(text, r"[^\p{C}\x{FFFD}]|\s", ""))


#: Tags of styles, and those that stand within a line besides.
STYLES = ("b", "em", "i", "mark", "strong", "u")
INLINE = (*STYLES, "sub", "sup")


def visible(text: Column) -> Column:
    """Markdown without comments, inline tags and emphasis; line-break tags become line ends."""
    comment, tag = r"<!--[\s\S]*?-->", rf"(?i)</?(?:{'|'.join(INLINE)})\b[^>]*>"
    outside, inside = r"(?<!\w)[*_]", r"[*_](?!\w)"
    for pattern, instead in ((r"(?i)<br\s*/?>", "\n"), (comment, ""), (tag, ""), (rf"\*\*|__|{outside}|{inside}", ""), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(instead))
    return text


def duration(seconds: Column) -> Column:
    """45s, 2m 5s; rounded half to even."""
    whole = F.bround(seconds).cast("long")
    minutes = F.floor(whole / 60)
    return F.when(whole < 60, F.format_string("%ds", whole)).otherwise(F.format_string("%dm %ds", minutes, whole - minutes * 60))


def size(number: Column) -> Column:
    """Bytes with one decimal in the largest unit that they fill."""
    out = F.format_string("%d B", number.cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(number >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(number / 1024**power, 1))).otherwise(out)
    return out


def safe_warning(text: Column, most: int = 300) -> Column:
    return F.left(F.replace(F.replace(F.translate(text, "\r\n", "  "), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit(most))


# Names of secrets in logs.
SECRET = r"(?i)\b(password|senha|token|license[_ -]?key|chave)\b(\s*[=:]\s*)([^\s,;]+)"


#: A machine's id: a short name and four groups of four signs.
MACHINE = r"(?i)\b([A-Z]{2,5})(?:-[A-Z0-9]{4}){4}\b"


def sanitised(line: Column, home: str = "/home/app") -> Column:
    """A log line without the home folder, without what follows the names of secrets, and without the ids of machines."""
    homeless = F.regexp_replace(line, "(?i)" + re.escape(home), "%USERPROFILE%")
    return F.regexp_replace(F.regexp_replace(homeless, SECRET, "$1$2[REDACTED]"), MACHINE, "$1-[REDACTED]")


def json_for_html(text: Column) -> Column:
    """JSON text that can stand in a script element."""
    for sign, code in (("<", "003c"), (">", "003e"), ("&", "0026"), (" ", "2028"), (" ", "2029")):
        text = F.replace(text, F.lit(sign), F.lit(f"\\u{code}"))
    return text


def html_escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


# Fixed values.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(numeral: Column) -> Column:
    """A roman numeral's value by the subtractive rule; null for other text."""
    value = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    letters = F.filter(F.split(F.upper(numeral), ""), lambda c: c != "")
    values = F.transform(letters, lambda c: F.element_at(value, c))
    signed = F.transform(values, lambda v, k: F.when(v < F.coalesce(F.get(values, k + 1), F.lit(0)), -v).otherwise(v))
    return F.when(F.upper(numeral).rlike("^[IVXLCDM]+$"), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def asset_folder(stem: Column) -> Column:
    """A folder name for a document's files: plain letters of the stem, and a hash of the whole."""
    plain = F.left(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), F.lit(40))
    return F.concat(plain, F.lit("-"), F.left(F.sha1(stem), F.lit(8)))


def fingerprint(text: Column) -> Column:
    """The first sixteen hexadecimal digits of a hash in groups of four."""
    digits = F.upper(F.left(F.sha2(text, 256), F.lit(16)))
    return F.concat_ws("-", *(F.substring(digits, k, 4) for k in (1, 5, 9, 13)))
