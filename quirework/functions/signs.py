"""What markup says by column expressions, for one text in Python: steps that go through the lines of a text take it apart there.

Patterns mean what they mean there: a dot ends at every line end, and an end may stand before the last line end.
"""

from __future__ import annotations

import re

from quirework.functions.text import INLINE, STYLES

#: White space that a pattern's plain sign for it takes, ends of lines, and the end of a text or the place before its last line end.
BLANK, LINE_ENDS = r" \t\n\x0b\f\r", r"\n\r\x85\u2028\u2029"
END = r"(?=\Z|\r\n\Z|(?<!\r)\n\Z|[\r\x85\u2028\u2029]\Z)"

#: The end of a tag's name: before what is no letter, decimal digit or accent.
_NAME_END = r"(?![^\W²³¹¼-¾]|[\u0300-\u036f])"
_TAG = rf"/?(?:{'|'.join(INLINE)}){_NAME_END}[^>]*"
_BREAK = re.compile(rf"<br[{BLANK}]*/?>")
# Each branch begins with its letter, so that a search skips to one of them.
_SIGN = re.compile(rf"<(?:!--[\s\S]*?--|{_TAG}|br[{BLANK}]*/?)>|\*(?:\*|(?<!\w\*)|(?!\w))|_(?:_|(?<!\w_)|(?!\w))")
_MARKED = re.compile("[<*_]")
marked = _MARKED.search
_BEGUN = re.compile(rf"<{_TAG}\Z")
_NAME = re.compile(rf"</?([A-Za-z0-9_]+)[^{LINE_ENDS}]*\Z")
_STYLE = f"({'|'.join(STYLES)})"
_MEETING = re.compile(rf"</?{_STYLE}>(?=\s*</?{_STYLE}>)|\*{{4}}|_{{4}}")
_CLEAN = tuple(re.compile(p) for p in (rf"<{_STYLE}>\s*</\1>", rf"</{_STYLE}><\1>", rf"(?<=[^{BLANK}])(?:\*{{4}}|_{{4}})(?=[^{BLANK}])"))


def plain(text: str) -> str:
    """The visible characters, as markup.plain."""
    return _SIGN.sub("", _BREAK.sub("\n", text) if "<br" in text else text)


def source_place(text: str, place: int) -> int | None:
    """Where the visible character at a place stands in a text; null beyond the end."""
    at = source = 0
    for m in _SIGN.finditer(text):
        if place < at + m.start() - source:
            break
        at, source = at + m.start() - source, m.end()
        if m[0].startswith("<br"):
            if place == at:
                return m.start()
            at += 1
    else:
        if place >= at + len(text) - source:
            return None
    return source + place - at


def open_styles(text: str) -> list[tuple[str, str]]:
    """The styles that are open at a text's end, outermost first, as (sign, closing), as markup.open_styles."""
    stack: list[tuple[str, str]] = []
    for m in _SIGN.finditer(text):
        sign = closing = m[0]
        if sign.startswith(("<!--", "<br")):
            continue
        if tag := sign.startswith("<"):
            name = _NAME.match(lower := sign.lower())
            closing = f"</{name[1]}>" if name else lower
        if closes := sign.startswith("</"):
            ends = bool(stack) and stack[-1][1] == closing
        else:
            ends = not tag and bool(stack) and stack[-1][0] == sign
        if ends:
            stack.pop()
        elif not closes:
            stack.append((sign, closing))
    return stack


def clean_styles(text: str) -> str:
    """As markup.clean_styles: until nothing changes, in no more rounds than places where signs meet."""
    if "</" not in text and "****" not in text and "____" not in text:
        return text
    for _ in range(m + 1 if (m := sum(1 for _ in _MEETING.finditer(text))) else 0):
        before = text
        for pattern in _CLEAN:
            text = pattern.sub("", text)
        if text == before:
            break
    return text


def split_visible(text: str, place: int) -> tuple[str, str]:
    """A text cut before the visible character at a place, as markup.split_visible."""
    if place <= 0:
        return "", text
    if not _MARKED.search(text):
        return (text[:place].rstrip(), text[place:].lstrip()) if place < len(text) else (text, "")
    source = source_place(text, place)
    if source is None:
        return text, ""
    styles = open_styles(text[:source])
    left, closing = text[:source].rstrip(), "".join(closing for _, closing in reversed(styles))
    begun = _BEGUN.search(left)
    left = left[: begun.start()] + closing + begun[0] if begun else left + closing
    return clean_styles(left), clean_styles("".join(sign for sign, _ in styles) + text[source:].lstrip())


def split_at(text: str, places: list[int]) -> list[str]:
    """The pieces of a text cut at several visible places, as markup.split_at."""
    out: list[str] = []
    for place in reversed(places):
        text, right = split_visible(text, place)
        out.append(right)
    return [text, *reversed(out)]
