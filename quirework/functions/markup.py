"""Text with marks of style: its visible characters with their places, and cuts that close and open styles again.

Everything is a column expression on one line or paragraph. A text is taken apart into its signs of style and the
pieces between them; the places of visible characters are kept as runs, one for each piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.text import INLINE, STYLES

#: What counts as white space and as a letter or digit of a word, beyond ASCII too.
SPACE, WORD = r"[\s\x1c-\x1f\x85\p{Z}]", r"[\p{L}\p{N}_]"
COMMENT, BREAK = r"<!--[\s\S]*?-->", r"<br\s*/?>"
TAG = rf"</?(?:{'|'.join(INLINE)})\b[^>]*>"
DELIMITERS = ("**", "__")
#: A sign of style: a comment, a tag, a line break, a pair of marks, or a mark at the edge of a word.
SIGN = "|".join((COMMENT, TAG, BREAK, r"\*\*", "__", rf"(?<!{WORD})[*_]", rf"[*_](?!{WORD})"))
#: No sign of style is without one of these.
MARKED = "[<*_]"
#: The beginning of a tag that a text's end cuts off; whatever follows with a closing sign in it would make it a tag.
BEGUN = rf"</?(?:{'|'.join(INLINE)})\b[^>]*$"
#: Ends of lines; the sign stays with its line.
LINE_END = r"(?<=[\n\x0b\x0c\x1c-\x1e\x85  ])|(?<=\r)(?!\n)"
RUN = "struct<at: int, source: int, size: int>"


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def left_stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+", "")


def right_stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+$", "")


def stripped(text: Column) -> Column:
    return left_stripped(right_stripped(text))


def signs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SIGN), F.lit(0))


def _around(text: Column, pattern: str) -> Column:
    """Pieces as long as those between the matches of a pattern."""
    sign = "\uffff"
    return F.split(F.regexp_replace(F.translate(text, sign, "x"), pattern, sign), sign, -1)


def _is_break(sign: Column) -> Column:
    return sign.startswith("<br")


def plain(text: Column) -> Column:
    """The visible characters: everything but signs of style, and a line end for each tag of a line break."""
    return F.when(text.rlike(MARKED), F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), SIGN, "")).otherwise(text)


def visible(text: Column) -> Column:
    """What a reader sees, without white space at its ends."""
    return stripped(plain(text))


def runs(text: Column) -> Column:
    """Runs (at, source, size): so many visible characters from the place at on come from the source's place on, both from 0.

    The line end of a tag is a run of its own; so every place of the visible text is in exactly one run.
    """
    pairs = F.arrays_zip(_around(text, SIGN).alias("piece"), signs(text).alias("sign"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("source"), none_of(RUN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        size = F.length(pair["piece"])
        sign = F.coalesce(pair["sign"], F.lit(""))
        broken = _is_break(sign)
        at, source = acc["at"] + size, acc["source"] + size
        run = F.when(size > 0, F.array(F.struct(acc["at"].alias("at"), acc["source"].alias("source"), size.alias("size")))).otherwise(none_of(RUN))
        end = F.when(broken, F.array(F.struct(at.alias("at"), source.alias("source"), F.lit(1).alias("size")))).otherwise(none_of(RUN))
        return F.struct((at + broken.cast("int")).alias("at"), (source + F.length(sign)).alias("source"), F.concat(acc["out"], run, end).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def source_place(runs_of_text: Column, place: Column) -> Column:
    """Where the visible character at a place stands in the source; null beyond the end."""
    run = F.get(F.filter(runs_of_text, lambda r: (r["at"] <= place) & (place < r["at"] + r["size"])), F.lit(0))
    return let(run, lambda r: r["source"] + place - r["at"])


def open_styles(text: Column) -> Column:
    """The styles that are open at a text's end, outermost first, as (sign, closing).

    A closing tag ends the innermost style only if that is its own; a mark ends the innermost style if that is the same mark.
    """
    none = none_of("struct<sign: string, closing: string>")

    def token(sign: Column) -> Column:
        closing = F.regexp_replace(F.lower(sign), r"^</?(\w+).*$", "</$1>")
        return F.struct(sign.alias("sign"), F.when(sign.startswith("<"), closing).otherwise(sign).alias("closing"), sign.startswith("</").alias("closes"), (~sign.startswith("<")).alias("mark"))

    def step(stack: Column, t: Column) -> Column:
        top = F.get(stack, F.size(stack) - 1)
        popped = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        ends = F.coalesce(F.when(t["closes"], top["closing"] == t["closing"]).otherwise(t["mark"] & (top["sign"] == t["sign"])), F.lit(False))
        return F.when(ends, popped).when(t["closes"], stack).otherwise(F.concat(stack, F.array(F.struct(t["sign"].alias("sign"), t["closing"].alias("closing")))))

    styles = F.filter(signs(text), lambda s: ~(s.startswith("<!--") | _is_break(s)))
    return F.aggregate(F.transform(styles, token), none, step)


def clean_styles(text: Column) -> Column:
    """Styles around nothing go, and styles that end and begin again at one place go on, until nothing of the kind is left.

    What goes can uncover the next; there are no more rounds than places where signs meet.
    """
    name = f"({'|'.join(STYLES)})"

    def once(t: Column) -> Column:
        t = F.regexp_replace(t, rf"<{name}>{SPACE}*</\1>", "")
        t = F.regexp_replace(t, rf"</{name}><\1>", "")
        return F.regexp_replace(t, r"(?<=\S)(?:\*{4}|_{4})(?=\S)", "")

    meeting = F.size(F.regexp_extract_all(text, F.lit(rf"</?{name}>(?={SPACE}*</?{name}>)|\*{{4}}|_{{4}}"), F.lit(0)))
    return F.when(meeting == 0, text).otherwise(F.aggregate(F.sequence(F.lit(0), meeting), text, lambda t, _: once(t)))


def split_visible(text: Column, place: Column) -> Column:
    """(left, right): a text cut before the visible character at a place, from 0.

    Styles that are open at the cut are closed on the left and opened again on the right, so both show together what the
    whole shows, but for white space at the cut. Where the left ends like the beginning of a tag (</u of </ul>), styles are closed
    before that, as their closing would end it. A place at or before the beginning, or at or beyond the end, leaves one side empty.
    A text without signs is not taken apart.
    """

    def closed(t: Column, closing: Column) -> Column:
        return F.when(t.rlike(BEGUN), F.concat(F.regexp_replace(t, BEGUN, ""), closing, F.regexp_extract(t, BEGUN, 0))).otherwise(F.concat(t, closing))

    def cut(t: Column, source: Column) -> Column:
        left, right = F.left(t, source), F.substring(t, source + 1, F.length(t))
        return let(
            open_styles(left),
            lambda styles: F.struct(
                let(let(right_stripped(left), lambda t: closed(t, F.array_join(F.transform(F.reverse(styles), lambda s: s["closing"]), ""))), clean_styles).alias("left"),
                let(F.concat(F.array_join(F.transform(styles, lambda s: s["sign"]), ""), left_stripped(right)), clean_styles).alias("right"),
            ),
        )

    nothing = F.lit("")
    both = lambda left, right: F.struct(left.alias("left"), right.alias("right"))

    def unmarked(t: Column, at: Column) -> Column:
        return F.when(at < F.length(t), both(right_stripped(F.left(t, at)), left_stripped(F.substring(t, at + 1, F.length(t))))).otherwise(both(t, nothing))

    def at_place(t: Column, at: Column) -> Column:
        marked = let(source_place(runs(t), at), lambda source: F.when(source.isNull(), both(t, nothing)).otherwise(cut(t, source)))
        return F.when(at <= 0, both(nothing, t)).when(~t.rlike(MARKED), unmarked(t, at)).otherwise(marked)

    return let(text, lambda t: let(place, lambda at: at_place(t, at)))


def split_at(text: Column, places: Column) -> Column:
    """The pieces of a text cut at several visible places, given in order. Cuts are made from the last on, so the places before stay right."""

    def step(acc: Column, place: Column) -> Column:
        return let(split_visible(acc["rest"], place), lambda s: F.struct(s["left"].alias("rest"), F.concat(F.array(s["right"]), acc["out"]).alias("out")))

    return F.aggregate(F.reverse(places), F.struct(text.alias("rest"), none_of("string").alias("out")), step, lambda acc: F.concat(F.array(acc["rest"]), acc["out"]))


def match_places(text: Column, pattern: str) -> Column:
    """Where the matches of a pattern begin in a text, from 0."""
    pairs = F.arrays_zip(_around(text, pattern).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    start = F.struct(F.lit(0).alias("at"), none_of("int").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["piece"])
        found = F.when(pair["match"].isNull(), none_of("int")).otherwise(F.array(at))
        return F.struct((at + F.coalesce(F.length(pair["match"]), F.lit(0))).alias("at"), F.concat(acc["out"], found).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def repaired_emphasis(text: Column) -> Column:
    """White space put outside of pairs of marks, line by line, so that the marks stand at words.

    In a line with an even number of marks of a kind every second piece between them is emphasised. A line with an odd number,
    escaped marks and pieces without words stay. What is seen doesn't change.
    """

    def moved(piece: Column, mark: str) -> Column:
        body = stripped(piece)
        lead = F.regexp_extract(piece, rf"^({SPACE}*)", 1)
        trail = F.regexp_extract(piece, rf"({SPACE}*)$", 1)
        return F.when(body == "", F.concat(F.lit(mark), piece, F.lit(mark))).otherwise(F.concat(lead, F.lit(mark), body, F.lit(mark), trail))

    def one_kind(line: Column, mark: str) -> Column:
        parts = F.split(line, r"(?<!\\)" + "".join("\\" + c for c in mark), -1)
        return let(parts, lambda all: F.when(F.size(all) % 2 == 1, F.array_join(F.transform(all, lambda p, k: F.when(k % 2 == 1, moved(p, mark)).otherwise(p)), "")).otherwise(line))

    def line(value: Column) -> Column:
        # A line without marks isn't taken apart.
        bold, underlined = DELIMITERS
        moved_in = lambda v, mark: F.when(v.contains(mark), one_kind(v, mark)).otherwise(v)
        return let(moved_in(value, bold), lambda v: moved_in(v, underlined))

    return F.array_join(F.transform(F.split(text, LINE_END, -1), line), "")
