"""The structure pass over course texts: levels of headings, notes, collections of rulings and boundaries of exams.

What a line is follows from the line alone and is a column expression. What becomes of it also depends on the lines before;
only headings and such marks, without their texts, are folded in order, and the texts are then rewritten in place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import markup as M
from quirework.functions import signs as T
from quirework.functions.rules import branch, plain_title, prose_heading
from quirework.functions.text import roman_value, strip_accents
from quirework.operators.documents import ALTERNATIVE
from quirework.operators.exams import collection_kind_of
from quirework.operators.folds import folded

DEEPEST = 6
HEADING = r"^(#{1,6})[ \t]+(.+)$"
# Courts, names of collections of their rulings and of parts of those, single rulings, and the sign of a note.
COURTS = ("STF", "STJ", "TST")
COLLECTIONS = ("SÚMULAS", "JULGADOS")
PARTS = ("TESES DE REPERCUSSÃO GERAL", "JURISPRUDÊNCIA EM TESES", "RECURSOS REPETITIVOS")
RULING, THEME = r"SÚMULA(?: VINCULANTE)?\s+N[º°o.]?\s*\d+", r"TEMA\s+\d+(?:\s+E\s+\d+)*"
NOTE, NOTE_TITLE = r"(?iu)^ATENÇÃO\s*!", r"^ATENCAO!"
# Fixed value: titles of more characters are no titles of numbered letters.
LONGEST_TITLE = 150

COLLECTION = rf"(?:{'|'.join(COLLECTIONS)})\s+D[OA]\s+"
#: A label of rulings at the end of a line.
END_LABEL = rf"(?<!{M.WORD})(?:{RULING}|{COLLECTION}(?:{'|'.join(COURTS)}))(?={M.SPACE}*$)"
ROMAN = r"(?=[IVXLCDM])M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
NUMBER, NUMBERED_LETTER = r"^(\d+(?:\.\d+)*)\.?(?:\s+|$)", r"^([A-Z])\.(\d+(?:\.\d+)*)\.?(?:\s+|$)"


def content_of(line: Column) -> Column:
    """A heading's text, or else the line."""
    return F.when(line.rlike(HEADING), F.regexp_extract(line, HEADING, 2)).otherwise(line)


def hashes(line: Column) -> Column:
    """A heading's level; 0 for other lines."""
    return F.length(F.regexp_extract(line, HEADING, 1))


def free(line: Column) -> Column:
    """Whether a line is neither quoted nor of a table."""
    return ~(line.startswith(">") | line.startswith("|"))


def _with_label_apart(line: Column) -> Column:
    """The line, or what stands before a label of rulings at its end and the label, if that is bold and a sentence ends before it."""

    def apart(plain: Column) -> Column:
        size = F.length(F.regexp_extract(plain, rf"({END_LABEL})", 1))
        at = F.length(plain) - F.length(F.regexp_extract(plain, rf"({END_LABEL}{M.SPACE}*)$", 1))
        return F.when(size == 0, F.array(line)).otherwise(M.let(M.split_at(line, F.array(at, at + size)), kept))

    def kept(pieces: Column) -> Column:
        before, label = F.get(pieces, F.lit(0)), F.get(pieces, F.lit(1))
        prior = M.visible(before)
        bold = label.contains("**") | label.contains("<b>") | label.contains("<strong>")
        ends = (prior == "") | prior.rlike(r"[.!?]$")
        return F.when(~(bold & ends), F.array(line)).when(prior == "", F.array(M.stripped(label))).otherwise(F.array(M.stripped(before), M.stripped(label)))

    return F.when(free(line) & ~line.startswith("!["), M.let(M.plain(line), apart)).otherwise(F.array(line))


def sorted_lines(line: Column, titles: Column | None = None) -> Column:
    """The lines that a line becomes before levels are given: no heading for a sentence, a heading for a known title, labels of rulings apart."""
    heading = line.rlike(HEADING)
    line = F.when(heading & prose_heading(content_of(line)), content_of(line)).otherwise(line)
    if titles is not None:
        line = F.when(~heading & F.coalesce(F.array_contains(titles, M.visible(line)), F.lit(False)), F.concat(F.lit("### "), line)).otherwise(line)
    named = line.rlike("|".join(("SÚMULA", *COLLECTIONS)))
    return F.when(named, M.let(line, _with_label_apart)).otherwise(F.array(line))


def may_be_event(line: Column) -> Column:
    """A test of one word each, before anything is taken apart."""
    return F.upper(line).rlike("|".join(("ATENÇÃO", "SÚMULA", "TEMA", *COLLECTIONS, *(part.split()[0] for part in PARTS))))


def event(line: Column) -> Column:
    """"note", "collection", "part", "ruling" or null, by a line's visible text."""
    plain = M.visible(content_of(line))
    courts = "|".join((*COURTS, "STF/STJ"))
    return F.when(
        free(line) & may_be_event(line),
        F.when(plain.rlike(NOTE), "note").when(plain.rlike(rf"(?iu)^{COLLECTION}(?:{courts})$"), "collection").when(F.upper(plain).isin(*PARTS), "part").when(plain.rlike(rf"(?iu)^(?:{RULING}|{THEME})$"), "ruling"),
    )


def heading_kind(text: Column, title: Column | None = None) -> Column:
    """(kind, depth, letter, value) of a heading's text; kind is null if nothing says its level. title is its plain_title, if that is at hand."""
    title = plain_title(text) if title is None else title
    key = F.upper(strip_accents(title))
    depth = lambda pattern, group: F.size(F.split(F.regexp_extract(title, pattern, group), r"\."))
    explained = (F.length(title) > LONGEST_TITLE) | text.rlike(r"^\*\*[^*]+\*\*\s+\S")
    one_letter = F.left(title, F.lit(1))
    roman = F.regexp_extract(title, rf"(?i)^({ROMAN})\s*[).](?:\s+|$)", 1)

    def kind(name: str, depth: Column | None = None, letter: Column | None = None, value: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(F.lit(name).alias("kind"), (none if depth is None else depth).cast("int").alias("depth"), (none if letter is None else letter).cast("string").alias("letter"), (none if value is None else value).cast("int").alias("value"))

    return (
        F.when(branch(text), kind("branch"))
        .when(title.rlike(NUMBER), kind("number", depth(NUMBER, 1)))
        .when(title.rlike(NUMBERED_LETTER) & explained, F.lit(None))
        .when(title.rlike(NUMBERED_LETTER), kind("numbered letter", depth(NUMBERED_LETTER, 2)))
        .when(title.rlike(r"^[A-Z]\s*[.)](?:\s+|$)"), kind("letter", None, one_letter, roman_value(one_letter)))
        .when(title.rlike(r"^[a-z]\s*\)(?:\s+|$)"), kind("letter", None, one_letter, roman_value(one_letter)))
        .when(roman != "", kind("roman", None, None, roman_value(roman)))
        .when(key.rlike(NOTE_TITLE), kind("attention"))
    )


class Levels:
    """The open headings of a document, outermost first, each kind once with its level and number."""

    def __init__(self) -> None:
        self.open: dict[str, tuple[int, int | None]] = {}
        self.letter: str | None = None
        self.collection, self.ruling = 2, 4

    def top(self) -> tuple[int, int | None]:
        return list(self.open.values())[-1] if self.open else (1, None)

    def place(self, kind: str, number: int | None = None) -> int:
        """A kind that is open closes what it holds and keeps its level; another one goes under the innermost."""
        if kind in self.open:
            while next(reversed(self.open)) != kind:
                self.open.popitem()
            level = self.open[kind][0]
        else:
            level = min(self.top()[0] + 1, DEEPEST)
        self.open[kind] = (level, number)
        return level

    def of_letter(self, letter: str, number: int | None, in_sequence: bool) -> int:
        """A letter that is a roman number too is one if it is the first, or the next of those open on top, and doesn't follow the letter before."""
        before, self.letter = self.letter, letter
        case = "capital" if letter.isupper() else "small"
        follows = before is not None and before.isupper() == letter.isupper() and ord(letter) == ord(before) + 1
        if not (in_sequence or follows or number is None):
            next_roman = next(reversed(self.open), None) == "roman" and self.top()[1] == number - 1
            if number == 1 or next_roman:
                return self.place("roman", number)
        return self.place(case)

    def of_heading(self, row: dict) -> int | None:
        """A heading's level; null if it is none after all."""
        kind, level = row["kind"], None
        if row["listed"]:
            return None
        if kind == "branch":
            level = 1
        elif kind == "attention":
            level = 2
        elif kind == "number":
            level = min(row["depth"] + 1, DEEPEST)
            self.open, self.letter = {"number": (level, None)}, None
        elif kind == "numbered letter":
            level = min(self.place("capital") + row["depth"], DEEPEST)
            self.open["numbered letter"] = (level, None)
        elif kind == "letter":
            level = self.of_letter(row["letter"], row["value"], row["in_sequence"])
        elif kind == "roman":
            level = self.place("roman", row["value"])
        elif row["known"]:
            level = min((next(iter(self.open.values()))[0] if self.open else 1) + 1, DEEPEST)
        return level

    def step(self, row: dict) -> dict:
        level = self.of_heading(row) if row["heading"] else 0
        action = row["event"] or ("keep" if level else "text")
        if action == "collection":
            self.collection, self.ruling, level = 3, 4, 3
        elif action == "part":
            level = self.collection + 1
            self.ruling = self.collection + 2
        elif action == "ruling":
            level = min(self.ruling, DEEPEST)
        return {"action": action, "level": level}


def marks(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, heading, event, kind, depth, letter, value, known, listed, in_sequence) of the lines that are headings or events.

    listed: a heading of a whole number between lines, which are none, of the number before and the next: an item of a list.
    in_sequence: a letter next to a heading of the letter before or after it. known: a title that the source sets as one.
    """
    line = F.col("line")
    lines = texts.select(key, F.col("titles"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # What is used several times is worked out once, in a step of its own; lines that can be nothing go before it.
    lines = lines.where(line.rlike(HEADING) | may_be_event(line) | line.rlike(r"\d"))
    lines = lines.select("*", line.rlike(HEADING).alias("heading"), M.stripped(line).alias("bare"), content_of(line).alias("content"))
    inner = M.stripped(F.regexp_replace("bare", r"^#+", ""))
    lines = lines.select("*", M.stripped(F.col("content")).alias("said"), F.col("bare").rlike(r"^#{1,6}(\s|$)").alias("hashed"))
    lines = lines.select("*", plain_title(F.col("said")).alias("title"), F.regexp_extract(plain_title(F.when(F.col("hashed"), inner).otherwise(F.col("bare"))), NUMBER, 1).alias("number"))
    number, heading = F.col("number"), F.col("heading")
    whole = F.when((number != "") & ~number.contains("."), number.try_cast("long"))
    rows = lines.select(
        key,
        "pos",
        "heading",
        event(line).alias("event"),
        F.when(heading, heading_kind(F.col("said"), F.col("title"))).alias("k"),
        F.when(heading, F.regexp_extract(plain_title(F.col("content")), r"^([A-Za-z])[.)]\s+", 1)).alias("initial"),
        F.coalesce(F.array_contains("titles", M.visible(F.col("content"))), F.lit(False)).alias("known"),
        F.when(whole.isNotNull(), F.struct(whole.alias("number"), F.col("hashed"))).alias("item"),
    ).where("heading or event is not null or item is not null")
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    near = lambda c, w: F.last(c, ignorenulls=True).over(w)
    rows = rows.select("*", near("item", before).alias("item_before"), near("initial", before).alias("letter_before"), near("item", after).alias("item_after"), near("initial", after).alias("letter_after"))
    beside = lambda c, by: (F.col(c)["number"] == F.col("item.number") + by) & ~F.col(c)["hashed"]
    follows = lambda a, b: (F.length(a) == 1) & (F.length(b) == 1) & (F.ascii(b) == F.ascii(a) + 1)
    listed = F.col("heading") & F.col("item.hashed") & beside("item_before", -1) & beside("item_after", 1)
    in_sequence = follows(F.col("letter_before"), F.col("initial")) | follows(F.col("initial"), F.col("letter_after"))
    return rows.where("heading or event is not null").select(
        key, "pos", "heading", "event", "k.kind", "k.depth", "k.letter", "k.value", "known", F.coalesce(listed, F.lit(False)).alias("listed"), F.coalesce(in_sequence, F.lit(False)).alias("in_sequence")
    )


def _rewritten(texts: DataFrame, decided: DataFrame, lines_of: Callable[[Column, Column], Column], key: str) -> DataFrame:
    """(key, lines, decisions): lines of texts, those that decisions d speak of as lines_of makes them; a text's decisions are one row as its lines are."""
    own = [c for c in decided.columns if c != key]
    by_text = decided.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *(c for c in own if c != "pos")))).alias("decisions"))
    joined = texts.join(by_text, texts[key].eqNullSafe(by_text[key]), "left").drop(by_text[key]).withColumn("lines", F.split("text", "\n"))
    after = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("decisions", k - 1)["pos"] + 1)
    parts = F.transform("decisions", lambda d, k: F.concat(F.slice("lines", after(k) + 1, d["pos"] - after(k)), lines_of(F.get("lines", d["pos"]), d)))
    rest = F.slice("lines", after(F.size("decisions")) + 1, F.size("lines"))
    return joined.select(key, F.when(F.col("decisions").isNull(), F.col("lines")).otherwise(F.concat(F.flatten(parts), rest)).alias("lines"), "decisions")


def _structured_lines(line: Column, d: Column) -> Column:
    plain, text = M.visible(content_of(line)), M.stripped(content_of(line))
    empty = F.lit("")
    heading = F.concat(F.repeat(F.lit("#"), d["level"]), F.lit(" "), F.when(d["action"] == "keep", text).otherwise(plain))
    return (
        F.when(d["action"] == "note", F.array(empty, F.lit("> [!NOTE]"), F.concat(F.lit("> "), text), empty))
        .when(d["action"] == "text", F.array(text))
        .when(d["action"] == "keep", F.array(heading))
        .otherwise(F.array(empty, heading, empty))
    )


def structured(documents: DataFrame, key: str = "doc_id", text: str = "text", titles: str | None = None) -> DataFrame:
    """(key, text) of documents with their structure put right.

    Headings that are sentences, items of lists or without a sign of level become text; the others get levels by their numbers
    and letters. Labels of rulings stand alone, and notes, collections, their parts and rulings have their forms and levels.
    titles is a column with an array of titles that the source sets as such. A null text is empty; keys don't repeat.
    """
    known = (F.col(titles) if titles else F.lit(None)).cast("array<string>")
    texts = documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"), known.alias("titles"))
    sorted_ = F.flatten(F.transform(F.split("text", "\n"), lambda x: sorted_lines(x, F.col("titles") if titles else None)))
    texts = texts.withColumn("text", F.array_join(sorted_, "\n"))
    decided = folded(marks(texts, key), key, "pos", Levels, Levels.step, "action string, level int")
    return _rewritten(texts, decided, _structured_lines, key).select(key, F.array_join("lines", "\n").alias("text"))


class Exam:
    """The collection that a document's lines are in, and the question, with the places that lines have once the lines before are rewritten."""

    def __init__(self) -> None:
        self.kind: str | None = None
        self.level = 2
        self.shift = 0
        self.above: list[tuple[int, bool]] = []
        self.question: int | None = None

    def action(self, level: int, collection: str | None, question: bool, answer: bool, said: str) -> tuple[str, int]:
        if collection:
            self.kind, self.level = collection, level
        elif self.kind == "questions" and question or self.kind == "answers" and answer:
            return ("question" if self.kind == "questions" else "answer"), min(self.level + 1, DEEPEST)
        elif level and self.kind and level <= self.level:
            if _INNER.match(said):
                return "text", 0
            self.kind = None
        return "stay", level

    def asks(self, level: int, titled: bool, questions: bool) -> bool:
        """Whether a heading begins a question's body: under a collection of questions, up to the next of its level or above."""
        self.above = [x for x in self.above if x[0] < level]
        if self.question is not None and level <= self.question:
            self.question = None
        asked = self.question is None and titled and any(of_questions for _, of_questions in self.above)
        if asked:
            self.question = level
        self.above.append((level, questions))
        return asked

    def step(self, pos: int, level: int, collection: str | None, question: bool, answer: bool, titled: bool, said: str) -> tuple[str, int, int, bool, bool]:
        """(action, level, at, asked, outside) of a line that is a heading or begins like a question or an answer."""
        action, level = self.action(level, collection, question, answer, said)
        at = pos + self.shift + (action in LINES_MADE)
        asked = bool(level) and self.asks(level, titled or action == "question", collection == "questions")
        self.shift += LINES_MADE.get(action, 1) - 1
        return action, level, at, asked, bool(level) and self.question is None


LINES_MADE = {"question": 4, "answer": 3}
QUESTION, ANSWER = r"^\d+\.\s*\([^\n)]+\)", r"^\d+\.\s*[A-Z]\s*$"


_HEADING = re.compile(rf"(#{{1,6}})[ \t]+([^{T.LINE_ENDS}]+){T.END}")
_QUESTION, _ANSWER, _TITLED = (re.compile(p, re.ASCII) for p in (QUESTION, rf"{ANSWER[:-1]}\Z", r"^\d+\.\s*\("))
_ALTERNATIVE = re.compile(ALTERNATIVE.replace(r"(?<!\S)", rf"(?<![^{T.BLANK}])"))
_INNER = re.compile(rf"(?:{_ALTERNATIVE.pattern}|§|[Aa]rt\.)")
_LISTED, _LAST_LINE, _LAST_END = (re.compile(p + T.END) for p in (r"(?:^|\n)[ \t]*-[ \t]+", r"\n[^\n]*", r"\n"))
_BARE = re.compile(r"(?:(?<=\s)|^)(?:\*{4}|_{4})\s*\Z")
_EMPTY_LINES, _LAST_LINES = re.compile(r"\n\n\n+"), re.compile(r"\n+" + T.END)


def _alternative_places(text: str) -> list[int]:
    """Where the alternatives of a question's visible text begin; none if they are not one sequence, as documents.alternatives says."""
    marks = list(_ALTERNATIVE.finditer(text))
    labels = [(m[1] or m[2]).upper() for m in marks]
    if "A" not in labels:
        return []
    first = len(labels) - 1 - labels[::-1].index("A")
    told_apart = labels.count("A") == 1 or all(m[2] and m[2].islower() for m in marks[:first]) and all(m[1] and m[1].isupper() for m in marks[first:])
    if not told_apart or len(labels) - first < 2 or any(ord(x) != k + 65 for k, x in enumerate(labels[first:])):
        return []
    return [m.start() for m in marks[first:]]


def with_alternatives_apart(body: str) -> str:
    """A question's body with an empty line before each alternative, if those are one sequence from A on; else as it is.

    The sign of a list that stands before an alternative goes.
    """
    if "A)" not in body and "a)" not in body and not T.marked(body):
        return body
    text = T.plain(body)
    places = _alternative_places(text)
    if not places:
        return body
    # Without signs of style the pieces are simply what stands between the places.
    signed = bool(T.marked(body))
    *pieces, last = T.split_at(body, places) if signed else [body[a:b] for a, b in zip([0, *places], [*places, len(body)], strict=True)]
    out = []
    for piece, place in zip(pieces, places, strict=True):
        before = text[:place]
        piece = piece if signed else piece.rstrip()
        if before.rstrip().endswith("-") and _LISTED.search(before):
            piece = _LAST_LINE.sub("", piece) if "\n" in piece else ""
        piece = piece.rstrip()
        # A pair of marks around nothing, of a style that begins at the cut, goes too.
        out.append(_BARE.sub("", piece).rstrip() if signed and piece.endswith(("****", "____")) else piece)
    out.append(_LAST_END.sub("", last) if "\n" in last[-3:] else last)
    return "\n\n".join([out[0], *(piece.lstrip() for piece in out[1:])])


def with_exam_boundaries(text: str) -> str:
    """One text of exam_boundaries. Its lines are gone through in order; of those before, only the state of Exam is kept."""
    exam, lines = Exam(), []
    bounds: list[tuple[int, bool]] = [(0, False)]
    for pos, line in enumerate(text.split("\n")):
        # Only headings and what begins bold can be of an exam.
        found = _HEADING.match(line) if line.startswith("#") else None
        if not found and not line.startswith("**") and not (line[:1].isspace() and line.lstrip().startswith("**")):
            lines.append(line)
            continue
        level, content = (len(found[1]), found[2]) if found else (0, line)
        seen = T.plain(content)
        said = seen.strip()
        numbered = said[:1].isdigit()
        question = _QUESTION.match(said) if numbered else None
        answer = numbered and not question and _ANSWER.match(said) is not None
        if not (level or question or answer):
            lines.append(line)
            continue
        titled = question is not None or numbered and _TITLED.match(said) is not None
        action, level, at, asked, outside = exam.step(pos, level, collection_kind_of(said) if found else None, question is not None, answer, titled, said)
        if action == "question":
            left, right = T.split_visible(content, len(seen) - len(seen.lstrip()) + question.end())
            lines += ("", f"{'#' * level} {left.strip()}", "", right.strip())
        elif action == "answer":
            lines += ("", f"{'#' * level} {content.strip()}", "")
        else:
            lines.append(content if action == "text" else line)
        if asked:
            bounds += [(at, False), (at + 1, True)]
        elif outside:
            bounds.append((at, False))
    parts: list[str] = []
    for (start, body), end in zip(bounds, [*(at for at, _ in bounds[1:]), len(lines)], strict=True):
        if body and start < end:
            parts.append(with_alternatives_apart("\n".join(lines[start:end])))
        else:
            parts += lines[start:end]
    made = _EMPTY_LINES.sub("\n\n", "\n".join(parts))
    if "\n" in made[-3:]:
        size = len(made.rstrip("\n\r\x85\u2028\u2029"))
        made = made[:size] + _LAST_LINES.sub("\n", made[size:])
    return made


def exam_boundaries(documents: DataFrame, key: str = "doc_id", text: str = "text", settled: str | None = None) -> DataFrame:
    """(key, text) of documents whose questions and answers are headings under their collections, with the alternatives of questions apart.

    Headings of the collections' level that are alternatives or citations become text, others end the collection. Several empty
    lines become one, and none at the end, so a second pass changes nothing. A null text is empty; keys don't repeat. What becomes of
    a line depends on those before it in its text, which is one row, so a text is gone through where it is. settled names a column that
    tells whether a second pass did change nothing; without it none is made.
    """
    texts = documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [with_exam_boundaries(t.as_py()) for t in batch.column("text")]
            columns = [batch.column(key), pa.array(made, pa.string())]
            if settled:
                columns.append(pa.array([with_exam_boundaries(t) == t for t in made], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "text", *([settled] if settled else [])]
    return texts.mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, text string" + (f", `{settled}` boolean" if settled else ""))


def split_headings(documents: DataFrame, suffixes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of documents whose numbered headings are two where their ends are headings of their own in the source.

    suffixes has (key, suffix), titles such as "A. Name" that the source sets as headings; of several the longest counts. The places
    where a heading may end so are few and meet the suffixes by an equality join. A null text is empty; keys don't repeat.
    """
    texts = documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = texts.select(F.col(key).alias("_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(HEADING))

    def ends_of(plain: Column) -> Column:
        end = lambda pieces, k: F.array_join(F.slice(pieces, k + 1, F.size(pieces)), " ")
        all_ends = lambda pieces: F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: end(pieces, k)))
        placed = lambda suffixes: F.transform(suffixes, lambda x: F.struct((F.length(plain) - F.length(x)).alias("place"), x.alias("suffix")))
        return F.when(plain.rlike(NUMBER), placed(M.let(F.split(plain, r" (?=[A-Z]\.\s)", -1), all_ends)))

    # Bound by let, since what is visible would be worked out anew for each use.
    ends = lines.select("_key", "pos", F.inline(M.let(M.let(F.regexp_extract("line", HEADING, 2), M.visible), ends_of)))
    known = suffixes.select(F.col(key).alias("_known"), F.col("suffix").alias("_suffix"))
    proved = ends.join(known, ends["_key"].eqNullSafe(known["_known"]) & (ends["suffix"] == known["_suffix"]), "left_semi")
    decided = proved.groupBy(F.col("_key").alias(key), "pos").agg(F.min("place").alias("place"))

    def two(line: Column, d: Column) -> Column:
        mark = F.concat(F.regexp_extract(line, HEADING, 1), F.lit(" "))
        # Only signs hide white space at the beginning of what is stripped.
        lead = lambda content: F.when(content.rlike(M.MARKED), M.let(M.plain(content), lambda p: F.length(p) - F.length(M.left_stripped(p)))).otherwise(0)
        halves = lambda content: M.split_visible(content, d["place"] + lead(content))
        return M.let(M.let(M.left_stripped(F.regexp_extract(line, HEADING, 2)), halves), lambda s: F.array(F.concat(mark, s["left"]), F.lit(""), F.concat(mark, s["right"])))

    return _rewritten(texts, decided, two, key).select(key, F.array_join("lines", "\n").alias("text"))


# How often a style must set numbered labels, and how long a title set in capitals may be.
LEAST_NUMBERED, LONGEST_CAPITALS = 2, 100


def set_titles(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, titles) of lines of (key, text, label, bold, size, font): lines that the source sets as titles, an array of distinct ones in order.

    A title is bold, in capitals, not long, has no closing sign, and is set in a style (size to a tenth, font) in which the document sets
    at least two numbered labels. label is the line's bold beginning, null without one; bold says that all of the line is. Documents
    without titles have no row; lines without a document, size or font are of no style.
    """
    styled = lines.select(key, F.trim("text").alias("text"), "label", "bold", F.round("size", 1).alias("size"), "font")
    numbered = styled.where(F.col("label").rlike(r"^(?:\d+(?:\.\d+)*\.?|[A-Z][.)])\s+"))
    styles = numbered.groupBy(key, "size", "font").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_NUMBERED).drop("n")
    text = F.col("text")
    capitals = (text == F.upper(text)) & text.rlike(r"\p{Lu}")
    titles = styled.where(F.col("bold") & capitals & (F.length(text) < LONGEST_CAPITALS) & ~text.rlike(r"[.;:!?]$"))
    return titles.join(styles, [key, "size", "font"], "left_semi").groupBy(key).agg(F.array_sort(F.collect_set("text")).alias("titles"))
