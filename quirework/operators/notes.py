"""Boxes of notes: those that go on over pages, and the paragraphs that stand in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import markup as M
from quirework.functions.rules import same_characters
from quirework.operators.folds import folded
from quirework.operators.repair import PARAGRAPH_END

# Words that begin a note, and the signs after them.
CALLOUTS = (("ATENÇÃO", r"\s*!"), ("OBSERVAÇÃO", r"\s*:"), ("OBS", r"\."), ("IMPORTANTE", r"\s*:"), ("NOTA", r"\s*:"), ("CUIDADO", r"\s*[!:]"), ("DICA", r"\s*:"), ("LEMBRE-SE", r"\s*[!:]"))
# How far down a page a box ends that goes on, how far up the next begins, and how far its sides and lines may be off.
GOES_ON, BEGINS, SIDE_OFF, LINE_OFF = 0.85, 0.18, 2, 2
#: Letters of a note's beginning that a table's note must share with its box.
TABLE_PREFIX = 80
MARKER = r"<!-- PAGE page=(\d+)[^>]*-->"


def is_callout(text: Column) -> Column:
    return text.rlike("(?iu)^(?:" + "|".join(word + signs for word, signs in CALLOUTS) + ")")


class Chains:
    """Notes that are open at the end of a page, by their first box, each with the box it has reached."""

    def __init__(self) -> None:
        self.page: int | None = None
        self.open: list[tuple[tuple[int, int], dict]] = []

    def step(self, row: dict) -> dict:
        boxes, followed = row["boxes"], []
        going = self.open if self.page is not None and row["page"] == self.page + 1 else []
        begins = [b for b in boxes if not b["callout"] and b["y0"] <= row["height"] * BEGINS and not (row["first_line"] is not None and row["first_line"] < b["y0"] - LINE_OFF)]
        reached = []
        for note, last in going:
            next_ = [b for b in begins if abs(b["x0"] - last["x0"]) <= SIDE_OFF and abs(b["x1"] - last["x1"]) <= SIDE_OFF]
            if len(next_) == 1:
                followed.append({"note_page": note[0], "note_box": note[1], "box": next_[0]["box"]})
                reached.append((note, next_[0]))
        for b in boxes:
            if b["callout"]:
                followed.append({"note_page": row["page"], "note_box": b["box"], "box": b["box"]})
                reached.append(((row["page"], b["box"]), b))
        ends = lambda b: b["y1"] < row["height"] * GOES_ON or (row["last_line"] is not None and row["last_line"] > b["y1"] + LINE_OFF)
        self.page, self.open = row["page"], [(note, b) for note, b in reached if not ends(b)]
        return {"followed": followed}


def note_boxes(boxes: DataFrame, lines: DataFrame, doc: str = "doc_id", parts: int | None = None) -> DataFrame:
    """(doc, page, note_box, last_page, content) of the notes among boxes of (doc, page, box, x0, y0, x1, y1, height, content).

    A note begins in a box whose content begins with a callout. It goes on in a box at the top of the next page if it ends at the foot of
    its own, no line of (doc, page, y) stands below it or above the other, and exactly one box without a callout has the same
    sides. A page's boxes are one row of an ordered fold, so chains of any length take one pass. parts is a number of tasks of that
    fold; boxes and lines that are dealt by doc over as many stay where they are.
    """
    edges = lines.groupBy(doc, "page").agg(F.min("y").alias("first_line"), F.max("y").alias("last_line"))
    box = F.struct("box", "x0", "y0", "x1", "y1", is_callout(F.col("content")).alias("callout"))
    pages = boxes.groupBy(doc, "page").agg(F.max("height").alias("height"), F.array_sort(F.collect_list(box)).alias("boxes")).join(edges, [doc, "page"], "left")
    found = folded(pages, doc, "page", Chains, Chains.step, "followed array<struct<note_page: int, note_box: int, box: int>>", parts)
    followed = found.select(doc, "page", F.explode("followed").alias("f")).select(doc, "page", "f.*").join(boxes.select(doc, "page", "box", "content"), [doc, "page", "box"])
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "content"))), lambda x: x["content"]), " ")
    return followed.groupBy(doc, F.col("note_page").alias("page"), "note_box").agg(F.max("page").alias("last_page"), content.alias("content"))


def letters_of(text: Column) -> Column:
    """What is compared: letters and digits that are seen, in lower case, without the sign of a note."""
    return F.lower(F.regexp_replace(M.plain(F.replace(text, F.lit("[!NOTE]"), F.lit(""))), r"[^\p{L}\p{N}]+", ""))


def unquoted(text: Column) -> Column:
    """A paragraph without signs of quotation, note and heading."""
    bare = F.regexp_replace(M.stripped(text), r"(?m)^\s*>[ \t]?", "")
    return M.stripped(F.regexp_replace(F.regexp_replace(bare, r"^\[!NOTE\]\s*", ""), r"(?m)^#{1,6}\s+", ""))


class Apart:
    """Groups in order, without those that begin in one that is kept."""

    def __init__(self) -> None:
        self.until = -1

    def step(self, row: dict) -> dict:
        free = row["k"] > self.until
        if free:
            self.until = row["until"]
        return {"until": row["until"], "free": free}


def grouped_notes(documents: DataFrame, notes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_grouped) of documents whose notes are one quotation each, if the source has them in boxes.

    A note is a paragraph that begins with a callout, with as many of the following ones as its box of the same page holds: their
    letters and digits, one after the other, are the box's. Paragraphs of tables may be in another order, but must have the same
    letters equally often and the same beginning. notes has (key, page, last_page, content). Only sums of lengths
    are compared to find where a note ends. Pages follow the markers in the text. A null text is empty; keys don't repeat.
    """
    rows = documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("parts", F.split("text", PARAGRAPH_END, -1)).withColumn("gaps", F.regexp_extract_all("text", F.lit(PARAGRAPH_END), F.lit(0)))
    parts = rows.select(F.col(key).alias("_key"), F.posexplode("parts").alias("k", "part"))
    marks = F.transform(F.regexp_extract_all("part", F.lit(MARKER), F.lit(1)), lambda x: x.cast("int"))
    parts = parts.select("_key", "k", "part", letters_of(F.col("part")).alias("letters"), marks.alias("marks"), letters_of(F.regexp_extract("part", rf"(?s)^(.*?){MARKER}", 1)).alias("before_mark"))
    by_text = Window.partitionBy("_key").orderBy("k")
    so_far, earlier = by_text.rowsBetween(Window.unboundedPreceding, 0), by_text.rowsBetween(Window.unboundedPreceding, -1)
    last_mark = F.when(F.size("marks") > 0, F.element_at("marks", -1))
    own = F.when((F.size("marks") > 0) & (F.col("before_mark") == ""), F.get("marks", F.lit(0)))
    parts = parts.select(
        "_key",
        "k",
        "letters",
        F.coalesce(own, F.last(last_mark, ignorenulls=True).over(earlier), F.lit(1)).alias("page"),
        F.coalesce(F.max(F.array_max("marks")).over(so_far), F.lit(1)).alias("top_page"),
        F.sum(F.length("letters")).over(so_far).alias("end"),
        F.sum(F.regexp_replace("part", r"^\s+", "").startswith("|").cast("int")).over(so_far).alias("tables"),
        unquoted(F.col("part")).alias("label"),
    )
    labels = parts.where(is_callout(M.visible(F.col("label")))).select("_key", "k", "page", F.col("tables").alias("tables_before"), (F.col("end") - F.length("letters")).alias("begin"), F.col("letters").alias("own"))
    boxes = notes.select(F.col(key).alias("_doc"), F.col("page").alias("_page"), "last_page", letters_of(F.col("content")).alias("wanted"))
    # The page's boxes that begin as the note does; a page has few.
    asked = labels.join(boxes, labels["_key"].eqNullSafe(boxes["_doc"]) & (labels["page"] == boxes["_page"]) & F.col("wanted").startswith(F.left("own", F.lit(TABLE_PREFIX)))).drop("_doc", "_page")
    asked = asked.withColumn("target", F.col("begin") + F.length("wanted"))
    ends = parts.select(F.col("_key").alias("_doc"), F.col("k").alias("until"), F.col("end").alias("_end"), F.col("tables").alias("tables_until"), "top_page")
    met = asked.join(ends, asked["_key"].eqNullSafe(ends["_doc"]) & (F.col("target") == F.col("_end")) & (F.col("until") >= F.col("k")) & ((F.col("until") == F.col("k")) | (F.col("top_page") <= F.col("last_page"))))
    first = met.groupBy("_key", "k", "own", "wanted", "begin", "tables_before").agg(F.min_by(F.struct("until", "tables_until"), "until").alias("e"))
    letters = parts.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "letters"))), lambda x: x["letters"]), "").alias("all")).withColumnRenamed("_key", "_doc")
    held = first.join(letters, first["_key"].eqNullSafe(letters["_doc"])).withColumn("actual", F.substring("all", F.col("begin").cast("int") + 1, F.length("wanted")))
    fits = (F.col("actual") == F.col("wanted")) | ((F.col("e.tables_until") > F.col("tables_before")) & same_characters(F.col("actual"), F.col("wanted")))
    found = held.where(fits).groupBy("_key", "k").agg(F.min("e.until").alias("until"))
    kept = folded(found.select(F.col("_key").alias(key), "k", "until"), key, "k", Apart, Apart.step, "until int, free boolean").where("free")
    groups = kept.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("k", "until"))).alias("groups"))
    joined = rows.join(groups, rows[key].eqNullSafe(groups["_key"]), "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<struct<k: int, until: int>>"))).withColumn("zipped", F.arrays_zip("parts", "gaps"))
    line = lambda x: F.when(M.stripped(x) == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x))
    quoted = lambda part: F.array_join(F.transform(F.split(unquoted(part), "\n"), line), "\n")
    plain = lambda a, b: F.array_join(F.transform(F.slice("zipped", a + 1, b - a), lambda x: F.concat(x["parts"], F.coalesce(x["gaps"], F.lit("")))), "")
    after = lambda n: F.when(n == 0, F.lit(0)).otherwise(F.get("groups", n - 1)["until"] + 1)
    note = lambda g: F.concat(F.lit("> [!NOTE]\n"), F.array_join(F.transform(F.slice("parts", g["k"] + 1, g["until"] - g["k"] + 1), quoted), "\n>\n"), F.coalesce(F.get("gaps", g["until"]), F.lit("")))
    written = F.transform("groups", lambda g, n: F.concat(plain(after(n), g["k"]), note(g)))
    whole = F.concat(F.array_join(written, ""), plain(after(F.size("groups")), F.size("parts")))
    return joined.select(key, F.when(F.size("groups") == 0, F.col("text")).otherwise(whole).alias("text"), F.size("groups").alias("n_grouped"))
