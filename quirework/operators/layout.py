"""Geometry of pages: text boxes to lines, segments to boxes, tables over pages, margins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOLERANCE = 2.0
MARGIN = 0.1


def in_margin(y0: Column, y1: Column, height: Column) -> Column:
    """Whether a box lies in the outer tenth of its page."""
    return (y1 <= height * MARGIN) | (y0 >= height * (1 - MARGIN))


def valid_field(label: Column, value: Column) -> Column:
    """Whether a value fits its label: digits of numbers, the form of addresses, two words of names."""
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    return (
        F.when(label == "tax_id", digits.isin(11, 14))
        .when(label == "phone", digits.between(10, 13))
        .when(label == "email", value.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))
        .when(label == "name", F.size(F.split(F.trim(value), r"\s+")) >= 2)
        .otherwise(False)
    )


def edge_image(x0: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Whether an image may be an ornament of the page's right edge."""
    return (x0 >= page_width * 0.88) & (width <= page_width * 0.13) & (height <= page_height * 0.15)


def text_lines(boxes: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, text, heading) of recognised boxes of (text, score, x_min, y_min, x_max, y_max).

    Boxes come from top to bottom. One belongs to the line before it if its middle is near that line's mean
    middle: within 0.45 of the lower height, two at least. The mean moves with each box, so a
    page is an ordered fold; its boxes are bounded by the page. Tall lines are headings.
    """

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        rows = page.assign(mid=(page.y_min + page.y_max) / 2, tall=page.y_max - page.y_min).sort_values(["mid", "x_min"])
        lines: list[list] = []
        for r in rows.itertuples():
            last = lines[-1] if lines else None
            if last and abs(r.mid - sum(x.mid for x in last) / len(last)) <= max(TOLERANCE, 0.45 * min(r.tall, *(x.tall for x in last))):
                last.append(r)
            else:
                lines.append([r])
        heights = [max(x.tall for x in line) for line in lines]
        mean = sum(heights) / len(heights)
        out = [(*(page[k].iloc[0] for k in keys), n, " ".join(x.text for x in sorted(line, key=lambda x: x.x_min)), bool(h >= 1.38 * mean)) for n, (line, h) in enumerate(zip(lines, heights, strict=True))]
        return pd.DataFrame(out, columns=[*keys, "line", "text", "heading"])

    kinds = ", ".join(f"{k} {boxes.schema[k].dataType.simpleString()}" for k in keys)
    return boxes.where("score >= 0.35").groupBy(*keys).applyInPandas(fold, f"{kinds}, line int, text string, heading boolean")


def _bands(value: Column, both: bool = False) -> Column:
    """The band of a value; both: all bands, two at most, that hold values within the tolerance of it."""
    band = lambda v: F.floor(v / (4 * TOLERANCE)).cast("long")
    return F.explode(F.array_distinct(F.array(band(value - 1.5 * TOLERANCE), band(value + 1.5 * TOLERANCE)))) if both else band(value)


def closed_boxes(segments: DataFrame) -> DataFrame:
    """(page, x0, y0, x1, y1) of boxes from segments of (page, x0, y0, x1, y1): two uprights of one extent that a level segment joins at both ends.

    Level segments lead to the uprights at their ends, never uprights to each other, so rows follow corners and not pairs of uprights.
    Every join has the page and bands of two coordinates as equalities. Segments that are drawn again count once.
    """
    near = lambda a, b: F.abs(a - b) <= TOLERANCE
    c = F.col
    upright = segments.where(near(c("x0"), c("x1"))).select("page", c("x0").alias("x"), F.least("y0", "y1").alias("top"), F.greatest("y0", "y1").alias("low")).distinct()
    level = segments.where(near(c("y0"), c("y1"))).select("page", c("y0").alias("y"), F.least("x0", "x1").alias("left"), F.greatest("x0", "x1").alias("right")).distinct()
    at = upright.select("*", _bands(c("x")).alias("across"), _bands(c("top")).alias("down"))
    over = level.select("*", _bands(c("left"), True).alias("across")).select("*", _bands(c("y"), True).alias("down"))
    first = over.join(at, ["page", "across", "down"]).where(near(c("left"), c("x")) & near(c("y"), c("top"))).select("page", "right", "x", "top", "low").distinct()
    other = at.select("page", "across", "down", c("x").alias("x2"), c("top").alias("top2"), c("low").alias("low2"))
    reach = first.select("*", _bands(c("right"), True).alias("across")).select("*", _bands(c("top"), True).alias("down"))
    same = near(c("right"), c("x2")) & near(c("top"), c("top2")) & near(c("low"), c("low2")) & (c("x2") > c("x") + TOLERANCE)
    pairs = reach.join(other, ["page", "across", "down"]).where(same).select("page", "x", "top", "x2", "low").distinct()
    ends = pairs.select("*", _bands(c("x"), True).alias("across")).select("*", _bands(c("low"), True).alias("down"))
    under = level.select(c("page").alias("_page"), _bands(c("left")).alias("_across"), _bands(c("y")).alias("_down"), "y", "left", "right")
    joined = (c("page") == c("_page")) & (c("across") == c("_across")) & (c("down") == c("_down")) & near(c("left"), c("x")) & near(c("right"), c("x2")) & near(c("y"), c("low"))
    return ends.join(under, joined, "left_semi").select("page", c("x").alias("x0"), c("top").alias("y0"), c("x2").alias("x1"), c("low").alias("y1")).distinct()


def counted_within(spans: DataFrame, points: DataFrame, band: float = 50.0) -> DataFrame:
    """(id, inside) of spans of (id, page, low, high): how many points of (page, value) of the page lie in them, ends included.

    Neither pairs nor pages are held: both are dealt by page and band of values and sorted together; the points up to a place are
    those of its band up to there and the sums of the bands before. Spans without a page or an end have none.
    """
    c = F.col
    counted = points.where("page is not null and value is not null and not isnan(value)").groupBy("page", "value").agg(F.count("*").alias("n"))
    whole = c("page").isNotNull() & (c("low") <= c("high"))
    edge = lambda name, turn, sign: F.struct(F.when(whole, c(name)).alias("value"), F.lit(turn).alias("turn"), F.lit(sign).alias("sign"))
    edges = spans.select("id", "page", F.explode(F.array(edge("low", 0, -1), edge("high", 2, 1))).alias("e")).select("id", "page", "e.*", F.lit(0).cast("long").alias("n"))
    same = [f.name for f in edges.schema.fields]
    rows = counted.select(F.lit(None).cast(edges.schema["id"].dataType).alias("id"), "page", c("value").cast(edges.schema["value"].dataType).alias("value"), F.lit(1).alias("turn"), F.lit(0).alias("sign"), "n").select(*same).unionByName(edges)
    rows = rows.withColumn("band", F.floor(c("value") / band))
    upto = F.sum("n").over(Window.partitionBy("page", "band").orderBy("value", "turn").rowsBetween(Window.unboundedPreceding, 0))
    places = rows.withColumn("upto", upto).where("sign <> 0")
    bands = rows.groupBy("page", "band").agg(F.sum("n").alias("n"))
    before = bands.select("page", "band", (F.sum("n").over(Window.partitionBy("page").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)) - c("n")).alias("before"))
    number = F.when(c("value").isNotNull(), c("sign") * (c("upto") + c("before"))).otherwise(0)
    return places.join(before, ["page", "band"], "left").groupBy("id").agg(F.sum(number).alias("inside"))


def continued_tables(tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds group: tables of (doc, page, y0, y1, height, edges, first_cell) that go on over pages share one.

    A table goes on if it begins in the upper part of the next page, the one before ends in the lower
    part of its own, the column edges agree, and its first cell is empty.
    """
    w = Window.partitionBy(doc).orderBy("page", "y0")
    before = {c: F.lag(c).over(w) for c in ("page", "y1", "height", "edges")}
    same = (F.size(before["edges"]) == F.size("edges")) & F.forall(F.zip_with(before["edges"], "edges", lambda x, y: F.abs(x - y) <= TOLERANCE), lambda ok: ok)
    goes_on = (F.col("page") == before["page"] + 1) & (before["y1"] >= before["height"] * 0.85) & (F.col("y0") <= F.col("height") * 0.15) & same & (F.trim("first_cell") == "")
    rows = tables.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def unique_tables(tables: DataFrame, sources: DataFrame, key: str = "table_id") -> DataFrame:
    """(table, source) of tables and sources of (page, rows) that agree in page and columns, where each is the only one."""
    columns = F.transform(F.col("rows")[0], lambda _, k: F.md5(F.array_join(F.transform("rows", lambda r: F.coalesce(F.get(r, k), F.lit(""))), "\x1f")))
    sign = lambda df, name: df.select("page", F.col(key).alias(name), F.array_join(columns, ",").alias("sign"))
    only = lambda df, name: df.groupBy("page", "sign").agg(F.count("*").alias("n"), F.first(name).alias(name)).where("n = 1").drop("n")
    return only(sign(tables, "table"), "table").join(only(sign(sources, "source"), "source"), ["page", "sign"]).select("table", "source")
