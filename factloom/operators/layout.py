"""Layout: tokens to page text with character spans, visual rows, OCR lines and composition sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

# Headings of sections 3 and 4.
SECTION_3 = r"(?i)^(section\s*)?0?3[\.:)\s]|^composition\b|^3\.\s*composition"
SECTION_4 = r"(?i)^(section\s*)?0?4[\.:)\s]|^first[\s-]?aid"


def char_spans(tokens: DataFrame, page: list[str], line: str = "line_no", word: str = "word_no") -> DataFrame:
    """Tokens with ``char_start`` and ``char_end`` in their page's text (a space between words, a newline between lines)."""
    place = Window.partitionBy(*page).orderBy(line, word).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(place), F.lit(0))
    return tokens.withColumn("char_start", start).withColumn("char_end", start + F.length("text"))


def page_text(tokens: DataFrame, page: list[str], line: str = "line_no", word: str = "word_no") -> DataFrame:
    """Each page's text in reading order."""
    lines = tokens.groupBy(*page, line).agg(F.array_sort(F.collect_list(F.struct(word, "text"))).alias("w"))
    texts = lines.select(*page, line, F.array_join(F.transform("w", lambda t: t["text"]), " ").alias("t"))
    whole = texts.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(line, "t"))).alias("l"))
    return whole.select(*page, F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


def placed_words(tokens: DataFrame, page: list[str], line: str = "line_no", word: str = "word_no") -> DataFrame:
    """Each page's ``text`` (``page_text``) and its ``words`` (start, end, box) by ``char_spans``: tokens, with their ``box``, meet
    once by page. Tokens without a text are left out."""
    order = Window.partitionBy(*page).orderBy(line, word, "text")
    some = tokens.where("text is not null").withColumn("_line", F.struct(line)).withColumn("_before", F.lag("_line").over(order))
    start = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = F.when(F.col("_before").isNull(), "").when(F.col("_before") == F.col("_line"), " ").otherwise("\n")
    one = F.struct(start.alias("start"), (start + F.length("text")).alias("end"), "box", F.concat(gap, F.col("text")).alias("said"))
    # The window's exchange serves the aggregate as well.
    whole = some.select(*page, one.alias("w")).groupBy(*page).agg(F.array_sort(F.collect_list("w")).alias("w"))
    words = F.transform("w", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["box"].alias("box")))
    return whole.select(*page, F.array_join(F.col("w.said"), "").alias("text"), words.alias("words"))


def _fold(tokens: Column, joins) -> Column:
    """Labels of a fold in which a token joins the last group or opens one; groups keep a running band (top, bottom)."""
    empty = F.struct(F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("bottom"), F.lit(-1).alias("no"), F.array().cast("array<int>").alias("labels"))

    def step(acc: Column, t: Column) -> Column:
        joined = (acc["no"] >= 0) & F.coalesce(joins(acc, t), F.lit(False))
        no = F.when(joined, acc["no"]).otherwise(acc["no"] + 1)
        return F.struct(
            F.when(joined, F.least(acc["top"], t["y0"])).otherwise(t["y0"]).alias("top"),
            F.when(joined, F.greatest(acc["bottom"], t["y1"])).otherwise(t["y1"]).alias("bottom"),
            no.alias("no"),
            F.concat(acc["labels"], F.array(no)).alias("labels"),
        )

    return F.aggregate(tokens, empty, step, lambda acc: acc["labels"])


def visual_rows(tokens: DataFrame, page: list[str], overlap: float = 0.4) -> DataFrame:
    """Tokens with ``row_no``: by (y0, x0), a token joins the last row when it shares enough height with its band.

    ``tokens`` has x0, y0, x1, y1, text. A page is the bounded unit of the fold."""

    def joins(acc: Column, t: Column) -> Column:
        shared = F.least(acc["bottom"], t["y1"]) - F.greatest(acc["top"], t["y0"])
        least = F.least(acc["bottom"] - acc["top"], t["y1"] - t["y0"])
        return F.when(least > 0, shared / least >= overlap)

    grouped = tokens.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1", "text"))).alias("t"))
    labelled = grouped.withColumn("no", _fold(F.col("t"), joins))
    return labelled.select(*page, F.inline(F.arrays_zip("t", "no"))).select(*page, "t.*", F.col("no").alias("row_no"))


def row_texts(rows: DataFrame, page: list[str]) -> DataFrame:
    """Rows of a page: text from left to right, enclosing box and the words with their left and right edges."""
    grouped = rows.groupBy(*page, "row_no").agg(F.array_sort(F.collect_list(F.struct("x0", "y0", "x1", "y1", "text"))).alias("t"))
    return grouped.select(*page, "row_no", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"), G.union(F.col("t")).alias("box"), F.transform("t", lambda x: F.struct(x["text"].alias("text"), x["x0"].alias("x0"), x["x1"].alias("x1"))).alias("words"))


def ocr_lines(words: DataFrame, page: list[str], order: str = "word_no") -> DataFrame:
    """OCR words, in input order, with ``line_no``: a word whose centre leaves the line's band opens a line."""

    def joins(acc: Column, t: Column) -> Column:
        centre = (t["y0"] + t["y1"]) / 2
        return (centre >= acc["top"]) & (centre <= acc["bottom"])

    grouped = words.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(order, "y0", "x0", "x1", "y1", "text"))).alias("t"))
    return grouped.withColumn("no", _fold(F.col("t"), joins)).select(*page, F.inline(F.arrays_zip("t", "no"))).select(*page, "t.*", F.col("no").alias("line_no"))


def composition_rows(rows: DataFrame, document: str = "document") -> DataFrame:
    """Rows from the first heading of section 3 up to the next heading of section 4; a row that is both heads section 4."""
    place = F.struct("page", "row_no")
    head, whole = F.trim("text"), Window.partitionBy(document)
    # A document's rows meet once: both bounds come from windows over them.
    marked = rows.where(F.col(document).isNotNull()).withColumn("s4", head.rlike(SECTION_4)).withColumn("s3", ~F.col("s4") & head.rlike(SECTION_3))
    begun = marked.withColumn("start", F.min(F.when(F.col("s3"), place)).over(whole)).where("start is not null")
    ended = begun.withColumn("end", F.min(F.when(F.col("s4") & (place > F.col("start")), place)).over(whole))
    inside = ended.where((place >= F.col("start")) & (F.col("end").isNull() | (place < F.col("end"))))
    return inside.where(~F.col("s4")).select(*rows.columns)
