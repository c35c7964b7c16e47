"""Plain text as lines on a fixed grid.

Line ``i`` of a text stands at ``y = 10 + 30 i`` and is 24 high, a character is
12 wide, and ``x`` starts at 10.  Words are split at spaces, a line's text joins
them with one space; blank lines take room but are no lines.  Boxes of such
lines follow from character places, so no token array is carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box

TOP, STEP, HEIGHT, CHAR, LEFT, PAGE_WIDTH = 10, 30, 24, 12, 10, 2000
CONFIDENCE = 0.95


def text_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", confidence: float = CONFIDENCE, one_block: bool = True) -> DataFrame:
    """Lines of every text; with ``one_block`` a text is one block, else each line is.

    Null texts have no lines; other columns of ``df`` are not read.
    """
    split = F.transform(F.split(F.col(text), "\n"), lambda s, i: F.struct(F.array_join(F.filter(F.split(s, " "), lambda t: t != ""), " ").alias("t"), i.alias("n")))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.posexplode(F.filter(split, lambda s: s["t"] != "")).alias("reading_order", "line"))
    number = F.col("line.n")
    block = F.lit("b-0-0") if one_block else F.concat(F.lit("b-0-"), number.cast("string"))
    return rows.select("doc_id", F.lit(0).alias("page_index"), block.alias("block_id"), number.alias("line_no"), "reading_order", F.col("line.t").alias("line_text"), box(F.lit(LEFT), F.lit(TOP) + STEP * number, CHAR * F.length("line.t"), F.lit(HEIGHT)).alias("bbox"), F.lit(confidence).alias("confidence"))


def page_sizes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, page_index, width, height of the page that a text fills."""
    height = TOP + STEP * F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")) + TOP
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(PAGE_WIDTH).alias("width"), height.cast("int").alias("height"))


def span_box(line_text: Column, bbox: Column, start: Column, end: Column) -> Column:
    """Box of the words that the characters ``start`` to ``end`` touch, in a line on the grid."""
    before = F.length(F.substring_index(F.substring(line_text, F.lit(1), start), " ", -1))
    after = F.length(F.substring_index(F.substring(line_text, end + 1, F.length(line_text)), " ", 1))
    left = start - before
    return box(bbox["x"] + CHAR * left, bbox["y"], CHAR * (end + after - left), bbox["h"])


def tokens(lines: DataFrame) -> DataFrame:
    """One row per word of lines on the grid: its place in characters and its box."""
    words = lines.select("doc_id", "page_index", "block_id", "line_no", "bbox", F.posexplode(F.split("line_text", " ")).alias("token_no", "token"))
    order = Window.partitionBy("doc_id", "page_index", "block_id", "line_no").orderBy("token_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("token") + 1).over(order), F.lit(0)).cast("int")
    return words.select("doc_id", "page_index", "block_id", "line_no", "token_no", "token", start.alias("char_start"), (start + F.length("token")).alias("char_end"), box(F.col("bbox.x") + CHAR * start, F.col("bbox.y"), CHAR * F.length("token"), F.col("bbox.h")).alias("bbox"))
