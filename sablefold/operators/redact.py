"""Masking text, and pixels of images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ScanError
from ..runtime import ship

NAMES = {"CREDENTIALS": "CREDS"}
STYLES = ("block", "pixelate", "label", "blur")
LINE = ["doc_id", "page_index", "block_id", "line_no"]


def effective_style(kind: str) -> tuple[str, bool]:
    """The style that is drawn, and whether it replaces one that could be undone."""
    if kind not in STYLES:
        raise ScanError("E_REDACTION", f"no style {kind!r}")
    return ("block", True) if kind == "blur" else (kind, False)


def line_spans(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """``LINE`` and ``spans`` of the lines to mask: sorted places and categories.

    A finding of several lines masks all lines within its box.
    """
    boxes = lines.select(*LINE, F.col("bbox.h").alias("line_h"))
    own = findings.where("line_no is not null").join(boxes, LINE)
    tall = own.where("bbox.h > line_h").select("doc_id", "page_index", "category", F.col("bbox").alias("box"))
    inside = lines.join(tall, ["doc_id", "page_index"]).where("bbox.y >= box.y and bbox.y + bbox.h <= box.y + box.h")
    spans = own.where("bbox.h <= line_h").select(*LINE, "char_start", "char_end", "category").unionByName(inside.select(*LINE, F.lit(0).alias("char_start"), F.length("line_text").alias("char_end"), "category"))
    return spans.groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "category"))).alias("spans"))


def _masked(text: Column, spans: Column, length: Column, place: Callable[[Column], Column], style: str) -> Column:
    """``text`` with ``spans`` of a line of ``length`` characters masked; ``place`` is where a character of it stands in ``text``.

    Spans that overlap count as one, named after the first.
    """
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("raw"))

    def step(s, f):
        begin, end = F.greatest(f["char_start"], s["at"]), F.least(f["char_end"], length)
        first, last = place(begin), place(end - 1) + 1
        between = F.substring(text, s["raw"] + 1, first - s["raw"])
        mask = F.repeat(F.lit("█"), last - first) if style != "label" else F.when(f["char_start"] < s["at"], F.lit("")).otherwise(F.concat(F.lit("["), label(f["category"]), F.lit("]")))
        return F.when(end <= s["at"], s).otherwise(F.struct(F.concat(s["out"], between, mask).alias("out"), end.alias("at"), last.alias("raw")))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["raw"] + 1, F.length(text))))


def masked_lines(lines: DataFrame, findings: DataFrame, style: str = "block") -> DataFrame:
    """``lines`` with ``redacted``: the line with its findings masked, by █ per character or as [CATEGORY]."""
    style, _ = effective_style(style)
    text = F.col("line_text")
    masked = _masked(text, F.col("spans"), F.length(text), lambda i: i, style)
    return lines.join(line_spans(lines, findings), LINE, "left").withColumn("redacted", F.when(F.col("spans").isNull(), text).otherwise(masked)).drop("spans")


def masked_documents(docs: DataFrame, lines: DataFrame, findings: DataFrame, style: str = "block") -> DataFrame:
    """doc_id, redacted: every text of ``docs(doc_id, text)`` as it is, but for its findings.

    ``lines`` and ``findings`` are of the same texts on the grid.  Null stays null;
    white space that the grid leaves out stays where it was.
    """
    style, _ = effective_style(style)
    spans = line_spans(lines, findings).select("doc_id", "line_no", "spans")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = texts.join(spans.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    # The grid leaves out spaces behind a space and at the start; what else there is stands on it in the same order.
    marked = F.regexp_replace("raw", "(?<= ) |^ ", "_")
    stays = F.zip_with(F.split(marked, ""), F.split("raw", ""), lambda a, b: a == b)
    at = F.filter(F.transform(stays, lambda same, i: F.when(same, i)), lambda i: i.isNotNull())
    rows = raw.join(spans, ["doc_id", "line_no"], "left").withColumn("at", F.when(F.col("spans").isNotNull(), at))
    masked = _masked(F.col("raw"), F.col("spans"), F.size("at"), lambda i: F.get("at", i), style)
    rows = rows.select("doc_id", "line_no", F.when(F.col("spans").isNull(), F.col("raw")).otherwise(masked).alias("redacted"))
    put = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "redacted"))), lambda s: s["redacted"]), "\n").alias("masked"))
    return texts.join(put, "doc_id", "left").select("doc_id", F.coalesce("masked", "text").alias("redacted"))


def hex_colour(value: str) -> tuple[int, int, int]:
    """#rrggbb as numbers."""
    digits = value.removeprefix("#")
    if len(digits) != 6 or not all(c in "0123456789abcdefABCDEF" for c in digits):
        raise ScanError("E_POLICY", f"{value!r} is no colour")
    return tuple(bytes.fromhex(digits))


def initials(category: Column) -> Column:
    """The caption where the category's name has no room: its first three letters."""
    return F.concat(F.lit("["), F.substring(F.regexp_replace(category, r"\PL", ""), 1, 3), F.lit("]"))


def label(category):
    return F.when(category == "CREDENTIALS", NAMES["CREDENTIALS"]).otherwise(category)


def masked_texts(masked: DataFrame) -> DataFrame:
    """doc_id, redacted: a document's lines of words put together again; ``masked_documents`` keeps all white space."""
    lines = F.array_sort(F.collect_list(F.struct("page_index", "line_no", "redacted")))
    return masked.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda s: s["redacted"]), "\n").alias("redacted"))


def mask_images(images: DataFrame, boxes: DataFrame, style: str = "block", colour: tuple[int, int, int] = (0, 0, 0), padding: int = 2, cell: int = 12, text_colour: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """``images(doc_id, content)`` with the boxes of ``boxes(doc_id, bbox)`` masked: doc_id, content, width, height, error.

    ``bbox`` is in the image's own pixels; a ``category`` of the boxes is the
    caption of the style ``label``, an ``output_format`` of the images the kind
    that is written (PNG without).  A row that fails carries its reason in
    ``error`` and no content, so nothing leaves unmasked.
    """
    from ..sources.images import caption, decode, encode, mask

    style, _ = effective_style(style)
    ship(images.sparkSession)
    category = F.col("category") if "category" in boxes.columns else F.lit("")
    goes_out = F.col("output_format") if "output_format" in images.columns else F.lit("PNG")
    per = boxes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("bbox.y", "bbox.x", "bbox.w", "bbox.h", category.alias("category")))).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, content, kind, found in zip(b["doc_id"], b["content"], b["kind"], b["boxes"]):
                try:
                    pixels = decode(bytes(content))
                    found = list(found) if found is not None else []
                    for f in found:
                        mask(pixels, f["x"], f["y"], f["w"], f["h"], style, colour, padding, cell)
                    for f in found if style == "label" else ():
                        if f["category"]:
                            caption(pixels, f["x"], f["y"], f["w"], f["h"], f["category"], NAMES.get(f["category"], f["category"]), text_colour)
                    out.append((doc_id, encode(pixels, kind), pixels.shape[1], pixels.shape[0], None))
                except Exception as e:  # fail closed, and go on with the others
                    out.append((doc_id, None, 0, 0, f"E_REDACTION: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "content", "width", "height", "error"])

    return images.select("doc_id", "content", goes_out.alias("kind")).join(per, "doc_id", "left").mapInPandas(run, "doc_id long, content binary, width int, height int, error string")
