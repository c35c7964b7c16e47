"""What all text rules share: from a span to a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import union_of
from ..schema import FINDINGS, floor_rank
from ..sources.text import span_box

#: The label, its value and the span stand in these columns before ``finish``.
SPAN = ["rule_id", "category", "rank", "matched_text", "char_start"]


def covered(lines: DataFrame, start: Column, end: Column) -> tuple[Column, Column]:
    """Box and smallest confidence of the words that a span touches; null where it touches none."""
    text = F.substring(F.col("line_text"), start + 1, end - start)
    left = start + (F.length(text) - F.length(F.ltrim(text)))
    right = end - (F.length(text) - F.length(F.rtrim(text)))
    grid = F.when(left < right, span_box(F.col("line_text"), F.col("bbox"), left, right)), F.when(left < right, F.col("confidence"))
    if "tokens" not in lines.columns:
        return grid
    hit = F.filter("tokens", lambda t: (t["char_start"] < end) & (t["char_end"] > start))
    some = F.size(hit) > 0
    return F.when(some, union_of(F.transform(hit, lambda t: t["bbox"]))), F.when(some, F.array_min(F.transform(hit, lambda t: t["confidence"])))


def finish(spans: DataFrame) -> DataFrame:
    """Line columns with those of ``SPAN`` -> findings; spans that touch no word are none."""
    end = F.col("char_start") + F.length("matched_text")
    box, confidence = covered(spans, F.col("char_start"), end)
    rows = spans.withColumn("box", box).withColumn("least", confidence).where("box is not null")
    rank = F.least(F.col("rank").cast("tinyint"), floor_rank(F.col("least")))
    return shaped(rows.select("doc_id", "page_index", "block_id", "line_no", "rule_id", "category", F.col("box").alias("bbox"), rank.alias("conf_rank"), "matched_text", F.col("char_start").cast("int").alias("char_start"), end.cast("int").alias("char_end"), F.array().cast("array<string>").alias("merged_from")))


def shaped(findings: DataFrame) -> DataFrame:
    fields = [f.split(" ", 1) for f in FINDINGS.split(", ")]
    return findings.select(*[F.col(n).cast(t).alias(n) for n, t in fields])


def none(lines: DataFrame) -> DataFrame:
    return lines.sparkSession.createDataFrame([], FINDINGS)
