"""Merging findings of one category that overlap or stand side by side.

Two boxes merge if their intersection over union is at least ``IOU``, or if
they share half of the smaller height and stand at most ``GAP`` pixels apart.
Merging repeats until nothing changes, as a merged box may reach further.

Where the boxes of a page and category stand in rows that don't touch, this is
a run of boxes each of which begins before the rows' furthest end so far plus
the gap: window functions do it.  Other groups are folded in Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import y2
from ..runtime import ship
from ..schema import FINDINGS
from .common import shaped

IOU, GAP = 0.30, 8
GROUP = ["doc_id", "page_index", "category"]
_b = lambda c: F.col(f"bbox.{c}")


def in_rows(findings: DataFrame) -> DataFrame:
    """Groups (``GROUP``) with ``flat``: whether their boxes' distinct rows (y, h) don't touch each other and none is merged already."""
    rows = findings.groupBy(*GROUP, _b("y").alias("y"), _b("h").alias("h")).agg(F.max(F.size("merged_from")).alias("n"))
    above = Window.partitionBy(*GROUP).orderBy("y", "h").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("free", F.coalesce(F.col("y") >= F.max(F.col("y") + F.col("h")).over(above), F.lit(True)) & (F.col("n") == 0)).groupBy(*GROUP).agg(F.min("free").alias("flat"))


def merge_rows(findings: DataFrame) -> DataFrame:
    """Merges within rows of equal y and height: gaps and islands along x.  No finding may be a merged one already."""
    row = [*GROUP, "_y", "_h"]
    f = findings.withColumn("_y", _b("y")).withColumn("_h", _b("h"))
    order = Window.partitionBy(*row).orderBy(_b("x"), "rule_id", _b("w"), "conf_rank", "matched_text", "char_start")
    reach = F.max(_b("x") + _b("w")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("_new", F.coalesce(_b("x") > reach + GAP, F.lit(True)).cast("int")).withColumn("_at", F.row_number().over(order))
    f = f.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A merge puts the rule that doesn't lead before those merged earlier: the box that joins, or the leader it outranks.
    before = F.min_by(F.struct("conf_rank", "rule_id"), F.struct(-F.col("conf_rank"), "_at")).over(Window.partitionBy(*row, "_island").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("_before", before).withColumn("_joins", F.when(F.col("conf_rank") > F.col("_before.conf_rank"), F.col("_before.rule_id")).when(F.col("_before").isNotNull(), F.col("rule_id")))
    # The first of the highest confidence gives the rule, its text and its place.
    best = F.min_by(F.struct("rule_id", "matched_text", "block_id", "line_no", "char_start", "char_end"), F.struct(-F.col("conf_rank"), "_at"))
    texts = F.array_sort(F.collect_list(F.when(F.col("matched_text") != "", F.struct((-F.col("conf_rank")).alias("r"), "_at", F.col("matched_text").alias("t")))))
    ids = F.reverse(F.transform(F.array_sort(F.collect_list(F.when(F.col("_joins").isNotNull(), F.struct("_at", "_joins")))), lambda s: s["_joins"]))
    g = f.groupBy(*row, "_island").agg(best.alias("best"), F.max("conf_rank").alias("conf_rank"), F.min(_b("x")).alias("x"), F.max(_b("x") + _b("w")).alias("r"), texts.alias("texts"), ids.alias("ids"), F.min("char_start").alias("s"), F.max("char_end").alias("e"))
    box = F.struct("x", F.col("_y").alias("y"), (F.col("r") - F.col("x")).alias("w"), F.col("_h").alias("h"))
    text = F.when(F.col("best.matched_text") != "", F.col("best.matched_text")).otherwise(F.coalesce(F.get("texts", F.lit(0))["t"], F.lit("")))
    others = F.array_distinct(F.filter("ids", lambda i: i != F.col("best.rule_id")))
    return shaped(g.select("doc_id", "page_index", "best.block_id", "best.line_no", "best.rule_id", "category", box.alias("bbox"), "conf_rank", text.alias("matched_text"), F.col("s").alias("char_start"), F.col("e").alias("char_end"), others.alias("merged_from")))


def _meets(a: dict, b: dict) -> bool:
    w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    both = max(w, 0) * max(h, 0)
    if both >= IOU * (a["w"] * a["h"] + b["w"] * b["h"] - both):
        return True
    return 2 * h >= min(a["h"], b["h"]) and -w <= GAP


def _joined(a: dict, b: dict) -> dict:
    """``a`` stands before ``b`` and leads unless ``b`` is surer."""
    lead, other = (b, a) if b["conf_rank"] > a["conf_rank"] else (a, b)
    x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
    ids = dict.fromkeys([other["rule_id"], *lead["merged_from"], *other["merged_from"]])
    ids.pop(lead["rule_id"], None)
    return lead | {
        "x": x, "y": y, "w": max(a["x"] + a["w"], b["x"] + b["w"]) - x, "h": max(a["y"] + a["h"], b["y"] + b["h"]) - y,
        "matched_text": lead["matched_text"] or other["matched_text"], "merged_from": list(ids),
        "char_start": min(a["char_start"], b["char_start"]), "char_end": max(a["char_end"], b["char_end"]),
    }


def fold(boxes: list[dict]) -> list[dict]:
    """The general merge of one page's findings of one category."""
    order = lambda f: (f["y"], f["x"], f["rule_id"], f["w"], f["h"], f["conf_rank"], f["matched_text"], f["char_start"])
    while True:
        left, out = sorted(boxes, key=order), []
        while left:
            now, rest = left[0], []
            for f in left[1:]:
                if _meets(now, f):
                    now = _joined(now, f)
                else:
                    rest.append(f)
            out.append(now)
            left = rest
        if len(out) == len(boxes):
            return sorted(out, key=order)
        boxes = out


def merge_boxes(findings: DataFrame) -> DataFrame:
    """Merges any boxes, a page and category at a time; these are as many as one page holds."""
    ship(findings.sparkSession)
    names = [f.split(" ", 1)[0] for f in FINDINGS.split(", ")]

    def run(b: pd.DataFrame) -> pd.DataFrame:
        rows = [r | {k: int(r["bbox"][k]) for k in "xywh"} | {"merged_from": list(r["merged_from"]), "matched_text": r["matched_text"] or ""} for r in b.to_dict("records")]
        return pd.DataFrame([r | {"bbox": {k: r[k] for k in "xywh"}} for r in fold(rows)])[names]

    return findings.groupBy(*GROUP).applyInPandas(run, FINDINGS)


def merge(findings: DataFrame) -> DataFrame:
    """Merged findings; rows of text take the window path, the rest the fold."""
    marked = findings.join(in_rows(findings), GROUP)
    return merge_rows(marked.where("flat").drop("flat")).unionByName(merge_boxes(shaped(marked.where("not flat"))))


def merged_ids(rule_id: Column, merged_from: Column) -> Column:
    return F.concat(F.array(rule_id), merged_from)
