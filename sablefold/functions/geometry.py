"""Boxes as ``struct<x,y,w,h:int>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))


def x2(b: Column) -> Column:
    return b["x"] + b["w"]


def y2(b: Column) -> Column:
    return b["y"] + b["h"]


def area(b: Column) -> Column:
    return b["w"].cast("long") * b["h"].cast("long")


def overlap(a: Column, b: Column) -> Column:
    """Area that both boxes cover."""
    w = F.least(x2(a), x2(b)) - F.greatest(a["x"], b["x"])
    h = F.least(y2(a), y2(b)) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0)).cast("long") * F.greatest(h, F.lit(0)).cast("long")


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    return both / (area(a) + area(b) - both)


def union_of(boxes: Column) -> Column:
    """The smallest box around an array of boxes."""
    left, top = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    right, bottom = F.array_max(F.transform(boxes, x2)), F.array_max(F.transform(boxes, y2))
    return box(left, top, right - left, bottom - top)


def union(a: Column, b: Column) -> Column:
    return union_of(F.array(a, b))


def expanded(b: Column, padding: Column, max_w: Column, max_h: Column) -> Column:
    """Grown on all sides, clipped to the page, one pixel at least."""
    left, top = F.greatest(b["x"] - padding, F.lit(0)), F.greatest(b["y"] - padding, F.lit(0))
    right, bottom = F.least(x2(b) + padding, max_w), F.least(y2(b) + padding, max_h)
    return box(left, top, F.greatest(right - left, F.lit(1)), F.greatest(bottom - top, F.lit(1)))


def inside(inner: Column, outer: Column) -> Column:
    return (inner["x"] >= outer["x"]) & (inner["y"] >= outer["y"]) & (x2(inner) <= x2(outer)) & (y2(inner) <= y2(outer))


def gap(a: Column, b: Column) -> Column:
    """Manhattan distance between the nearest edges."""
    dx = F.greatest(a["x"] - x2(b), b["x"] - x2(a), F.lit(0))
    dy = F.greatest(a["y"] - y2(b), b["y"] - y2(a), F.lit(0))
    return dx + dy


def identity() -> Column:
    return scale(F.lit(1.0), F.lit(1.0))


def scale(sx: Column, sy: Column) -> Column:
    """x' = a x + b y + tx, y' = c x + d y + ty, here without shear or shift."""
    zero = F.lit(0.0)
    return F.struct(sx.cast("double").alias("a"), zero.alias("b"), zero.alias("tx"), zero.alias("c"), sy.cast("double").alias("d"), zero.alias("ty"))


def apply(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return t["a"] * x + t["b"] * y + t["tx"], t["c"] * x + t["d"] * y + t["ty"]


def inverse(t: Column) -> Column:
    """The transform back; null for one that can't be undone."""
    det = F.nullif(t["a"] * t["d"] - t["b"] * t["c"], F.lit(0.0))
    a, b, c, d = t["d"] / det, -t["b"] / det, -t["c"] / det, t["a"] / det
    return F.struct(a.alias("a"), b.alias("b"), (-(a * t["tx"] + b * t["ty"])).alias("tx"), c.alias("c"), d.alias("d"), (-(c * t["tx"] + d * t["ty"])).alias("ty"))


def project(t: Column, b: Column) -> Column:
    """The box around the transformed corners, halves rounded to even, from 0 on and one pixel at least."""
    corners = [apply(t, x, y) for x in (b["x"], x2(b)) for y in (b["y"], y2(b))]
    edge = lambda f, i: F.greatest(F.bround(f(*[c[i] for c in corners]), 0), F.lit(0.0)).cast("int")
    left, top, right, bottom = edge(F.least, 0), edge(F.least, 1), edge(F.greatest, 0), edge(F.greatest, 1)
    return box(left, top, F.greatest(right - left, F.lit(1)), F.greatest(bottom - top, F.lit(1)))
