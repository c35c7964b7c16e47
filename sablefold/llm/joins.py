"""Joins on keys that many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY = 10_000  # a key is heavy if more than one row in so many has it, so fewer keys than this are
LEAST = 1_000  # rows of a key that no task minds


def matched(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``keys``, which are unique in ``on`` and say in ``c`` how many rows have each.

    Fewer than ``HEAVY`` keys can be heavy; these are broadcast, and their rows
    stay where they are.  The others are exchanged, at every size.  ``keys`` are
    read more than once.
    """
    heavy = max(LEAST, (keys.agg(F.sum("c")).first()[0] or 0) // HEAVY)
    few = keys.where(F.col("c") > heavy)
    if few.isEmpty():
        return rows.join(keys.drop("c").hint("merge"), on)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(keys.where(F.col("c") <= heavy).drop("c").hint("merge"), on)
    return rows.join(F.broadcast(few.drop("c")), on).unionByName(rest)
