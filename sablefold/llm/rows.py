"""Naming rows of a table whose ids may be null or repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written


def named_rows(docs: DataFrame) -> DataFrame:
    """``row_id`` (long, unique), ``text``, ``source`` if there, and ``row``: all columns of ``docs`` as one struct.

    The row_id is the doc_id where that is a name.  Otherwise rows are numbered
    behind it and written down, so the numbers hold whatever is computed again.
    """
    n, distinct = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    side = [F.col(c) for c in ("text", "source") if c in docs.columns]
    if n == distinct:
        return docs.select(F.col("doc_id").cast("long").alias("row_id"), *side, F.struct("*").alias("row"))
    return written(docs.select(F.monotonically_increasing_id().alias("row_id"), *side, F.struct("*").alias("row")))
