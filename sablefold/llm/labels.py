"""Labelled rows for the classifiers: which count for learning, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, most: int) -> list[tuple[str, int]]:
    """At most ``most`` (text, label) pairs outside the held-out fold, as a seeded hash of the id picks them.

    ``most`` bounds what reaches the driver, whatever the size of the tables;
    null labels and null texts don't count, and of an id's texts the first in
    code-point order does.  The picked ids are that few rows, so they are
    broadcast to the scan of the documents.
    """
    known = labels.select("doc_id", F.col(target).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    picked = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return [(r["text"], r["label"]) for r in rows.orderBy("doc_id").collect()]
