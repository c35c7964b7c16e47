"""Mixing sources to target weights by weighted fair queueing.

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share
``share`` times all words; a target stops at ``repeats`` times its source's
size and the excess is shared again by weight.  Every document, in a seeded
shuffle of its source, gets a virtual finish time for each of its ``repeats``
passes: the source's words up to its end divided by the source's target.  The
passes are sorted by that time over all sources and truncated at the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running
from .session import cut

WEIGHTS = (3.0, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """``sources(source, source_size)`` -> with ``target``; the table has one row per source.

    Water-filling: a round gives the open sources their weight's part of what
    the closed ones leave, and closes those that reach their ceiling.  Each
    round closes a source or ends, and reads only sums of the small table.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = cut(sources.withColumn("w", w).withColumn("top", repeats * F.col("source_size").cast("double")))
    budget = float(s.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        closed = F.col("w") * F.lit(level) >= F.col("top")
        open_w, taken = s.agg(F.sum(F.when(~closed, F.col("w")).otherwise(0.0)), F.sum(F.when(closed, F.col("top")).otherwise(0.0))).first()
        if not open_w:
            break
        new = (budget - taken) / open_w
        if new <= level:
            break
        level = new
    return s.select("source", "source_size", F.least("top", F.col("w") * F.lit(level)).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 17) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: doc_id, size, source_size, target, taken.

    ``taken``: words of the document in the mix, at most ``repeats`` times its
    size; the document at the cut is taken in part.  Null text has size 0, a
    null source is a source of its own, and repeated rows are documents of
    their own.  Reruns over the same rows agree whatever the partitioning.
    Documents without words take part with nothing.  An empty table gives an
    empty result.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    per = cut(per)
    # The targets' sum, from whole numbers, so that no order of adding shows.
    budget = int(min(share, repeats) * (per.agg(F.sum("source_size")).first()[0] or 0))
    place = F.xxhash64(F.lit(seed), "doc_id", "tie")
    keys = [F.col("source").asc_nulls_last(), F.col("place"), F.col("doc_id"), F.col("tie")]
    queued, _ = running(sized.withColumn("place", place), keys, "size", "before_all")
    # Words of all sources before this one: the sources are few, but the sum runs in the same order as the documents.
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = per.withColumn("source_start", F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("long"))
    s = starts.select(F.col("source").alias("s"), "source_size", "target", "source_start")
    queued = queued.join(s, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("so_far", F.col("before_all") - F.col("source_start") + F.col("size"))
    passes = queued.where("size > 0").select("doc_id", "place", "tie", "size", F.explode(F.array(*[((F.col("so_far") + F.lit(i).cast("long") * F.col("source_size")) / F.col("target")) for i in range(repeats)])).alias("finish"))
    lined, _ = running(passes, [F.col("finish"), F.col("place"), F.col("doc_id"), F.col("tie")], "size", "before")
    edge = lined.where((F.col("before") < budget) & (F.col("before") + F.col("size") >= budget)).select("finish", "place", "doc_id", "tie", "before").first()
    if edge is None:  # no words at all
        return queued.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.lit(0).cast("long").alias("taken"))
    here = F.struct("place", F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), "tie")
    there = F.struct(F.lit(edge["place"]).alias("place"), F.lit(edge["doc_id"] if edge["doc_id"] is not None else -(2**63)).cast("long").alias("d"), F.lit(edge["tie"]).alias("tie"))
    cut_at = F.lit(edge["finish"])
    taken = F.lit(0).cast("long")
    for i in range(repeats):
        finish = (F.col("so_far") + F.lit(i).cast("long") * F.col("source_size")) / F.col("target")
        taken = taken + F.when((finish < cut_at) | ((finish == cut_at) & (here < there)), F.col("size")).when((finish == cut_at) & (here == there), F.lit(budget - edge["before"]).cast("long")).otherwise(F.lit(0).cast("long"))
    return queued.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(F.lit(0).cast("long")).alias("taken"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
