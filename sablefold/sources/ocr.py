"""Words of an OCR engine as lines, and the contract for engines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import union_of
from ..runtime import ship

WORDS = "doc_id long, page_index int, block_num int, par_num int, line_num int, word_num int, text string, x int, y int, w int, h int, conf string"


class Engine(Protocol):
    """Recognises one image: rows of ``WORDS`` without doc_id."""

    def engine_id(self) -> str: ...

    def recognise(self, image: bytes) -> pd.DataFrame: ...


def word_confidence(conf: Column) -> Column:
    """Percent as text to 0..1; what isn't a number or is negative gives 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(conf.try_cast("double"), F.lit(-1.0)) / 100))


def compose(words: DataFrame) -> DataFrame:
    """Word rows (``WORDS``) -> lines with tokens.

    Lines are ordered by block, paragraph and line number; of words that share
    a number the leftmost counts; blank words don't.  A line's words are few,
    so they are gathered per line, and lines are numbered within a document.
    """
    key = ["doc_id", "page_index", "block_num", "par_num", "line_num"]
    word = F.struct("word_num", F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("w").alias("ww"), F.col("h").alias("wh"), "text", word_confidence(F.col("conf")).alias("confidence"))
    first = words.where(F.trim("text") != "").groupBy(*key, "word_num").agg(F.min(word).alias("word"))
    rows = first.groupBy(*key).agg(F.array_sort(F.collect_list("word")).alias("words"))
    box = lambda t: F.struct(t["wx"].alias("x"), t["wy"].alias("y"), t["ww"].alias("w"), t["wh"].alias("h"))
    place = lambda i: F.aggregate(F.slice("words", F.lit(1), i), F.lit(0), lambda n, t: n + F.length(t["text"]) + 1)
    tokens = F.transform("words", lambda t, i: F.struct(t["text"].alias("text"), box(t).alias("bbox"), t["confidence"].alias("confidence"), place(i).alias("char_start"), (place(i) + F.length(t["text"])).alias("char_end")))
    rows = rows.withColumn("tokens", tokens)
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id", "page_index").orderBy("block_num", "par_num", "line_num")
    number = (F.row_number().over(order) - 1).cast("int")
    return rows.select("doc_id", "page_index", F.concat_ws("-", F.lit("b"), F.col("page_index").cast("string"), F.col("block_num").cast("string")).alias("block_id"), number.alias("line_no"), number.alias("reading_order"), F.array_join(F.transform("tokens", lambda t: t["text"]), " ").alias("line_text"), union_of(F.transform("tokens", lambda t: t["bbox"])).alias("bbox"), F.array_min(F.transform("tokens", lambda t: t["confidence"])).alias("confidence"), "tokens")


def recognise(images: DataFrame, engine: Callable[[], Engine]) -> DataFrame:
    """``images(doc_id, content)`` -> word rows, by an engine made once per task.

    A document whose recognition fails gives one row whose ``conf`` is
    ``E_OCR`` and whose text is the reason; ``failures`` picks these.
    """
    ship(images.sparkSession)
    names = [c.split()[0] for c in WORDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = engine()
        for b in batches:
            for doc_id, content in zip(b["doc_id"], b["content"]):
                try:
                    rows = made.recognise(bytes(content)).assign(doc_id=doc_id)
                except Exception as e:  # one bad image doesn't end the job
                    rows = pd.DataFrame([{n: 0 for n in names} | {"doc_id": doc_id, "text": f"{type(e).__name__}: {e}", "conf": "E_OCR"}])
                yield rows[names].astype({"conf": str})

    return images.select("doc_id", "content").mapInPandas(run, WORDS)


def failures(words: DataFrame) -> DataFrame:
    return words.where("conf = 'E_OCR'").select("doc_id", F.lit("E_OCR").alias("code"), F.col("text").alias("message"), F.lit("ocr").alias("source"))
