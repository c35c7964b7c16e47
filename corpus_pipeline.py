"""The training-corpus pipeline: its stages over ``documents``, each written as Parquet and read again.

quality classifier, line dedup, n-gram Jaccard join, mixing, packing.  Every
stage keeps the columns of ``documents``, but the last, whose rows are the
packed pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefold.llm.jaccard import jaccard_groups
from sablefold.llm.labels import training_rows
from sablefold.llm.lines import dedup_lines
from sablefold.llm.mixing import mix_sources
from sablefold.llm.packing import pack_documents
from sablefold.llm.quality import MOST, score_texts, train
from sablefold.llm.rows import named_rows
from sablefold.llm.session import prepare, written

ACCEPT = 0.3
ORACLE_SQL = None  # learned models and packing aren't SQL; tests/llm holds the stages against plain versions


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches ``ACCEPT``, learned from the labelled ones among ``docs``."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sent = spark.sparkContext.broadcast(train(training_rows(docs, labels, "quality", MOST)))
    at = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.greater_equal(pa.array(score_texts(b.column(at), sent.value)), ACCEPT))

    return docs.mapInArrow(good, docs.schema)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line repeats or nearly repeats."""
    return dedup_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies; documents without words stay."""
    rows = named_rows(docs)
    groups = jaccard_groups(rows.select(F.col("row_id").alias("doc_id"), "text"))
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("row_id"))
    return rows.join(kept, "row_id", "left_semi").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes as often as it is taken, the one at the cut with the words taken only."""
    rows = named_rows(docs)
    plan = mix_sources(rows.select(F.col("row_id").alias("doc_id"), "text", "source")).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size"))
    copies = rows.join(plan.select(F.col("doc_id").alias("row_id"), "size", "taken"), "row_id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(left >= F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), ""))
    return copies.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality classifier", keep_good), ("line dedup", drop_lines), ("n-gram Jaccard join", one_of_each), ("mixing sources", mix), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
