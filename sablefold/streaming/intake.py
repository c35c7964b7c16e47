"""Documents that arrive as files: a stream whose every batch is scanned like a table.

A document is one row, so all of its findings are known within its batch and
no watermark or state is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import line_rules
from ..plans.policy import Policy, default_policy
from ..plans.scan import scan
from ..sources.text import text_lines

DOCUMENT = "doc_id long, text string"


def documents(spark: SparkSession, path: str, schema: str = DOCUMENT, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def line_findings(docs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Findings of the rules that look at one line, as a stream in append mode."""
    ids = {r.id for r in (policy or default_policy()).enabled()}
    return line_rules.line_findings(text_lines(docs), [r for i, r in line_rules.RULES.items() if i in ids])


def watch(docs: DataFrame, out: str, checkpoint: str, policy: Policy | None = None, key: bytes = b"", each: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Scans each batch and writes findings and manifests below ``out``, one folder per batch.

    A batch that is run again overwrites its own folder.  ``once`` takes what is
    there and ends; otherwise the folder is watched on.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        result = scan(df, policy, key)
        result.findings.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        result.manifest.write.mode("overwrite").parquet(f"{out}/manifest/batch={number}")
        if each:
            each(df, number)
        df.unpersist()

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
