"""Session-level helpers: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship
from ..tables import shared_dir, written

__all__ = ["cut", "prepare", "release", "shared_dir", "shuffle_partitions", "written"]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows are written to the shared folder, so a lost executor costs nothing upstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """For plans with Python: workers get the package, and Arrow batches stay small, as one document may hold many megabytes."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
