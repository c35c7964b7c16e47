"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; one of our own only where that is unset (local tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="sablefold-")
        context.setCheckpointDir(named)
    return named or context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows as Parquet in the shared folder, read back: the plan starts anew there, and a lost executor costs nothing upstream."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sablefold-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
