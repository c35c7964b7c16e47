"""Running sums over a total order without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut, prepare, shuffle_partitions


def running(df: DataFrame, keys: list[Column], value: str, out: str) -> tuple[DataFrame, int]:
    """Adds ``out``: the sum of ``value`` over all rows before this one in the order of ``keys``; also the grand total.

    Rows are range-partitioned and sorted once and checkpointed with their
    partition number.  Only one sum per partition reaches the driver; each
    partition then adds its own offset in a streaming pass.  ``keys`` should
    order rows totally; ties fall in one partition, in any order.  ``value``
    is a non-null long.
    """
    spark = df.sparkSession
    prepare(spark)
    n = shuffle_partitions(spark)
    sorted_ = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: int(r["s"]) for r in sorted_.groupBy("_part").agg(F.sum(value).alias("s")).collect()}
    offsets, total = {}, 0
    for part in sorted(sums):
        offsets[part], total = total, total + sums[part]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[int, int] = {}
        for b in batches:
            if len(b):
                part = int(b["_part"].iloc[0])
                start = at.get(part, offsets[part])
                ends = b[value].astype("int64").cumsum()
                b = b.drop(columns="_part")
                b[out] = start + ends - b[value].astype("int64")
                at[part] = start + int(ends.iloc[-1])
                yield b

    return sorted_.mapInPandas(add, f"{schema}, `{out}` long"), total
