"""Ranks and running totals over a whole table, without a single task for all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the folder in spark.checkpoint.dir, its lineage cut; a temporary folder serves where that is unset and Spark runs in one process."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def running_total(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """`df` with `name`: the sum of `value` over the rows before, in `order`, whose values are distinct.

    Rows are dealt by ranges of `order`; each range sums its own, and the ranges' totals, one number a
    partition, are broadcast.
    """
    dealt = cut(df.withColumn("_value", value).repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.sum("_value").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_own", F.coalesce(F.sum("_value").over(within), F.lit(0))).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_own") + F.col("_offset")).drop("_value", "_part", "_own", "_offset")
