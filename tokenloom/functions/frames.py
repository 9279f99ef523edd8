"""Frame helpers that keep order-dependent work distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in the cluster's ``spark.checkpoint.dir``; only a session on one machine may leave that unset."""
    import tempfile

    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tokenloom-checkpoint-"))
    return df.checkpoint(eager=True)


def by_range(df: DataFrame, order) -> DataFrame:
    """``df`` dealt out by range of ``order`` with the range's number in column ``part``; fixed, so that later reads see the same ranges."""
    return checkpointed(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def global_row_number(df: DataFrame, order, name: str) -> DataFrame:
    dealt = by_range(df, order)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).alias("before"))
    line = Window.partitionBy("part").orderBy(*order)
    return dealt.join(F.broadcast(before), "part").withColumn(name, (F.row_number().over(line) - 1 + F.col("before")).cast("long")).drop("part", "before")


def running_total(df: DataFrame, order, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows before, in order."""
    dealt = by_range(df, order)
    sizes = dealt.groupBy("part").agg(F.sum(value).alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).alias("before"))
    line = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(before), "part").withColumn(name, (F.coalesce(F.sum(value).over(line), F.lit(0)) + F.col("before")).cast("long")).drop("part", "before")
