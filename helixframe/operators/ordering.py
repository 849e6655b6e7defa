"""Row numbers over a whole table without a window that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.runtime import checkpoint


def numbered(df: DataFrame, order: list[str], number: str, partitions: int | None = None) -> DataFrame:
    """df with `number`, counting from 0 in the given order.

    Rows are range-partitioned and sorted; a range's first number is the sum of the sizes of the ranges before, of which
    there are as many as partitions.
    """
    return running_sum(df, order, F.lit(1), number, partitions)


def running_sum(df: DataFrame, order: list[str], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """df with `name`: the sum of a value over all rows before in the given order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a checkpoint, since ranges sampled anew might differ between the two uses
    ranged = checkpoint(df.withColumn("_v", value.cast("long")).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    inside = ranged.withColumn("_in", F.coalesce(F.sum("_v").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.sum("_v").alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).select("_part", "_base")
    return inside.join(F.broadcast(sizes), "_part").withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_part", "_in", "_base", "_v")
