"""Global numbering without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplens.session import materialize


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """``df`` with consecutive numbers in the order of ``order``, which should have no ties.

    Rows are range-partitioned and numbered inside each partition; the counts
    of the partitions before, one row each, are added.
    """
    ranged = materialize(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return ranged.withColumn("_rn", F.row_number().over(inside)).join(
        F.broadcast(offsets), "_part"  # one row per partition
    ).withColumn(name, (F.col("_offset") + F.col("_rn") + (start - 1)).cast("bigint")).drop(
        "_part", "_offset", "_rn")
