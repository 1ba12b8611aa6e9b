"""Predecessors within groups that may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import join_measured, stored


def previous_in_group(df: DataFrame, keys: list[str], order: str, value: str, bucket: Column, name: str) -> DataFrame:
    """df with the value of the row before it in its group, by order, as column name (null for the first).

    Groups are split by bucket (a coarse, monotone function of order, such as its day), so that a group that holds a
    third of all rows is sorted by many tasks; the first row of each bucket takes the last row of the bucket before
    it from a table of one row per bucket. Orders must be unique within a group.
    """
    cut = df.withColumn("_bucket", bucket)
    inner = cut.withColumn("_in", F.lag(value).over(Window.partitionBy(*keys, "_bucket").orderBy(order)))
    lasts = cut.groupBy(*keys, "_bucket").agg(F.max_by(value, order).alias("_last"))
    lasts = lasts.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))).drop("_last")
    a, b = inner.alias("a"), lasts.alias("b")
    same = F.col("a._bucket").eqNullSafe(F.col("b._bucket"))
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left").select("a.*", F.coalesce("a._in", "b._before").alias(name)).drop("_bucket", "_in")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with dense numbers from 0 by order, which must be unique, as column name.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus the sizes of the partitions
    before it, so no task ever holds more than one range.
    """
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(cut.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    return join_measured(placed, before, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
