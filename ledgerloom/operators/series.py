"""Run histories: recurrence in a window, trend, distance to the last hit, carried values and order violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recurrence(df: DataFrame, keys: list[str], order: str, value: str, window: int) -> DataFrame:
    """df with rate (share of values above 0 in the last window runs and this one) and trend (difference to the run before)."""
    w = Window.partitionBy(*keys).orderBy(order)
    rate = F.round(F.avg((F.col(value) > 0).cast("double")).over(w.rowsBetween(-window, 0)), 4)
    return df.withColumns({"rate": rate, "trend": F.col(value) - F.lag(value).over(w)})


def runs_since(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with since: how many runs ago value was last above 0 (0 now, null if never)."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = df.withColumn("_n", F.row_number().over(w))
    last = F.last(F.when(F.col(value) > 0, F.col("_n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("since", (F.col("_n") - last).cast("bigint")).drop("_n")


def carry(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """df with the last non-null value so far in its group."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def violations(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is below the one before it."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("previous", before).where(F.col("previous") > F.col(value))


def within_target(df: DataFrame, group: list[str], rate: str, trend: str, target: float) -> DataFrame:
    """group, max_rate, meets_target (no rate above it) and not_rising (no positive trend)."""
    return df.groupBy(*group).agg(F.max(rate).alias("max_rate"), (F.max(rate) <= target).alias("meets_target"), F.bool_and(F.coalesce(F.col(trend), F.lit(0)) <= 0).alias("not_rising"))
