"""Joins that Spark has no operator for: intervals, points in intervals, ordered fall-through, ambiguity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals meet; a has (keys, a_id, a_start, a_end), b likewise.

    Intervals are put into the cells of the given width that they touch, and cells are joined by equality. Each pair
    comes from the first cell that both touch, so none is repeated and nothing needs a distinct. Intervals that end
    before they start meet nothing.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    x = a.where("a_start <= a_end").withColumn("cell", F.explode(F.sequence(cell("a_start"), cell("a_end"))))
    y = b.where("b_start <= b_end").withColumn("cell", F.explode(F.sequence(cell("b_start"), cell("b_end"))))
    met = (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")) & (F.col("cell") == F.greatest(cell("a_start"), cell("b_start")))
    return x.join(y, [*keys, "cell"]).where(met).drop("cell")


def point_join(points: DataFrame, spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Points (keys, at, ...) with the spans (keys, start, end, ...) that hold them; span ends may be in either order."""
    cell = lambda c: F.floor(c / width)
    s = spans.withColumn("_lo", F.least("start", "end")).withColumn("_hi", F.greatest("start", "end")).withColumn("cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    p = points.withColumn("cell", cell(F.col("at")))
    return p.join(s, [*keys, "cell"]).where("at between _lo and _hi").drop("cell", "_lo", "_hi")


def first_match(left: DataFrame, candidates: list[DataFrame], key: str, value: str) -> DataFrame:
    """left with value from the first list of candidates that has the key; in one list several hits are ambiguous.

    Columns added: value, level (0 from the first list) and hits. Lists are aggregated by key before the join.
    """
    every = reduce(DataFrame.unionByName, [c.select(F.col(key), F.col(value).alias("_v")).dropna().distinct().withColumn("_level", F.lit(i)) for i, c in enumerate(candidates)])
    per = every.groupBy(key, "_level").agg(F.count("*").alias("_hits"), F.min("_v").alias("_v"))
    best = per.groupBy(key).agg(F.min(F.struct("_level", "_hits", "_v")).alias("_b"))
    return left.join(best, key, "left").withColumns({value: F.col("_b._v"), "level": F.col("_b._level"), "hits": F.col("_b._hits")}).drop("_b")


def ambiguity(candidates: DataFrame, name: str) -> DataFrame:
    """candidates with n (rows of the name), confidence 1 if unique else at least 0.1 of 1/n, and inferred if several."""
    n = candidates.groupBy(name).agg(F.count("*").alias("n"))
    conf = F.when(F.col("n") == 1, 1.0).otherwise(F.greatest(F.lit(0.1), 1 / F.col("n")))
    return candidates.join(n, name).withColumns({"confidence": conf, "inferred": F.col("n") > 1})


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, bucket: Column) -> DataFrame:
    """left with the latest value of right at or before its time; groups are split by bucket (coarse, monotone in time).

    Both sides are merged in order of time within buckets; the state at the end of each bucket flows to the next ones
    through a table of one row per bucket, so a hot key is sorted by many tasks.
    """
    x = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1))
    y = right.select(*keys, time, F.col(value).alias("_v")).withColumn("_left", F.lit(0))
    both = x.unionByName(y, allowMissingColumns=True).withColumn("_b", bucket)
    inner = Window.partitionBy(*keys, "_b").orderBy(time, "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_in", F.last("_v", ignorenulls=True).over(inner))
    ends = both.where("_left = 0").groupBy(*keys, "_b").agg(F.max_by("_v", time).alias("_end"))
    marks = both.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "left")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*keys, "_b", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    out = seen.where("_left = 1").join(carried, [*keys, "_b"], "left")
    return out.withColumn(f"asof_{value}", F.coalesce("_in", "_before")).drop("_v", "_left", "_b", "_in", "_before")
