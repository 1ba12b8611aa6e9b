"""Comparisons of a current relation with a baseline: counts, entities, gates, ratchets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_delta(baseline: DataFrame, current: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """keys, baseline, current, delta over the union of keys, missing counts 0. One shuffle: both sides are added up."""
    a = baseline.select(*keys, F.col(count).alias("_b"), F.lit(0).cast("bigint").alias("_c"))
    b = current.select(*keys, F.lit(0).cast("bigint").alias("_b"), F.col(count).alias("_c"))
    g = a.unionByName(b).groupBy(*keys).agg(F.sum(F.coalesce("_b", F.lit(0))).alias("baseline"), F.sum(F.coalesce("_c", F.lit(0))).alias("current"))
    return g.withColumn("delta", F.col("current") - F.col("baseline"))


def entity_delta(baseline: DataFrame, current: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, change_kind (added, removed, changed) of entities; values are compared with nulls equal."""
    side = lambda df, n: df.select(*keys, F.xxhash64(*(x for v in values for x in (F.col(v).isNull(), F.col(v)))).alias("_h"), F.lit(n).alias("_side"))
    g = side(baseline, 1).unionByName(side(current, 2)).groupBy(*keys).agg(F.bit_or("_side").alias("_sides"), F.max(F.when(F.col("_side") == 1, F.col("_h"))).alias("_x"), F.max(F.when(F.col("_side") == 2, F.col("_h"))).alias("_y"))
    kind = F.when(F.col("_sides") == 2, "added").when(F.col("_sides") == 1, "removed").when(F.col("_x") != F.col("_y"), "changed")
    return g.select(*keys, kind.alias("change_kind")).where("change_kind is not null")


def gate(delta: Column, warning: int, blocking: int, enabled: bool = True) -> Column:
    """pass, warn or block by thresholds; unreadable where delta is null; disabled if off."""
    if not enabled:
        return F.lit("disabled")
    return F.when(delta.isNull(), "unreadable").when(delta >= blocking, "block").when(delta >= warning, "warn").otherwise("pass")


def ratchet(current: DataFrame, allowed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """New and suppressed rows: current without, and with, an allowed counterpart."""
    a = allowed.select(*keys).distinct()
    return current.join(a, keys, "left_anti"), current.join(a, keys, "left_semi")


def multiset_diff(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change_kind and counts of a multiset's elements: added (new), removed (gone), changed (other count)."""
    n = lambda df: df.groupBy(*keys).agg(F.count("*").alias("count"))
    d = count_delta(n(baseline), n(current), keys)
    kind = F.when(F.col("baseline") == 0, "added").when(F.col("current") == 0, "removed").when(F.col("delta") != 0, "changed")
    return d.withColumn("change_kind", kind).where("change_kind is not null")


def penalty_score(counts: DataFrame, group: list[str], weight: str, count: str) -> DataFrame:
    """group, score, band: 100 less the weights times 1 + floor(log10(count)), bands from 95, 80 and 60."""
    loss = F.when(F.col(count) > 0, F.col(weight) * (1 + F.floor(F.log10(F.col(count).cast("double"))))).otherwise(0)
    g = counts.groupBy(*group).agg(F.greatest(F.lit(0.0), 100 - F.sum(loss)).cast("double").alias("score"))
    return g.withColumn("band", F.when(F.col("score") >= 95, "strong").when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "fair").otherwise("weak"))


def set_diff(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change_kind: members that only one of two sets has, added or removed. One shuffle; repeats count once."""
    side = lambda df, n: df.select(*keys, F.lit(n).alias("_s"))
    g = side(baseline, 1).unionByName(side(current, 2)).groupBy(*keys).agg(F.bit_or("_s").alias("_s"))
    return g.where("_s <> 3").select(*keys, F.when(F.col("_s") == 2, "added").otherwise("removed").alias("change_kind"))


def extinct(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """keys of the sections that were there before and are no more."""
    return set_diff(previous, current, keys).where("change_kind = 'removed'").select(*keys)


def losses(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, before, after where a value fell; a key without a later value is unchanged."""
    a, b = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    return a.join(b, keys).where(F.col("after") < F.col("before"))


def regressions(baseline: DataFrame, current: DataFrame, keys: list[str], value: str, allowed: float = 0.0) -> DataFrame:
    """keys, baseline, current, delta where a metric rose by more than allowed; a metric without a baseline starts from 0."""
    a, b = baseline.select(*keys, F.col(value).alias("baseline")), current.select(*keys, F.col(value).alias("current"))
    j = b.join(a, keys, "left").withColumn("baseline", F.coalesce("baseline", F.lit(0)))
    return j.withColumn("delta", F.col("current") - F.col("baseline")).where(F.col("delta") > allowed).select(*keys, "baseline", "current", "delta")


def state(rows: DataFrame, keys: list[str], status: str) -> DataFrame:
    """keys, status, n: a state's witness rows normalised (blank status = unknown, repeats counted)."""
    named = F.coalesce(F.nullif(F.trim(status), F.lit("")), F.lit("unknown"))
    return rows.groupBy(*keys, named.alias("status")).agg(F.count("*").alias("n"))


def truncated(df: DataFrame, order: list, text: Column, k: int) -> DataFrame:
    """place, line: the first k lines by order, and '... n more' if there are more; k is the feature."""
    first = df.select(*[c for c in df.columns], text.alias("_line")).orderBy(*order).limit(k)
    lines = first.agg(F.collect_list("_line").alias("l")).select(F.posexplode("l").alias("place", "line"))
    more = df.agg((F.count("*") - k).alias("n")).where("n > 0").select(F.lit(k).alias("place"), F.format_string("... %d more", "n").alias("line"))
    return lines.unionByName(more)
