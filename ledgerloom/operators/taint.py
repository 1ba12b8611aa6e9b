"""Taint ledgers: markers with profiles and boundaries to statuses, summaries and lifecycle decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of taint.
KINDS = ("control_ambiguity", "data_ambiguity", "schema_drift", "temporal_drift", "unknown")


def resolve_kind(tag: Column, default: str = "unknown") -> Column:
    t = F.lower(F.trim(tag))
    return F.when(t.isin(*KINDS), t).otherwise(default)


def status(profile: Column, kind: Column, expired: Column, boundary_known: Column, boundary_allows: Column, witness: Column) -> Column:
    """Status of a marker: an expired exemption first, then by profile; null conditions count as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    unknown = kind == "unknown"
    observe = F.when(unknown, "unresolved").when(yes(witness), "resolved").otherwise("unresolved")
    strict = F.when(~yes(boundary_known) | ~yes(boundary_allows), "illegal_locus").when(~yes(witness), "missing_witness").when(unknown, "unresolved").otherwise("resolved")
    return F.when(yes(expired), "expired_exemption").when(profile == "observe", observe).otherwise(strict)


def with_boundary(markers: DataFrame, boundaries: DataFrame) -> DataFrame:
    """markers with the boundary of their boundary_id, or else of their suite_id (boundary_known, allowed_kinds)."""
    valid = boundaries.where("trim(boundary_id) <> ''").select("boundary_id", "suite_id", "allowed_kinds")
    one = valid.groupBy("boundary_id").agg(F.first("allowed_kinds").alias("by_id"))
    two = valid.where("suite_id is not null").groupBy("suite_id").agg(F.min_by("allowed_kinds", "boundary_id").alias("by_suite"))
    j = markers.join(one, "boundary_id", "left").join(two, "suite_id", "left")
    return j.withColumn("allowed_kinds", F.coalesce("by_id", "by_suite")).withColumn("boundary_known", F.col("allowed_kinds").isNotNull()).drop("by_id", "by_suite")


def summary(records: DataFrame) -> DataFrame:
    """One row: total, strict_unresolved, and counts by status and kind as (metric, key, n) rows."""
    rows = records.select(F.explode(F.array(F.struct(F.lit("total").alias("metric"), F.lit("").alias("key")), F.struct(F.lit("status").alias("metric"), F.col("status").alias("key")), F.struct(F.lit("kind").alias("metric"), F.col("kind").alias("key")))).alias("m"))
    return rows.groupBy("m.metric", "m.key").agg(F.count("*").alias("n"))


def lifecycle(gates: DataFrame) -> DataFrame:
    """profile, decision from gate rows (profile, gate, ready, regressed): demote on a regression, promote if all ready."""
    g = gates.groupBy("profile").agg(F.bool_and(F.coalesce("ready", F.lit(False))).alias("ready"), F.bool_or(F.coalesce("regressed", F.lit(False))).alias("regressed"))
    return g.select("profile", F.when(F.col("regressed"), "demote").when(F.col("ready"), "promote").otherwise("hold").alias("decision"))


def incidents(records: DataFrame, profile: str = "profile") -> DataFrame:
    """profile, status, n of the statuses that speak against a profile: all but resolved ones."""
    return records.where("status <> 'resolved'").groupBy(profile, "status").agg(F.count("*").alias("n"))
