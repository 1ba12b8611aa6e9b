"""Queries of the general training-data problems, one function (spark, sf_dir) -> DataFrame each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import changefeed, hierarchy, nested, onceonly, orphans, schemadrift, snapshotdiff
from ledgerloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_items(table(spark, d, "aspf_artifacts"), table(spark, d, "event_envelopes"))


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """The rows of every node type's table, of artifacts and of payloads."""
    return nested.all_tables(table(spark, d, "aspf_artifacts"), table(spark, d, "event_envelopes"))


def p1_table_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each node type's table has, and how many of them under each type of parent."""
    return p1_tables(spark, d).groupBy("node_type", "parent_type").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.replay(table(spark, d, "event_envelopes"), table(spark, d, "snapshot_envelopes"), table(spark, d, "commit_markers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return onceonly.surplus_deliveries(table(spark, d, "event_envelopes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schemadrift.file_changes(table(spark, d, "archive_files"))


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    return schemadrift.unified(table(spark, d, "archive_files"))


def p4_event_envelope(spark: SparkSession, d: str) -> DataFrame:
    return schemadrift.wide_table(p4_unified(spark, d), "event_envelope")


def p4_archive_manifest(spark: SparkSession, d: str) -> DataFrame:
    return schemadrift.wide_table(p4_unified(spark, d), "archive_manifest")


def p4_ambiguity_baseline(spark: SparkSession, d: str) -> DataFrame:
    return schemadrift.wide_table(p4_unified(spark, d), "ambiguity_baseline")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshotdiff.lint_rows(table(spark, d, "lint_entries")).unionByName(snapshotdiff.metric_rows(table(spark, d, "advisory_metrics")))
    return snapshotdiff.snapshot_changes(rows)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.collect_references(table(spark, d, "impact_links"), table(spark, d, "doc_frontmatter"))
    return orphans.orphan_references(refs, table(spark, d, "impact_nodes"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchies(hierarchy.all_edges(table(spark, d, "impact_links"), table(spark, d, "doc_frontmatter")))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    full = hierarchy.hierarchies(hierarchy.all_edges(table(spark, d, "impact_links"), table(spark, d, "doc_frontmatter")), paths=True)
    return hierarchy.descendants(full)


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    full = hierarchy.hierarchies(hierarchy.all_edges(table(spark, d, "impact_links"), table(spark, d, "doc_frontmatter")), paths=True)
    return full.select("hierarchy", "node_name", F.array_join("path", " > ").alias("path"))
