"""Queries of the text-corpus problems; none of them can be written in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import leakage, packing, readability
from ledgerloom.session import table


def p8_assignment(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_bins"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of p8_assignment are, and how much the patterns carry."""
    return packing.fill_report(p8_assignment(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), reports=True)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return readability.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "reading_level")


QUERIES = {f.__name__: f for f in (p8_assignment, p8_fill, p9_found, p9_report, p10_found)}
ORACLES: dict[str, str] = {}
