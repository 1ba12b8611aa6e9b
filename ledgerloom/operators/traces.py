"""Execution traces and sessions: order, merging, opportunities, manifests, phases and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of trace events in the order in which they count at one sequence.
KINDS = ("one_cell", "two_cell", "cofibration", "surface_update")
#: Parts that a group is cut into where only its first rows are wanted.
PARTS = 32


def ordered(events: DataFrame) -> DataFrame:
    """events with kind_rank, sorted by sequence, rank of the kind (others last) and line."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))[F.col("kind")], F.lit(len(KINDS)))
    return events.withColumn("kind_rank", rank).orderBy("sequence", "kind_rank", "line")


def merge(*traces: DataFrame) -> DataFrame:
    """The union of traces (trace columns alike), each row once."""
    out = traces[0]
    for t in traces[1:]:
        out = out.unionByName(t)
    return out.distinct()


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each group with their place from 1; order must be total within a group.

    Each group is first reduced to k rows in each of PARTS parts, so no task sorts a group that holds a third of all rows.
    """
    cut = df.withColumn("_part", F.pmod(F.xxhash64(*(F.col(c) for c in df.columns if df.schema[c].dataType.typeName() != "map")), F.lit(PARTS)))
    few = cut.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col(name) <= k)
    return few.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k).drop("_part")


def tail(mutations: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """The last k mutations of each key, the latest first."""
    return first_rows(mutations, keys, [F.desc(order)], k)


def opportunities(df: DataFrame, key: str, predicates: dict[str, list[Column]]) -> DataFrame:
    """key, kind, satisfied, total, confidence: every kind's conditions on every observation; null counts as false.

    confidence is the share that holds, to two places; kinds are code, so this is one projection without a join.
    """
    holds = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    row = lambda n, cs: F.struct(F.lit(n).alias("kind"), sum((holds(c) for c in cs), F.lit(0)).alias("satisfied"), F.lit(len(cs)).alias("total"))
    each = df.select(key, F.explode(F.array(*(row(n, cs) for n, cs in predicates.items()))).alias("r")).select(key, "r.*")
    return each.withColumn("confidence", F.round(F.col("satisfied") / F.col("total"), 2))


def manifest(events: DataFrame) -> DataFrame:
    """session, sequence, step, status of a session's steps from its events (session, at, kind, sequence, step, status).

    prepare_step appends a step, with the next number of its session; record_step sets the status of the step of its
    sequence, the latest at wins; records of sequences that weren't prepared do nothing. A step without a record is
    'prepared'.
    """
    prepared = events.where("kind = 'prepare_step'").select("session", "at", "step", F.row_number().over(Window.partitionBy("session").orderBy("at", "step")).alias("sequence"))
    records = events.where("kind = 'record_step'").groupBy("session", "sequence").agg(F.max(F.struct("at", "status")).alias("m")).select("session", "sequence", F.col("m.status").alias("status"))
    return prepared.join(records, ["session", "sequence"], "left").select("session", "sequence", "step", F.coalesce("status", F.lit("prepared")).alias("status"))


def phase_regressions(df: DataFrame, keys: list[str], order: str, phase: str, phases: list[str]) -> DataFrame:
    """Rows whose phase lies before one that their group has reached; unknown phases are before all."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for i, p in enumerate(phases) for x in (p, i)))[F.col(phase)], F.lit(-1))
    reached = F.max("_rank").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_rank", rank).withColumn("reached", reached).where("_rank < reached").drop("_rank")


def appended(existing: DataFrame, new: DataFrame, order: list[str], seq: str = "seq") -> DataFrame:
    """new with sequence numbers that go on after those of existing, by order, which must be unique."""
    from ledgerloom.functions.ordering import numbered

    last = existing.agg(F.coalesce(F.max(seq), F.lit(0)).alias("m")).first()["m"]  # one number
    return numbered(new, order, "_n").withColumn(seq, (F.col("_n") + 1 + last).cast("bigint")).drop("_n")


def rollup(rows: DataFrame, levels: list[str], value: str) -> DataFrame:
    """levels, level, n, total: sums of a profile by each prefix of levels, the whole included."""
    g = rows.rollup(*levels).agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(*levels, "level", "n", "total")


def witnesses(rows: DataFrame) -> DataFrame:
    """representative, surfaces, witnesses, first_witness of rows (representative, surface, witness)."""
    return rows.groupBy("representative").agg(F.count_distinct("surface").alias("surfaces"), F.count_distinct("witness").alias("witnesses"), F.min("witness").alias("first_witness"))


def plan_order(plans: DataFrame, kinds: list[str]) -> DataFrame:
    """plans (kind, plan_id) with kind_rank, ordered by it and the id; kinds that aren't listed come last."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, i)))[F.col("kind")], F.lit(len(kinds)))
    return plans.withColumn("kind_rank", rank).orderBy("kind_rank", "plan_id")
