"""Append-only mutation ledgers: folds, committed tails, parity and digests of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(ledger: DataFrame, keys: list[str], order: str, op: Column, value: Column) -> DataFrame:
    """keys, seq, value of live entries: the last set of each key, gone if its last change deletes. Other ops do nothing."""
    last = F.max(F.struct(F.col(order).alias("seq"), op.alias("op"), value.alias("value")))
    return ledger.where(op.isin("set", "delete")).groupBy(*keys).agg(last.alias("m")).where("m.op = 'set'").select(*keys, "m.seq", "m.value")


def committed(ledger: DataFrame, order: str, cursor: Column, durable: Column) -> DataFrame:
    """Changes after the snapshot's cursor and up to the durable sequence; null bounds don't bind."""
    at = F.col(order)
    return ledger.where((cursor.isNull() | (at > cursor)) & (durable.isNull() | (at <= durable)))


def same_state(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two replays has, as (row columns..., side); empty if they agree."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def state_digest(state: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row, digest: of the whole state in any order, from commutative sums, so no list of it is ever built."""
    h = lambda s: F.sum(F.xxhash64(F.lit(s), *keys, value).cast("decimal(38,0)")).cast("string")
    return state.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), h(0), h(1)), 256).alias("digest"))
