"""Specs to DataFrame transformations; Catalyst plans them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.spec import Spec, normalize

#: Named row predicates: (DataFrame, parameters) to a condition.
Predicate = Callable[[DataFrame, Mapping], Column]


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def get(df: DataFrame, name: str) -> Column:
    """A column, or null where the relation lacks it."""
    return F.col(f"`{name}`") if _has(df, name) else F.lit(None).cast("string")


def select(df: DataFrame, names: list[str], registry: Mapping[str, Predicate], params: Mapping) -> DataFrame:
    """Rows that meet all named predicates; unknown names do nothing, an unknown truth value is no match."""
    known = [F.coalesce(registry[n](df, params), F.lit(False)) for n in names if n in registry]
    return df.filter(reduce(lambda a, b: a & b, known)) if known else df


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*(get(df, f).alias(f) for f in fields))


def count_by(df: DataFrame, fields: list[str]) -> DataFrame:
    """Groups and their counts; null is a group, a group field named count gives way to the count."""
    keyed = project(df, fields)
    grouped = keyed.groupBy(*(F.col(f"`{f}`") for f in fields)).agg(F.count(F.lit(1)).alias("_n"))
    kept = [f for f in fields if f != "count"]
    return grouped.select(*(F.col(f"`{f}`") for f in kept), F.col("_n").alias("count"))


def traverse(df: DataFrame, p: Mapping) -> DataFrame:
    """One row per element of a list field.

    A missing field, one that isn't a list, null and empty lists give no rows. Struct elements are merged into the row
    with a prefix unless merge is off, later names winning; other elements, or all without merge, become column `as`.
    index names a column for the position from 0; keep retains the list.
    """
    name = p.get("field")
    if not isinstance(name, str) or not _has(df, name) or not isinstance(df.schema[name].dataType, T.ArrayType):
        return df.limit(0)
    element = df.schema[name].dataType.elementType
    alias, prefix, index = p.get("as") or name, p.get("prefix") or "", p.get("index")
    merge, keep = p.get("merge", True), p.get("keep", False)
    rows = df.select("*", F.posexplode(F.col(f"`{name}`")).alias("_at", "_element"))
    new: dict[str, Column] = {c: F.col(f"`{c}`") for c in df.columns if c != name or keep}
    if index:
        new[index] = F.col("_at")
    if merge and isinstance(element, T.StructType):
        for f in element.fieldNames():
            new[prefix + f] = F.col(f"_element.`{f}`")
    else:
        new[alias] = F.col("_element")
    return rows.select(*(c.alias(n) for n, c in new.items()))


def order(df: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Ascending keys have nulls last, descending ones first; lists, maps and structs are compared as JSON text."""
    cols = []
    for f, d in keys:
        c = get(df, f)
        if _has(df, f) and isinstance(df.schema[f].dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        cols.append(c.desc_nulls_first() if d == "desc" else c.asc_nulls_last())
    return df.orderBy(*cols)


def apply_spec(spec: Spec, df: DataFrame, registry: Mapping[str, Predicate] | None = None, params: Mapping | None = None, normalizer: Callable[[Spec], dict] = normalize) -> DataFrame:
    """The relation that spec makes of df. params override the spec's own; operations of unknown name do nothing.

    Consecutive sorts compose as stable sorts do: the later one leads and the earlier one breaks its ties.
    """
    plan = normalizer(spec)
    bound = {**plan["params"], **(params or {})}
    pending: list[tuple[str, str]] = []
    for step in plan["pipeline"]:
        op, p = step["op"], step["params"]
        if op == "sort":
            keys = [(k["field"], k["order"]) for k in p["by"]]
            pending = keys + [k for k in pending if k[0] not in {f for f, _ in keys}]
            continue
        if op == "limit" and pending:
            df, pending = order(df, pending).limit(p["count"]), pending
            continue
        if op == "select":
            df = select(df, p["predicates"], registry or {}, bound)
        elif op == "project":
            gone = [k for k in pending if k[0] not in p["fields"]]
            df = project(order(df, pending) if gone else df, p["fields"])
            pending = [] if gone else pending
        elif op == "count_by":
            df, pending = count_by(df, p["fields"]), [(f, "asc") for f in p["fields"] if f != "count"]
        elif op == "traverse":
            df = traverse(df, p)
        elif op == "limit":
            df = df.limit(p["count"])
    return order(df, pending) if pending else df
