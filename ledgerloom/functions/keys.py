"""Keys of evidence and structures: canonical identities, display texts, typed keys, and tolerant access to JSON."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import col


def quoted(c: str | Column) -> Column:
    """A string as a JSON string; null as null."""
    one = F.to_json(F.array(col(c)))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def evidence_key(kind: str, **parts: Column) -> Column:
    """Canonical JSON identity of evidence: kind and its parts, keys sorted; null parts are left out."""
    fields = sorted({**{k: v.cast("string") for k, v in parts.items()}, "kind": F.lit(kind)}.items())
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), quoted(v)) for k, v in fields)), F.lit("}"))


def display(kind: str | Column, *parts: Column) -> Column:
    """E:kind::a::b, without null parts."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("E:"), F.concat_ws("::", k, *parts))


def parse_display(c: str | Column) -> Column:
    """kind and parts of a display text; null for other texts."""
    at = F.split(F.substring(col(c), F.lit(3), F.length(col(c))), "::")
    return F.when(col(c).startswith("E:") & (at[0] != ""), F.struct(at[0].alias("kind"), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))).alias("parts")))


def typed(value: Column, kind: str) -> Column:
    """A value's key that tells 1, 1.0, true and "1" apart, and null from all."""
    return F.when(value.isNull(), "null").otherwise(F.concat(F.lit(f"{kind}="), value.cast("string")))


def nested_int(c: str | Column, path: str) -> Column:
    """The whole number at a JSON path, 0 where there is none."""
    return F.coalesce(F.get_json_object(col(c), path).try_cast("bigint"), F.lit(0).cast("bigint"))


def with_path(m: str | Column, path: str, value: Column) -> Column:
    """A map of dotted paths with one of them set."""
    return F.map_concat(F.map_filter(col(m), lambda k, _: k != path), F.create_map(F.lit(path), value))


def targets(c: str | Column) -> Column:
    """Distinct (path, qual) structs in order, those without a path left out."""
    return F.array_sort(F.array_distinct(F.filter(col(c), lambda x: x["path"].isNotNull() & (x["path"] != ""))))


def test_prefix(c: str | Column) -> Column:
    """The first word after test_, null for other names."""
    return F.nullif(F.regexp_extract(col(c), r"^test_([A-Za-z0-9]+)", 1), F.lit(""))


def singular(c: str | Column) -> Column:
    """A plural name's singular by its ending."""
    s = col(c)
    return F.when(s.rlike("[a-z]ies$"), F.regexp_replace(s, "ies$", "y")).when(s.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(s, "es$", "")).when(s.rlike("[a-z]s$") & ~s.rlike("(ss|us|is)$"), F.regexp_replace(s, "s$", "")).otherwise(s)


def exception_fits(raised: str, caught: str) -> str:
    """compatible if a handler of caught gets raised, incompatible if not, unknown for names that aren't built in."""
    import builtins

    a, b = getattr(builtins, raised, None), getattr(builtins, caught, None)
    if not all(isinstance(x, type) and issubclass(x, BaseException) for x in (a, b)):
        return "unknown"
    return "compatible" if issubclass(a, b) else "incompatible"


@F.pandas_udf(T.StringType())
def exception_match(raised: pd.Series, caught: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else exception_fits(a, b) for a, b in zip(raised, caught)], dtype=object)


def type_atoms(hint: str) -> tuple[list[str], list[str]]:
    """Leaf types and constructors of a type hint, each sorted, with repeats."""
    from ledgerloom.functions.scalars import split_top, type_key

    leaves, makers, todo = [], [], [type_key(hint)]
    while todo:
        t = todo.pop()
        m = re.fullmatch(r"([^\[]+)\[(.*)\]", t)
        if m:
            makers.append(m[1])
            todo += [x for x in split_top(m[2], ",") if x]
        elif t:
            leaves.append(t)
    return sorted(leaves), sorted(makers)


@F.pandas_udf(T.StructType([T.StructField("base", T.ArrayType(T.StringType())), T.StructField("ctor", T.ArrayType(T.StringType()))]))
def atoms(s: pd.Series) -> pd.DataFrame:
    got = [type_atoms(x) if x is not None else (None, None) for x in s]
    return pd.DataFrame({"base": [a for a, _ in got], "ctor": [b for _, b in got]})
