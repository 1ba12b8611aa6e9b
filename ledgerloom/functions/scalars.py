"""Scalar functions: canonical encodings, digests, sets of parameters, type keys, durations and tolerant numbers.

Those that are expressions stay in the JVM; the recursive text functions are Arrow-batched pandas functions.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import col, read_object


def canonical_json(value) -> str:
    """Compact JSON with sorted keys; sets and other values that JSON lacks are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_multiset(pairs) -> list[list]:
    """[[value, count], ...] with equal values merged and ordered by their canonical text; counts must be positive."""
    total: dict[str, int] = {}
    for value, n in pairs:
        if not isinstance(n, int) or isinstance(n, bool) or n <= 0:
            raise ValueError("counts of a multiset are positive whole numbers")
        k = canonical_json(value)
        total[k] = total.get(k, 0) + n
    return [[json.loads(k), total[k]] for k in sorted(total)]


@F.pandas_udf(T.StringType())
def canonical_text(s: pd.Series) -> pd.Series:
    """JSON text to canonical JSON; what can't be read becomes null."""

    def one(x):
        try:
            return None if x is None else canonical_json(json.loads(x))
        except (ValueError, RecursionError):
            return None

    return s.map(one)


@F.pandas_udf(T.StringType())
def canonical_object(s: pd.Series) -> pd.Series:
    """JSON objects to canonical JSON, also those encoded once more as a JSON string; all else becomes null."""

    def one(x):
        try:
            value = read_object(x)
            return None if value is None else canonical_json(value)
        except (ValueError, RecursionError):
            return None

    return s.map(one)


@F.pandas_udf(T.StringType())
def evidence_fingerprint(s: pd.Series) -> pd.Series:
    """ekf: and 96 bits of BLAKE2s of a text."""
    return s.map(lambda x: None if x is None else "ekf:" + hashlib.blake2s(x.encode(), digest_size=12).hexdigest())


def digest(c: str | Column) -> Column:
    return F.sha2(col(c), 256)


def short_id(prefix: str, c: str | Column) -> Column:
    """prefix: and the first 16 hex digits of the digest."""
    return F.concat(F.lit(prefix + ":"), F.substring(digest(c), 1, 16))


def typed_part(c: str | Column, kind: str) -> Column:
    """A value with its type in front, so that 1, true and "1" differ."""
    return F.when(col(c).isNull(), "none:").otherwise(F.concat(F.lit(kind + ":"), col(c).cast("string")))


def paramset(c: str | Column) -> Column:
    """Tidied, non-empty, distinct, sorted strings."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(col(c), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Likeness of two sets given as arrays; 1 for two empty ones."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(col(a), col(b))) / union)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals meet."""
    return (a_start <= b_end) & (b_start <= a_end)


def tolerant_int(c: str | Column) -> Column:
    return F.coalesce(F.expr("0") if c is None else col(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def format_delta(c: str | Column) -> Column:
    return F.when(col(c) >= 0, F.concat(F.lit("+"), col(c).cast("string"))).otherwise(col(c).cast("string"))


def format_transition(a: Column, b: Column) -> Column:
    return F.concat(a.cast("string"), F.lit(" -> "), b.cast("string"), F.lit(" ("), format_delta(b - a), F.lit(")"))


# Units of durations in nanoseconds.
_UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


def duration_ns(c: str | Column) -> Column:
    """750ms, 1m30s and the like to nanoseconds; null where the whole text isn't a duration."""
    text = F.lower(F.regexp_replace(col(c), r"\s+", ""))
    parts = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?(?:ns|us|ms|s|m|h))"), F.lit(1))
    unit = F.create_map(*(F.lit(x) for p in _UNITS.items() for x in p))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + F.regexp_extract(x, r"^([\d.]+)", 1).cast("double") * unit[F.regexp_extract(x, r"([a-z]+)$", 1)])
    return F.when(F.concat_ws("", parts) == F.nullif(text, F.lit("")), F.round(total).cast("bigint"))


def path_is_test(c: str | Column) -> Column:
    """In a tests folder, or a file named test_*.py or *_test.py."""
    return F.coalesce(F.regexp_like(col(c), F.lit(r"(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.py$")), F.lit(False))


def split_top(text: str, sep: str) -> list[str]:
    """Pieces of text between separators outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "[({") - (c in "])}")
        if c == sep and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in (*out, text[start:])]


def type_key(hint: str) -> str:
    """One spelling of a type hint: no typing prefix, unions sorted, Optional as a union with None."""
    t = re.sub(r"\b(?:typing|t|types|builtins)\.", "", hint.strip().strip("\"'"))
    parts = [p for p in split_top(t, "|") if p]
    if len(parts) > 1:
        return _union([type_key(p) for p in parts])
    head, bracket, rest = t.partition("[")
    if not bracket or not t.endswith("]"):
        return "None" if t == "NoneType" else t.strip()
    args = [type_key(a) for a in split_top(rest[:-1], ",") if a]
    if head.strip() == "Union":
        return _union(args)
    if head.strip() == "Optional":
        inner = [a for x in args for a in (_members(x))]
        return _union(list(dict.fromkeys([*inner, "None"])))
    names = {"List": "list", "Dict": "dict", "Set": "set", "Tuple": "tuple", "FrozenSet": "frozenset", "Type": "type"}
    return f"{names.get(head.strip(), head.strip())}[{', '.join(args)}]"


def _members(key: str) -> list[str]:
    return split_top(key[6:-1], ",") if key.startswith("Union[") else [key]


def _union(parts: list[str]) -> str:
    flat = sorted(p for x in parts for p in _members(x))
    return flat[0] if len(flat) == 1 else f"Union[{', '.join(flat)}]"


@F.pandas_udf(T.StringType())
def type_keys(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else type_key(x))


def bundle_name(members: list[str], frequency: dict[str, int]) -> str:
    """Camel-cased anchor member and Bundle; the anchor is the most frequent, then the longest, then the first."""
    if not members:
        return "Bundle"
    anchor = max(sorted(members), key=lambda m: (frequency.get(m, 0), len(m)))
    return "".join(w[:1].upper() + w[1:] for w in re.split(r"[^0-9A-Za-z]+", anchor) if w) + "Bundle"
